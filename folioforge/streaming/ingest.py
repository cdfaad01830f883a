"""Incremental ingestion: the batch transformations over file streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators.convert import convert
from folioforge.runtime import shared_folder
from folioforge.sources.files import described_files


def file_stream(spark: SparkSession, folder: str, pattern: str = "*", a_time: int = 1000) -> DataFrame:
    """New files below ``folder`` as documents, at most ``a_time`` for each batch."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", a_time).load(folder)
    return described_files(raw)


def converted_stream(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """The results of new files; stateless, so that it needs no watermark."""
    return convert(file_stream(spark, folder, pattern))


def without_repeats(documents: DataFrame, time: str, late: str = "1 day") -> DataFrame:
    """Documents whose content came before, within ``late`` of event time, are left out."""
    return documents.withColumn("digest", F.sha2("content", 256)).withWatermark(time, late).dropDuplicatesWithinWatermark(["digest"])


def write(results: DataFrame, folder: str, checkpoint: str):
    """Append all that is there now to a table and stop; starting again goes on from there."""
    return results.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def counted(spark: SparkSession, path: str) -> DataFrame:
    """Results and documents by converter of a table of results read as a stream."""
    schema = spark.read.parquet(path).schema
    place = shared_folder(spark, "stream")
    # A file is read as a stream of its folder with only that name.
    folder, _, name = path.rstrip("/").rpartition("/")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    one = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").limit(2).collect()
    single = len(one) == 1 and one[0].path.endswith("/" + name)
    source = stream.option("pathGlobFilter", name).load(folder) if single else stream.load(path)
    query = write(source.select("doc_id", F.coalesce("converter", F.lit("none")).alias("converter")), f"{place}/out", f"{place}/progress")
    query.awaitTermination()
    rows = spark.read.schema("doc_id string, converter string").parquet(f"{place}/out")
    return rows.groupBy("converter").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))
