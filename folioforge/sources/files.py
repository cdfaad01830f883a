"""Files, standard input and archives as documents; results to files."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.formats.package import Package
from folioforge.formats.registry import extension
from folioforge.runtime import prepare


def described_files(raw: DataFrame) -> DataFrame:
    """Rows of ``binaryFile`` as documents: the path as id, extension in lower case with its dot, name."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    suffix = F.lower(F.regexp_extract(name, r"^.+(\.[^./]+)$", 1))
    return raw.select(
        F.col("path").alias("doc_id"), "content", F.when(suffix != "", suffix).alias("extension"), F.lit(None).cast("string").alias("mimetype"), F.lit(None).cast("string").alias("charset"),
        name.alias("filename"), F.col("path").alias("local_path"), F.lit(None).cast("string").alias("url"), F.col("modificationTime").alias("received_at"),
    )


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """The files below ``folder`` as documents; as in all file sources, names that begin with a dot or underscore are hidden."""
    return described_files(prepare(spark).read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder))


def read_stdin(spark: SparkSession, kind: str | None = None) -> DataFrame:
    """Standard input as one document; refuses a terminal."""
    if sys.stdin.isatty():
        raise ValueError("nothing is piped to standard input")
    return spark.createDataFrame([("-", sys.stdin.buffer.read(), kind)], "doc_id string, content binary, extension string")


def unzipped(documents: DataFrame) -> DataFrame:
    """``doc_id, entry_no, name, extension, content, error``: the entries of zip archives, one row each.

    A broken archive is one row with its error. Entries can then be converted like
    documents of their own and put together again in order.
    """

    def run(batches):
        for batch in batches:
            for doc, content in zip(batch.column("doc_id").to_pylist(), batch.column("content")):
                rows = []
                try:
                    package = Package(content.as_py() or b"")
                    for k, name in enumerate(package.names()):
                        rows.append((doc, k, name, extension(name), package.read(name), None))
                        # A batch for each few entries, so that an archive is never held twice.
                        if len(rows) == 64:
                            yield _batch(rows)
                            rows = []
                except Exception as e:  # noqa: BLE001 failures are rows
                    rows.append((doc, None, None, None, None, str(e) or type(e).__name__))
                yield _batch(rows)

    return documents.select("doc_id", "content").mapInArrow(run, "doc_id string, entry_no int, name string, extension string, content binary, error string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows)) or [()] * 6
    kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds)], names=["doc_id", "entry_no", "name", "extension", "content", "error"])


def zip_markdown(documents: DataFrame) -> DataFrame:
    """``doc_id, markdown`` of archives, by way of their entries as rows."""
    from folioforge.operators.convert import convert

    entries = unzipped(documents).where("error is null").withColumn("entry", F.concat("doc_id", F.lit("\0"), F.col("entry_no").cast("string")))
    inner = entries.where(~F.coalesce(F.col("extension") == ".zip", F.lit(False)))
    done = convert(inner.select(F.col("entry").alias("doc_id"), "content", "extension", F.regexp_extract("name", r"([^/]*)$", 1).alias("filename")))
    good = done.where("converter <> 'plain-text' and trim(markdown) <> ''").select(F.col("doc_id").alias("entry"), F.trim("markdown").alias("body"))
    part = F.concat(F.lit("## File: "), "name", F.lit("\n\n"), F.coalesce("body", F.lit("*[binary file]*")))
    parts = entries.select("doc_id", "entry", "entry_no", "name").join(good, "entry", "left").groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("entry_no", part.alias("part")))), lambda p: p["part"]), "\n\n").alias("parts"))
    label = F.coalesce(F.regexp_extract(F.coalesce("local_path", "filename"), r"([^/]*)$", 1), F.lit("archive.zip")) if {"local_path", "filename"} <= set(documents.columns) else F.lit("archive.zip")
    return documents.select("doc_id", label.alias("label")).join(parts, "doc_id").select("doc_id", F.concat(F.lit("Content from `"), "label", F.lit("`:\n\n"), "parts").alias("markdown"))


def write_markdown(results: DataFrame, folder: str) -> None:
    """Results as a table of Parquet files, failures with their errors."""
    results.write.mode("overwrite").parquet(folder)


def write_images(images: DataFrame, folder: str) -> None:
    """``name, bytes`` to a folder: a table of Parquet files below an address, single files below a path that every executor has mounted.

    Rows without bytes are left out; of rows with one name the last written stays.
    """
    import os

    rows = images.where("bytes is not null").select("name", "bytes")
    if "://" in folder:
        rows.write.mode("overwrite").parquet(folder)
        return

    def run(found):
        os.makedirs(folder, exist_ok=True)
        for r in found:
            with open(os.path.join(folder, os.path.basename(r["name"])), "wb") as file:
                file.write(r["bytes"])

    rows.foreachPartition(run)
