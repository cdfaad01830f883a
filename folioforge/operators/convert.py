"""Documents to Markdown, as one narrow stage over Arrow batches."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.formats import pdf, registry
from folioforge.formats.layout import boxes_of
from folioforge.formats.markdown import html_to_markdown
from folioforge.operators import routing
from folioforge.schema import IMAGES, INFO, PAGES, RESULT, SEGMENTS, TEXT_BOXES

ERROR = pa.list_(pa.struct([("converter", pa.string()), ("message", pa.string())]))


def described(documents: DataFrame) -> DataFrame:
    """``documents`` with all columns of a description, null where they are missing."""
    missing = [c for c in INFO if c not in documents.columns]
    return documents.withColumns({c: F.lit(None).cast("string") for c in missing})


def convert(documents: DataFrame, only: str | None = None) -> DataFrame:
    """``doc_id, converter, markdown, title, errors`` of each document.

    The first accepting converter that succeeds wins; failures are rows with null
    markdown and their reasons, never exceptions. ``only`` names one converter to
    use whatever the description says. Null content is a failure, an empty one an
    empty document. Formats of plain text never reach Python: YAML, XML (which
    feeds come before) aside, they are one expression of the JVM.
    """
    rows = described(documents).select("doc_id", "content", *INFO)
    if only:
        return _in_python(rows, only)
    rows = routing.routed(rows)
    # What only plain text or YAML takes is decoded and fenced without leaving the JVM.
    native = F.col("route").isin("plain-text", "yaml") & F.col("content").isNotNull()
    text = F.make_valid_utf8(F.col("content").cast("string"))
    language = F.regexp_replace(F.coalesce("extension", F.lit("")), r"^\.+", "")
    bare = language.isin("", "md", "markdown", "txt", "log", "rst")
    markdown = F.when(F.col("route") == "yaml", F.concat(F.lit("```yaml\n"), text, F.lit("\n```"))).when(bare, text).otherwise(F.concat(F.lit("```"), language, F.lit("\n"), text, F.lit("\n```")))
    direct = rows.where(native).select("doc_id", F.col("route").alias("converter"), markdown.alias("markdown"), F.lit(None).cast("string").alias("title"), F.expr("cast(array() as array<struct<converter: string, message: string>>)").alias("errors"))
    return direct.unionByName(_in_python(rows.where(~F.coalesce(native, F.lit(False))), None))


def _in_python(rows: DataFrame, only: str | None) -> DataFrame:
    # The workers know the registry's converters, not those registered here.
    extra = list(registry.EXTRA)

    def run(batches):
        for batch in batches:
            # One document after the other: a batch's contents are held once, its results as they come.
            described_ = batch.select(list(INFO)).to_pylist()
            found = [registry.convert(c.as_py(), i, only, extra) for c, i in zip(batch.column("content"), described_)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([f[k] for f in found], pa.string()) for k in ("converter", "markdown", "title")), pa.array([f["errors"] for f in found], ERROR)],
                names=["doc_id", "converter", "markdown", "title", "errors"],
            )

    return rows.select("doc_id", "content", *INFO).mapInArrow(run, RESULT)


def convert_with(documents: DataFrame, converter: str) -> DataFrame:
    """All documents by the named converter."""
    if converter not in {r.name for r in registry.rules()}:
        raise ValueError(f"no converter is called {converter}")
    return convert(documents, converter)


def failure_message() -> F.Column:
    """The errors of a result as one message."""
    lines = F.transform("errors", lambda e: F.concat(F.lit("  "), e["converter"], F.lit(": "), e["message"]))
    alone = (F.size("errors") == 1) & (F.col("errors")[0]["converter"] == "")
    return F.when(F.col("markdown").isNotNull() | (F.size("errors") == 0), None).when(alone, F.col("errors")[0]["message"]).otherwise(F.concat(F.lit("Conversion failed:\n"), F.array_join(lines, "\n")))


def pdf_relations(documents: DataFrame) -> dict[str, DataFrame]:
    """Pages, text boxes, ruling lines and pictures of PDF documents as relations.

    The files are read once for each relation that is used; write the first one to
    a table where several are.
    """
    record = f"doc_id string, page_number int, page_width double, page_height double, boxes array<struct<text: string, x_left: double, x_right: double, y_top: double, y_bottom: double, font_size: double, is_bold: boolean>>, rules array<array<double>>, images array<array<double>>, error string"

    def run(batches):
        for batch in batches:
            rows = []
            for doc, content in zip(batch.column("doc_id").to_pylist(), batch.column("content")):
                try:
                    for p in pdf.extract(content.as_py() or b""):
                        boxes = [{"text": b["text"], "x_left": b["left"], "x_right": b["right"], "y_top": b["top"], "y_bottom": b["bottom"], "font_size": b["font"], "is_bold": b["bold"]} for b in boxes_of(p["items"])]
                        rows.append((doc, p["page_number"], p["page_width"], p["page_height"], boxes, [list(r) for r in p["rules"]], [list(i) for i in p["images"]], None))
                except Exception as e:  # noqa: BLE001 failures are rows
                    rows.append((doc, None, None, None, None, None, None, str(e) or type(e).__name__))
            c = list(zip(*rows)) or [()] * 8
            box = pa.list_(pa.struct([("text", pa.string()), *((k, pa.float64()) for k in ("x_left", "x_right", "y_top", "y_bottom", "font_size")), ("is_bold", pa.bool_())]))
            kinds = (pa.string(), pa.int32(), pa.float64(), pa.float64(), box, pa.list_(pa.list_(pa.float64())), pa.list_(pa.list_(pa.float64())), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds)], names=[f.split()[0] for f in "doc_id,page_number,page_width,page_height,boxes,rules,images,error".split(",")])

    pages = documents.select("doc_id", "content").mapInArrow(run, record)
    at = pages.where("page_number is not null")
    boxes = at.select("doc_id", "page_number", F.posexplode("boxes").alias("seq", "b"))
    rules = at.select("doc_id", "page_number", F.posexplode("rules").alias("seq", "r"))
    # Only pictures of some size; numbered in the order in which the page shows them.
    shown = F.filter("images", lambda i: F.floor(i[2] - i[0]) * F.floor(i[3] - i[1]) >= 5000)
    images = at.select("doc_id", "page_number", F.posexplode(shown).alias("k", "i"))
    ident = lambda kind, k: F.concat(F.lit("p"), "page_number", F.lit(f"-{kind}"), k)
    return {
        "pages": at.select(*(c.split()[0] for c in PAGES.split(", "))),
        "text_boxes": boxes.select("doc_id", "page_number", "seq", ident("t", "seq").alias("id"), "b.*").select(*(c.split()[0] for c in TEXT_BOXES.split(", "))),
        "segments": rules.select("doc_id", "page_number", "seq", *(F.col("r")[k].alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2")))).select(*(c.split()[0] for c in SEGMENTS.split(", "))),
        "images": images.select("doc_id", "page_number", ident("i", "k").alias("id"), *(F.col("i")[k].alias(n) for k, n in enumerate(("x_left", "y_bottom", "x_right", "y_top")))).select(*(c.split()[0] for c in IMAGES.split(", "))),
        "errors": pages.where("error is not null").select("doc_id", "error"),
    }


def pdf_pictures(documents: DataFrame) -> DataFrame:
    """``doc_id, page_number, name, bytes, error`` of the pictures that pages of PDF documents hold.

    A document that cannot be read is one row with its error; null content is one
    without pictures. Names are ``<doc_id>-p<page>-<k>.<extension>``.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for doc, content in zip(batch.column("doc_id").to_pylist(), batch.column("content")):
                try:
                    for k, (page, kind, data) in enumerate(pdf.pictures(content.as_py()) if content.is_valid else []):
                        rows.append((doc, page, f"{doc}-p{page}-{k}.{kind}", data, None))
                except Exception as e:  # noqa: BLE001 failures are rows
                    rows.append((doc, None, None, None, str(e) or type(e).__name__))
            c = list(zip(*rows)) or [()] * 5
            kinds = (pa.string(), pa.int32(), pa.string(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds)], names=["doc_id", "page_number", "name", "bytes", "error"])

    return documents.select("doc_id", "content").mapInArrow(run, "doc_id string, page_number int, name string, bytes binary, error string")


def register(spark: SparkSession) -> None:
    """``html_to_markdown(html)`` and ``convert_<name>(content, extension)`` as SQL functions."""
    def markdown(html: pd.Series) -> pd.Series:
        return html.map(html_to_markdown, na_action="ignore")

    spark.udf.register("html_to_markdown", F.pandas_udf(markdown, "string"))
    for rule in registry.RULES:

        def one(content: pd.Series, extension: pd.Series, name: str = rule.name) -> pd.Series:
            return pd.Series([registry.convert(None if c is None else bytes(c), {"extension": e}, name)["markdown"] for c, e in zip(content, extension)], dtype=object)

        spark.udf.register("convert_" + rule.name.replace("-", "_"), _typed(one))


def _typed(function):
    def run(content: pd.Series, extension: pd.Series) -> pd.Series:
        return function(content, extension)

    return F.pandas_udf(run, "string")
