"""The queries of the ten problems, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import boilerplate, encodings, leakage, lookalikes, packing, prose, residue, scans, shared_spans, splitting
from folioforge.runtime import cut, table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of web pages outside the main body."""
    pages = boilerplate.pages(table(spark, folder, "documents_out"), table(spark, folder, "documents_in"))
    return boilerplate.boilerplate_lines(pages.where("web")).distinct()


def p1_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """The main body of every web page, alone."""
    pages = boilerplate.pages(table(spark, folder, "documents_out"), table(spark, folder, "documents_in"))
    return boilerplate.bodies(pages.where("web"))


def _looks(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, dict]:
    boxes = table(spark, folder, "text_boxes").select("doc_id", "id", "text")
    records = table(spark, folder, "documents_out").select("doc_id", "markdown").where(F.col("markdown").rlike(r"\S"))
    counts = lookalikes.code_points(boxes, ["text"])
    for c, n in lookalikes.code_points(records, ["markdown"]).items():
        counts[c] = counts.get(c, 0) + n
    return boxes, records, lookalikes.rewriting(counts)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of text boxes of one document, and of whole records, that look the same but differ."""
    boxes, records, rules = _looks(spark, folder)
    return lookalikes.pairs(boxes, rules, "id", "text", "doc_id").unionByName(lookalikes.pairs(records, rules, "doc_id", "markdown"))


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The same boxes and records, one row each, with their class and how many others look the same but differ."""
    boxes, records, rules = _looks(spark, folder)
    kinds = (("text_boxes", lookalikes.classes(boxes, rules, "id", "text", "doc_id")), ("documents_out", lookalikes.classes(records, rules, "doc_id", "markdown")))
    a, b = (df.withColumn("tbl", F.lit(name)) for name, df in kinds)
    return a.unionByName(b)


def p2_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The one form of every text box and record, as a digest, and whether its text had to change."""
    boxes, records, rules = _looks(spark, folder)
    parts = []
    for name, df, key, text in (("text_boxes", boxes, "id", "text"), ("documents_out", records, "doc_id", "markdown")):
        formed = lookalikes.one_form(df.select(F.col(key).alias("key"), F.col(text).alias("text")), "text", rules)
        parts.append(formed.select(F.lit(name).alias("tbl"), "key", F.md5("one_form").alias("form"), (F.col("one_form") != F.col("text")).alias("changed")))
    return parts[0].unionByName(parts[1]).distinct()


def p3_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """What each record without real content holds instead."""
    pages = boilerplate.pages(table(spark, folder, "documents_out"), table(spark, folder, "documents_in"))
    return residue.judged(pages).where("evidence is not null").distinct()


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records with placeholders, filler, an error message or a demand for scripts."""
    return p3_evidence(spark, folder).select("doc_id").distinct()


def _garbled(spark: SparkSession, folder: str) -> DataFrame:
    """``tbl, doc_id, page_number, item_no, restored`` of every wrongly decoded record."""
    records = table(spark, folder, "documents_out").select("doc_id", F.col("markdown").alias("text")).where(F.col("text").rlike(r"\S"))
    items = table(spark, folder, "raw_items").select("doc_id", "page_number", "item_no", "text").where(F.col("text").rlike(r"\S"))
    known = encodings.garbled_table([records, items])
    whole = encodings.damaged(records, known, ["doc_id"], "text")
    parts = encodings.damaged(items, known, ["doc_id", "page_number", "item_no"], "text", "doc_id")
    return whole.select(F.lit("documents_out").alias("tbl"), "doc_id", F.lit(0).alias("page_number"), F.lit(0).alias("item_no"), "restored").unionByName(parts.withColumn("tbl", F.lit("raw_items")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records that were decoded with another charset than they had."""
    return _garbled(spark, folder).select("tbl", "doc_id", "page_number", "item_no").distinct()


def p4_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The original text of those records, null where it is lost."""
    return _garbled(spark, folder)


def p5_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics and verdict of every record."""
    pages = boilerplate.pages(table(spark, folder, "documents_out"), table(spark, folder, "documents_in"))
    return prose.quality(pages, table(spark, folder, "common_words")).dropDuplicates(["doc_id"])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records whose main body is mainly a list, a table or junk."""
    pages = boilerplate.pages(table(spark, folder, "documents_out"), table(spark, folder, "documents_in"))
    return prose.quality(pages, table(spark, folder, "common_words")).where("not prose").select("doc_id").distinct()


def _scans(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    records = table(spark, folder, "documents_out").where(F.col("markdown").rlike(r"\S"))
    pdf = records.where("converter = 'pdf'").select("doc_id", "markdown").distinct()
    return pdf, scans.noise(pdf, table(spark, folder, "text_boxes"), records.select(F.col("markdown").alias("text")))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of PDF records with furniture, words broken for the line, or misread words."""
    _, found = _scans(spark, folder)
    return found.where("noise <> 'kept'").select("tbl", "doc_id", "page_number", "line_no", "noise").distinct()


def p6_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """The readable paragraphs of scanned records, and of each page of text boxes."""
    pdf, found = _scans(spark, folder)
    return scans.repaired(pdf, cut(found), table(spark, folder, "text_boxes"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records whose markdown had to be cut."""
    pieces = splitting.split(table(spark, folder, "documents_out"))
    return pieces.where("piece_no = 1").select("doc_id").distinct()


def p7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Extent of every piece of every oversized record."""
    return splitting.split(table(spark, folder, "documents_out").dropDuplicates(["doc_id"])).select(
        "doc_id", "piece_no", "pieces", "start", "end", F.md5("piece").alias("piece_md5")
    )


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of 2,048 tokens or less that each document, or part of one, goes to."""
    return packing.pack(table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold at least 12 consecutive words of an item."""
    return leakage.search(table(spark, folder, "documents"), table(spark, folder, "eval_items")).where("exact").select("doc_id", "item_id")


def p9_paraphrases(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a passage that is close to an item, has its words in the same order and its figures, but no long common run."""
    found = leakage.search(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return found.where("not exact and figures >= 0.5").select("doc_id", "item_id", "run_words", "lcs_words", "item_words", "figures")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a span of at least 200 characters that another one has."""
    return shared_spans.shared(table(spark, folder, "documents")).select("doc_id").distinct()


def p10_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """How many characters of each document are shared; 0 where none are."""
    docs = table(spark, folder, "documents")
    shares = shared_spans.shared(docs).select("doc_id", "shared_chars", "spans")
    return docs.select("doc_id", F.length("text").alias("n_chars")).join(shares, "doc_id", "left").na.fill(0, ["shared_chars", "spans"])


def queries() -> dict:
    return {"p1_found": p1_found, "p1_bodies": p1_bodies, "p2_found": p2_found, "p2_classes": p2_classes, "p2_forms": p2_forms, "p3_found": p3_found, "p3_evidence": p3_evidence, "p4_found": p4_found, "p4_restored": p4_restored, "p5_found": p5_found, "p5_quality": p5_quality, "p6_found": p6_found, "p6_paragraphs": p6_paragraphs, "p7_found": p7_found, "p7_pieces": p7_pieces, "p8_containers": p8_containers, "p9_found": p9_found, "p9_paraphrases": p9_paraphrases, "p10_found": p10_found, "p10_coverage": p10_coverage}


SQL = {
    "p9_found": r"""WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items), d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
    ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM i, unnest(range(1, len(w) - 10)) AS r(k)), dg AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM d, unnest(range(1, len(w) - 10)) AS r(k))
    SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    "p10_found": """WITH w AS (SELECT doc_id, hash(substring(text, k, 200)) AS h FROM documents, unnest(range(1, length(text) - 198)) AS r(k)), s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id))
    SELECT DISTINCT doc_id FROM w SEMI JOIN s USING (h)""",
    "p10_coverage": """WITH w AS (SELECT doc_id, k, hash(substring(text, k, 200)) AS h FROM documents, unnest(range(1, length(text) - 198)) AS r(k)), s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
    m AS (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM w SEMI JOIN s USING (h)),
    c AS (SELECT doc_id, sum(CASE WHEN before IS NULL THEN 200 ELSE least(k - before, 200) END) AS shared_chars, count_if(before IS NULL OR k - before > 200) AS spans FROM m GROUP BY doc_id)
    SELECT doc_id, length(text) AS n_chars, coalesce(shared_chars, 0)::bigint AS shared_chars, coalesce(spans, 0)::bigint AS spans FROM documents LEFT JOIN c USING (doc_id)""",
    "p7_found": "SELECT DISTINCT doc_id FROM documents_out WHERE length(markdown) > 6000",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
