"""Judging conversions: counts, containment, assertions, reports, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lowered_words(text: Column) -> Column:
    """Runs of letters, digits and underscores, in lower case and order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def structure(texts: DataFrame, text: str) -> DataFrame:
    """``texts`` with counts of characters, headings, table rows, list items, links and footnotes."""
    count = lambda p: F.regexp_count(F.col(text), F.lit(p))
    return texts.withColumns(
        {
            "chars": F.length(text),
            "headings": count(r"(?m)^#{1,6} "),
            "table_rows": count(r"(?m)^\|.*\|[ ]*$"),
            "list_items": count(r"(?m)^[ ]*(?:[-*+]|[0-9]+\.) "),
            "links": count(r"\[[^\]\n]*\]\([^)\n]*\)"),
            "footnotes": count(r"\[\^[^\]\n]+\]"),
        }
    )


def trigrams(words: Column) -> Column:
    """The distinct runs of three words; of shorter texts none."""

    def runs(w: Column) -> Column:
        return F.array_distinct(F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.concat_ws(" ", x, w[i + 1], w[i + 2])))

    # Bound once: written out in place, the words would be split anew for each of them.
    return F.element_at(F.transform(F.array(words), runs), 1)


def containment(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """``pairs`` with ``a_in_b`` and ``b_in_a``: shares of each text's trigrams that the other has; null without trigrams."""
    sets = pairs.withColumn("ta", trigrams(lowered_words(F.col(left)))).withColumn("tb", trigrams(lowered_words(F.col(right))))
    both = F.size(F.array_intersect("ta", "tb"))
    share = lambda n: F.when(F.size(n) > 0, F.round(both / F.size(n), 4))
    return sets.withColumn("a_in_b", share("ta")).withColumn("b_in_a", share("tb")).drop("ta", "tb")


def contained_versions(rows: DataFrame, keys: list[str], item: str, text: str) -> DataFrame:
    """``a, b, a_in_b, b_in_a`` of all items a < b that share a key: shares of each one's trigrams that the other has, null where it has none.

    Trigrams are hashed once for each item, and the pairs meet the small arrays, never the texts.
    """
    hashed = F.transform(trigrams(lowered_words(F.col(text))), lambda g: F.xxhash64(g))
    sets = rows.select(*keys, item, hashed.alias("g")).distinct()
    a, b = sets.withColumnsRenamed({item: "a", "g": "ga"}), sets.withColumnsRenamed({item: "b", "g": "gb"})
    both = F.size(F.array_intersect("ga", "gb"))
    share = lambda n: F.when(F.size(n) > 0, F.round(both / F.size(n), 4))
    return a.join(b, keys).where("a < b").select("a", "b", share("ga").alias("a_in_b"), share("gb").alias("b_in_a"))


def mean_containment(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, documents, a_in_b, b_in_a``: pairs and their mean containments; nulls do not count, and none give null."""
    return pairs.groupBy(*keys).agg(F.count("*").alias("documents"), F.round(F.avg("a_in_b"), 4).alias("a_in_b"), F.round(F.avg("b_in_a"), 4).alias("b_in_a"))


def first_documents(rows: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """The rows of the first ``limit`` documents by key; all where it is 0."""
    if not limit:
        return rows
    return rows.join(rows.select(key).distinct().orderBy(key).limit(limit), key, "left_semi")


def recorded(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What of ``work`` a journal has."""
    return work.join(done.select(*keys).distinct(), keys, "left_semi")


def ordered_pairs(rows: DataFrame, keys: list[str], item: str) -> DataFrame:
    """``keys, a, b`` with a < b: the pairs of items that share a key."""
    a, b = rows.select(*keys, F.col(item).alias("a")).distinct(), rows.select(*keys, F.col(item).alias("b")).distinct()
    return a.join(b, keys).where("a < b")


def normalized(text: Column) -> Column:
    """Lower case, single spaces, no trade marks: how texts are compared."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, "[®™]", "")), r"[ \t\r\n]+", " "))


CHECKS = ("contains", "not_contains", "contains_words", "regex", "min_chars", "min_table_rows")


def passes(kind: Column, value: Column, text: Column) -> Column:
    """Whether ``text`` meets one check; null text meets none but ``not_contains``. Unknown kinds are errors."""
    text_ = F.coalesce(text, F.lit(""))
    words = lambda t: F.concat(F.lit(" "), F.array_join(lowered_words(t), " "), F.lit(" "))
    return (
        F.when(kind == "contains", F.contains(normalized(text_), normalized(value)))
        .when(kind == "not_contains", ~F.contains(normalized(text_), normalized(value)))
        .when(kind == "contains_words", F.contains(words(text_), words(value)))
        .when(kind == "regex", F.regexp_like(text_, F.concat(F.lit("(?im)"), value)))
        .when(kind == "min_chars", F.length(text_) >= value.try_cast("int"))
        .when(kind == "min_table_rows", F.regexp_count(text_, F.lit(r"(?m)^\|.*\|[ ]*$")) >= value.try_cast("int"))
        .otherwise(F.raise_error(F.concat(F.lit("unknown check: "), kind)))
    )


def scored(checks: DataFrame, outputs: DataFrame, tool: str = "tool") -> DataFrame:
    """``tool, passed, total, score, complete, documents``: assertions against each tool's outputs.

    ``checks``: doc_id, type, value; ``outputs``: tool, doc_id, text. A document
    that a tool lacks fails all its checks.
    """
    # A handful of tools in one row: each check is repeated for every one of them.
    tools = outputs.agg(F.collect_set(tool).alias("tools"))
    asked = checks.join(F.broadcast(tools)).withColumn(tool, F.explode("tools")).drop("tools")
    met = asked.join(outputs.select(tool, "doc_id", "text"), [tool, "doc_id"], "left").withColumn("ok", F.coalesce(passes(F.col("type"), F.col("value"), F.col("text")), F.lit(False)))
    by_doc = met.groupBy(tool, "doc_id").agg(F.count_if("ok").alias("passed"), F.count("*").alias("total"))
    return by_doc.groupBy(tool).agg(
        F.sum("passed").alias("passed"), F.sum("total").alias("total"), F.round(F.sum("passed") / F.sum("total"), 4).alias("score"), F.count_if(F.col("passed") == F.col("total")).alias("complete"), F.count("*").alias("documents")
    )


def run_report(results: DataFrame, tool: str, ok: Column, value: Column) -> DataFrame:
    """``tool, runs, passed, failed, median, total`` of timed or sized runs."""
    return results.groupBy(tool).agg(
        F.count("*").alias("runs"), F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"), F.round(F.median(F.when(ok, value)), 3).alias("median"), F.round(F.sum(F.when(ok, value)), 3).alias("total")
    )


def macro_average(rows: DataFrame, outer: list[str], inner: str, value: str) -> DataFrame:
    """``outer, macro``: the mean of the means of each ``inner`` group."""
    means = rows.groupBy(*outer, inner).agg(F.avg(value).alias("m"))
    return means.groupBy(*outer).agg(F.round(F.avg("m"), 4).alias("macro"))


def manifest_difference(expected: DataFrame, found: DataFrame, key: str = "doc_id", digest: str = "digest") -> DataFrame:
    """``key, state``: what is missing, extra or changed against a manifest of digests."""
    a, b = expected.select(key, F.col(digest).alias("da")), found.select(key, F.col(digest).alias("db"))
    both = a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), key, "full")
    state = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "extra").when(~F.col("da").eqNullSafe(F.col("db")), "changed")
    return both.select(key, state.alias("state")).where("state is not null")


def deterministic(runs: DataFrame, keys: list[str], digest: Column) -> DataFrame:
    """``keys, runs, deterministic``: whether all runs gave one result."""
    return runs.groupBy(*keys).agg(F.count("*").alias("runs"), (F.count_distinct(digest) <= 1).alias("deterministic"))


def remaining(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What of ``work`` no record of ``done`` covers."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def quantile_pages(sizes: DataFrame, key: str, pages: str, shares: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """``key, share, page``: the pages at given shares of a document, at least 1; halves round to even."""
    at = F.explode(F.array(*(F.lit(s) for s in shares)))
    return sizes.select(key, pages, at.alias("share")).select(key, "share", F.greatest(F.lit(1), F.least(F.bround(F.col(pages) * F.col("share")), F.col(pages))).cast("int").alias("page"))


#: Words of phrases: letters and figures with an apostrophe inside, or figures with points.
PHRASE_WORD = r"([\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)?)"


def phrase_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(PHRASE_WORD), F.lit(1))


def anchors(lines: DataFrame, pages: DataFrame, titles: DataFrame, size: int = 7) -> DataFrame:
    """``doc_id, page_number, anchor``: for each asked page the phrase of ``size`` words that finds it again.

    ``lines``: doc_id, page_number, seq, text; ``pages``: doc_id, page_number; ``titles``: doc_id, title. Phrases
    come from the middle of lines of 7 to 30 words, 5 with letters at least, under three
    tenths of whose letters are written from the right, and which no cross-column
    join has spoilt. Those that the asked pages have once come first, before all
    those that share under six tenths of the title's words; then least of the title, length
    nearest to 12 words, the middle of the page, and the phrase itself.
    """
    asked = lines.join(pages.select("doc_id", "page_number").distinct(), ["doc_id", "page_number"])
    page = Window.partitionBy("doc_id", "page_number")
    placed = asked.withColumn("at", F.row_number().over(page.orderBy("seq")) - 1).withColumn("half", F.count("*").over(page) / 2)
    letters = F.regexp_count("text", F.lit(r"\p{L}"))
    rtl = F.when(letters > 0, F.regexp_count("text", F.lit(r"[\u0590-\u08ff]")) / letters).otherwise(0.0)
    sound = ~F.col("text").rlike(r"[a-z][A-Z][A-Za-z]*-|[\p{L}\p{N}_]-\s+[\p{L}\p{N}_]") & (rtl < 0.3)
    worded = placed.where(sound).withColumn("w", phrase_words(F.col("text"))).where(F.size("w").between(7, 30) & (F.size(F.filter("w", lambda w: w.rlike(r"\p{L}"))) >= 5))
    named = titles.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list(phrase_words(F.col("title"))))).alias("t"))
    worded = worded.join(named, "doc_id", "left").withColumn("t", F.coalesce("t", F.array().cast("array<string>")))
    overlap = F.size(F.array_intersect(F.array_distinct("w"), F.col("t"))) / F.greatest(F.size("t"), F.lit(1))
    start = F.floor((F.size("w") - size) / 2).cast("int") + 1
    phrased = worded.withColumn("anchor", F.array_join(F.slice("w", start, size), " ")).withColumn("overlap", overlap)
    often = F.count("*").over(Window.partitionBy("doc_id", "anchor")) > 1
    level = F.when(often, 2).when(F.col("overlap") >= 0.6, 1).otherwise(0)
    rank = F.struct("level", "overlap", F.abs(F.size("w") - 12).alias("off"), F.abs(F.col("at") - F.col("half")).alias("far"), "anchor")
    return phrased.withColumn("level", level).groupBy("doc_id", "page_number").agg(F.min_by("anchor", rank).alias("anchor"))


def clipped(text: Column, most: int = 40_000, mark: str = "\n[...]") -> Column:
    """At most ``most`` characters, with a mark where some went."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def envelope() -> Column:
    """The JSON of a result: success, source, title, length, markdown or error; nulls are left out."""
    ok = F.col("markdown").isNotNull()
    return F.to_json(F.struct(ok.alias("success"), F.col("doc_id").alias("source"), "title", F.length("markdown").alias("length"), "markdown"))


def verdicts(raw: DataFrame, column: str) -> DataFrame:
    """Parsed judgements: ``winner`` among A, B and tie and scores of 1 to 5; ``valid`` tells the rest apart."""
    parsed = raw.withColumn("v", F.from_json(column, "winner string, a map<string,int>, b map<string,int>"))
    scores = lambda m: F.coalesce(F.forall(F.map_values(m), lambda x: x.between(1, 5)), F.lit(False))
    return parsed.withColumn("valid", F.coalesce(F.col("v.winner").isin("A", "B", "tie"), F.lit(False)) & scores("v.a") & scores("v.b"))


def latest(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The last row of each group."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() for c in by))
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def judge_tasks(outputs: DataFrame, tool: str = "tool") -> DataFrame:
    """``task_id, doc_id, a, b``: all ordered pairs of tools on each document, with an id that its inputs determine."""
    a, b = (outputs.select("doc_id", F.col(tool).alias(n), F.md5("text").alias("h" + n)) for n in ("a", "b"))
    pairs = a.join(b, "doc_id").where("a <> b")
    # Fields in the order of their names, so that the id does not depend on how they are written.
    task = F.sha2(F.to_json(F.struct("a", "b", "doc_id", "ha", "hb")), 256)
    return pairs.select(task.alias("task_id"), "doc_id", "a", "b")


def log_scores(logs: DataFrame, text: str = "text") -> DataFrame:
    """``tool, score, interval, category, value`` from run logs: a line of the mean and its interval, and lines of categories."""
    mean = lambda k: F.regexp_extract(text, r"(?i)(?:average|overall) score:?\s*([0-9.]+)\s*%?\s*(?:±|\+/-)\s*([0-9.]+)", k).try_cast("double")
    rows = F.explode_outer(F.regexp_extract_all(F.col(text), F.lit(r"(?m)^\s*([a-z_]+)\s*:\s*([0-9.]+)\s*%"), F.lit(0)))
    each = logs.select("tool", mean(1).alias("score"), mean(2).alias("interval"), rows.alias("row"))
    return each.select("tool", "score", "interval", F.regexp_extract("row", r"^\s*([a-z_]+)", 1).alias("category"), F.regexp_extract("row", r":\s*([0-9.]+)", 1).try_cast("double").alias("value"))


def timed(spark, tools: dict, files: list[tuple[str, bytes]], iterations: int = 3, warm_ups: int = 1) -> DataFrame:
    """``tool, file, bytes, ok, timings_ms, hashes, error``: functions timed on the driver, file by file, in turning order.

    A measuring tool for single conversions; failures are rows.
    """
    import hashlib
    import time

    rows, names = [], sorted(tools)
    for k, (name, data) in enumerate(files):
        # The order turns from file to file, so that no tool always comes first.
        for tool in names[k % len(names) :] + names[: k % len(names)]:
            took, hashes, error = [], [], None
            try:
                for n in range(warm_ups + iterations):
                    began = time.perf_counter()
                    result = tools[tool](data)
                    if n >= warm_ups:
                        took.append((time.perf_counter() - began) * 1000)
                        hashes.append(hashlib.sha256(result.encode()).hexdigest())
            except Exception as e:  # noqa: BLE001 failures are rows
                error = str(e) or type(e).__name__
            rows.append((tool, name, len(data), error is None, took, hashes, error))
    return spark.createDataFrame(rows, "tool string, file string, bytes bigint, ok boolean, timings_ms array<double>, hashes array<string>, error string")


def normalized_words(text: Column) -> Column:
    """Words for comparison: entities and simple TeX written out, broken words joined, lower case, one space between."""
    plain = F.regexp_replace(text, r"([\p{L}])-\n([\p{Ll}])", "$1$2")
    for entity, sign in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        plain = F.replace(plain, F.lit(entity), F.lit(sign))
    plain = F.regexp_replace(plain, r"\\[a-zA-Z]+|[{}$^_\\]", " ")
    return F.array_join(lowered_words(plain), " ")
