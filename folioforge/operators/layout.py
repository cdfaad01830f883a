"""Pages as relations: running heads, type sizes, lines, headings, tables, assembly.

Every operator takes the relations ``text_boxes`` (doc_id, page_number, seq, text,
x_left, x_right, y_top, y_bottom, font_size, is_bold), ``page_geometry`` or
``raw_items`` and works by doc_id and page, so that a long document spreads over
tasks by its pages. Where a whole document is one group (its modal size, its
heads), only counted values reach that group, never its boxes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import heading_mark, is_chrome, is_folio, one_space, utf16_units

PAGE = ("doc_id", "page_number")


KEY = ("doc_id", "page_number", "seq")


def once(boxes: DataFrame) -> DataFrame:
    """Each box once, by its key: repeats are exact copies. The pages' partitioning serves whatever comes next on a page."""
    return boxes.repartition("doc_id", "page_number").dropDuplicates(list(KEY))


def boxes_of_pages(boxes: DataFrame) -> DataFrame:
    """Each box with text once, its text with single spaces."""
    return once(boxes).withColumn("text", one_space(F.col("text"))).where("text <> ''")


def middle() -> Column:
    """The height of a box's middle."""
    return (F.col("y_top") + F.col("y_bottom")) / 2


def in_margin(margin: float) -> Column:
    """Whether the middle of a box lies in the upper or lower ``margin`` of its page."""
    return (middle() >= F.col("page_height") - margin * F.col("page_height")) | (middle() <= margin * F.col("page_height"))


def _filed(anchors: Column, value: Column, gap: Column | float) -> Column:
    """``anchors`` with ``value`` where it lies more than ``gap`` below the last of them."""
    return F.when((F.size(anchors) == 0) | (F.element_at(anchors, -1) - value > gap), F.array_append(anchors, value)).otherwise(anchors)


def running_heads(boxes: DataFrame, pages: DataFrame, margin: float = 0.12, least_pages: int = 5, least: int = 3, row: int = 8) -> DataFrame:
    """``doc_id, text, pages, longest``: texts of the outer margins that recur.

    In documents of at least ``least_pages`` pages, a text counts that stands in a
    margin on a fifth of them (``least`` at least) or on ``row`` in a row.
    """
    sized = pages.distinct().select(*PAGE, "page_height")
    at = boxes_of_pages(boxes).join(sized, list(PAGE)).where(in_margin(margin))
    single = at.select("doc_id", "text", "page_number").distinct()
    size = sized.groupBy("doc_id").agg(F.count_distinct("page_number").alias("n"))
    # Pages in a row share the difference of page number and rank.
    rank = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy("page_number"))
    runs = single.withColumn("island", F.col("page_number") - rank).groupBy("doc_id", "text", "island").agg(F.count("*").alias("length"))
    totals = runs.groupBy("doc_id", "text").agg(F.sum("length").alias("pages"), F.max("length").alias("longest"))
    kept = totals.join(size.where(F.col("n") >= least_pages), "doc_id")
    return kept.where((F.col("pages") >= F.greatest(F.lit(least), F.floor(F.col("n") / 5))) | (F.col("longest") >= row)).select("doc_id", "text", "pages", "longest")


def without_heads(boxes: DataFrame, pages: DataFrame, margin: float = 0.12, **rule) -> DataFrame:
    """The boxes without the running heads in their margins."""
    heads = running_heads(boxes, pages, margin, **rule).select("doc_id", "text")
    sized = boxes_of_pages(boxes).join(pages.distinct().select(*PAGE, "page_height"), list(PAGE))
    outer = in_margin(margin)
    inner = sized.where(~outer)
    return sized.where(outer).join(heads, ["doc_id", "text"], "left_anti").select(*inner.columns).unionByName(inner).drop("page_height")


def chrome(boxes: DataFrame) -> DataFrame:
    """Boxes whose text looks like a page's furniture."""
    return boxes_of_pages(boxes).where(is_chrome(F.col("text")))


def page_chrome(boxes: DataFrame, pages: DataFrame, band: float = 0.15, edge: float = 0.1, most_lines: int = 4, most_chars: int = 200, step: float = 3.0) -> DataFrame:
    """``doc_id, page_number, seq`` of the furniture of single pages, by place, distance and wording.

    In the upper and lower ``band`` of a page, boxes nearer to each other than the
    median type size are one group. A group goes where a line of it is worded as
    furniture (of more than ``most_lines`` half of them), it is at most half of the
    page's lines, has no box of over ``most_chars`` bytes, and the next line of the page
    lies a type size away. Of what is left, a page number that is outermost
    within ``edge`` goes too, on pages of more than two boxes. Pages without a height have none.
    """
    sized = once(boxes).join(pages.distinct().select(*PAGE, "page_height").where("page_height > 0"), list(PAGE))
    page = Window.partitionBy(*PAGE)
    size = F.when(F.col("font_size") > 0, F.col("font_size"))
    sizes = F.sort_array(F.collect_list(size).over(page))
    rows = sized.withColumn("need", F.when(F.size(sizes) > 0, F.element_at(sizes, F.floor(F.size(sizes) / 2).cast("int") + 1)).otherwise(10.0)).withColumn("boxes", F.count("*").over(page))
    tops = rows.groupBy(*PAGE).agg(F.reverse(F.sort_array(F.collect_list("y_top"))).alias("tops"))
    line_count = lambda a: F.size(F.aggregate(a, F.array().cast("array<double>"), lambda x, y: _filed(x, y, step)))
    rows = rows.join(tops.select(*PAGE, line_count(F.col("tops")).alias("page_lines")), list(PAGE))
    side = F.when(F.col("y_bottom") >= F.col("page_height") * (1 - band), "top").when(F.col("y_top") <= F.col("page_height") * band, "bottom")
    banded = rows.withColumn("side", side).withColumn("chrome", is_chrome(F.col("text")))
    down = Window.partitionBy(*PAGE, "side").orderBy(F.col("y_top").desc(), "x_left", "seq")
    edged = banded.where("side is not null and trim(text) <> ''").withColumn("new", F.coalesce((F.lag("y_bottom").over(down) - F.col("y_top") > F.col("need")).cast("int"), F.lit(1))).withColumn("g", F.sum("new").over(down))
    lines_ = F.reverse(F.sort_array(F.collect_list("y_top")))
    said = F.reverse(F.sort_array(F.collect_list(F.struct("y_top", "chrome"))))
    anchors_ = F.aggregate(F.col("tops"), F.array().cast("array<double>"), lambda x, y: _filed(x, y, step))
    # A line is worded as furniture where one of its boxes is.
    hits = F.size(F.filter(F.col("anchors"), lambda a: F.exists("said", lambda b: b["chrome"] & (b["y_top"] <= a) & (b["y_top"] >= a - step))))
    groups = edged.groupBy(*PAGE, "side", "g").agg(
        lines_.alias("tops"), said.alias("said"), F.min("y_bottom").alias("low"), F.max("y_top").alias("high"), F.max(F.octet_length(F.trim("text"))).alias("chars"), F.first("need").alias("need"), F.first("page_lines").alias("page_lines"), F.collect_list("seq").alias("seqs")
    ).withColumn("anchors", anchors_).withColumn("lines", F.size("anchors")).withColumn("hits", hits)
    fit = groups.where((F.col("hits") > 0) & ((F.col("lines") <= most_lines) | (F.col("hits") * 2 >= F.col("lines"))) & (F.col("lines") * 2 <= F.col("page_lines")) & (F.col("chars") <= most_chars))
    # The nearest box of the page on the text's side; groups are few, a page's boxes bound what meets.
    other = rows.select(*PAGE, F.col("seq").alias("other"), F.col("y_top").alias("t"), F.col("y_bottom").alias("b"))
    away = F.when(F.col("side") == "top", F.when(F.col("t") < F.col("low"), F.col("low") - F.col("t"))).otherwise(F.when(F.col("b") > F.col("high"), F.col("b") - F.col("high")))
    met = fit.join(other, list(PAGE), "left").where(F.col("other").isNull() | ~F.array_contains("seqs", F.col("other"))).groupBy(*PAGE, "side", "g").agg(F.min(away).alias("away"))
    alone = fit.join(met, [*PAGE, "side", "g"], "left").where(F.col("away").isNull() | (F.col("away") >= F.col("need")))
    gone = alone.select(*PAGE, F.explode("seqs").alias("seq")).distinct()
    left = rows.where("boxes > 2").join(gone, list(KEY), "left_anti")
    low = left.groupBy(*PAGE).agg(F.min_by(F.struct("seq", "text", F.col("y_bottom").alias("at"), "page_height"), F.struct("y_bottom", "seq")).alias("o")).select(*PAGE, "o.*").where(is_folio(F.col("text")) & (F.col("at") <= F.col("page_height") * edge)).select(*KEY)
    rest = left.join(low, list(KEY), "left_anti")
    high = rest.groupBy(*PAGE).agg(F.min_by(F.struct("seq", "text", F.col("y_top").alias("at"), "page_height"), F.struct(-F.col("y_top"), "seq")).alias("o")).select(*PAGE, "o.*").where(is_folio(F.col("text")) & (F.col("at") >= F.col("page_height") * (1 - edge))).select(*KEY)
    return gone.unionByName(low).unionByName(high)


def modal_size(boxes: DataFrame, least: float = 7.0) -> DataFrame:
    """``doc_id, page_number, body``: the commonest type size of each page to a tenth; of equals the one seen first.

    Sizes below ``least`` count only where the page has no other.
    """
    sizes = once(boxes).withColumn("size", F.round("font_size", 1)).where("size > 0")
    counts = sizes.groupBy(*PAGE, "size").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return counts.groupBy(*PAGE).agg(F.min_by("size", F.struct(F.col("size") < least, -F.col("n"), "first")).alias("body"))


def median_size(boxes: DataFrame) -> DataFrame:
    """``doc_id, page_number, median``: the upper median of each page's positive type sizes, from their counts."""
    counts = once(boxes).where("font_size > 0").groupBy(*PAGE, "font_size").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*PAGE)
    at = counts.withColumn("upto", F.sum("n").over(w.orderBy("font_size"))).withColumn("all", F.sum("n").over(w))
    return at.where(F.col("upto") > F.floor(F.col("all") / 2)).groupBy(*PAGE).agg(F.min("font_size").alias("median"))


def lines(boxes: DataFrame, band: float = 3.0, wide: float = 30.0) -> DataFrame:
    """``doc_id, page_number, line, text, top, font_size, is_bold, is_tabular``: boxes of one line, from the top.

    A line holds the boxes whose middle lies within ``band`` below that of its
    highest box; ``top`` is the middle of its first box. Lines with a space over ``wide``
    between neighbours are tabular.
    """
    rows = boxes_of_pages(boxes).withColumn("mid", middle())
    heights = rows.groupBy(*PAGE).agg(F.reverse(F.sort_array(F.collect_set("mid"))).alias("mids"))
    marks = heights.select(*PAGE, F.aggregate("mids", F.array().cast("array<double>"), lambda a, m: _filed(a, m, band)).alias("marks"))
    numbered = rows.join(marks, list(PAGE)).withColumn("line", F.size(F.filter("marks", lambda m: m >= F.col("mid"))).cast("bigint") - 1)
    across = Window.partitionBy(*PAGE, "line").orderBy("x_left", "seq")
    spaced = numbered.withColumn("space", F.col("x_left") - F.lag("x_right").over(across))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x_left", "seq", "text"))), lambda b: b["text"]), " ")
    tabular = F.coalesce(F.max("space") > wide, F.lit(False))
    return spaced.groupBy(*PAGE, "line").agg(text.alias("text"), F.min_by("mid", F.struct("x_left", "seq")).alias("top"), F.max("font_size").alias("font_size"), F.bool_or("is_bold").alias("is_bold"), tabular.alias("is_tabular"))


def headings(lines_: DataFrame, body: DataFrame) -> DataFrame:
    """``lines_`` with ``mark``, the heading mark that their type size earns beside the page's body, and ``body``; pages without one have no headings."""
    return lines_.join(body, list(PAGE), "left").withColumn("mark", heading_mark(F.col("font_size"), F.col("is_bold"), F.col("body")))


def merged_headings(marked: DataFrame) -> DataFrame:
    """``doc_id, page_number, heading, mark, text``: neighbouring lines of one mark within three body sizes (30 at least) of the first of them."""
    down = Window.partitionBy(*PAGE).orderBy("line")
    runs = marked.withColumn("new", F.coalesce((F.lag("mark").over(down) != F.col("mark")).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(down)).where("mark <> ''")
    listed = runs.groupBy(*PAGE, "run", "mark").agg(F.sort_array(F.collect_list(F.struct("line", "top", "text"))).alias("rows"), F.first("body").alias("body"))
    gap = F.greatest(3 * F.col("body"), F.lit(30.0))
    marks = F.aggregate(F.transform("rows", lambda r: r["top"]), F.array().cast("array<double>"), lambda a, t: _filed(a, t, gap))
    each = listed.withColumn("marks", marks).select(*PAGE, "mark", "marks", F.explode("rows").alias("r")).select(*PAGE, "mark", "r.*", F.element_at(F.filter("marks", lambda m: m >= F.col("r.top")), -1).alias("head"))
    first = each.withColumn("first", F.min("line").over(Window.partitionBy(*PAGE, "mark", "head")))
    return first.groupBy(*PAGE, F.col("first").alias("heading"), "mark").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), " ").alias("text"))


def page_text(lines_: DataFrame) -> DataFrame:
    """``doc_id, page_number, text``: the lines of each page in order."""
    return lines_.groupBy(*PAGE).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))


def foot_numbers(boxes: DataFrame, height: float = 120.0, last: int = 3) -> DataFrame:
    """Boxes that are their page's number among the last of the page, near its foot."""
    up = Window.partitionBy(*PAGE).orderBy("y_top", F.col("seq").desc())
    ranked = boxes_of_pages(boxes).withColumn("k", F.row_number().over(up))
    return ranked.where((F.col("k") <= last) & (F.col("y_top") <= height) & (F.regexp_replace("text", r"^[\s—-]+|[\s—-]+$", "") == F.col("page_number").cast("string"))).drop("k")


def words(items: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """``doc_id, page_number, word, text, x_left, x_right``: fragments of a line merged where gaps are small.

    The cap of a gap is 0.6 of the type size, kept between 6 and 14; a space shows
    from a tenth of the size. Fragments without a width end where they begin.
    """
    rows = items.distinct().withColumn("right", F.col("x") + F.coalesce("width", F.lit(0.0)))
    down = Window.partitionBy(*PAGE).orderBy(F.col("y").desc(), "x", "item_no")
    new_line = F.coalesce((F.lag("y").over(down) - F.col("y") > tolerance).cast("int"), F.lit(0))
    numbered = rows.withColumn("step", new_line).withColumn("line", F.sum("step").over(down))
    along = Window.partitionBy(*PAGE, "line").orderBy("x", "item_no")
    gap = F.col("x") - F.lag("right").over(along)
    cap = F.least(F.greatest(0.6 * F.col("font_size"), F.lit(6.0)), F.lit(14.0))
    cut = numbered.withColumn("gap", gap).withColumn("new", F.when(F.col("gap").isNull() | (F.col("gap") > cap), 1).otherwise(0))
    whole = Window.partitionBy(*PAGE).orderBy("line", "x", "item_no")
    grouped = cut.withColumn("word", F.sum("new").over(whole))
    piece = F.concat(F.when((F.col("new") == 0) & (F.col("gap") > 0.1 * F.col("font_size")), " ").otherwise(""), "text")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "item_no", piece.alias("piece")))), lambda p: p["piece"]), "")
    return grouped.groupBy(*PAGE, "word").agg(joined.alias("text"), F.min("x").alias("x_left"), F.max("right").alias("x_right"))


def islands(spans: DataFrame, keys: list[str], low: str, high: str, tolerance: float = 10.0) -> DataFrame:
    """``keys, island, low, high``: intervals that overlap or lie within ``tolerance`` of each other, merged."""
    w = Window.partitionBy(*keys).orderBy(low, high)
    before = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col(low) > before + tolerance), 1).otherwise(0)
    numbered = spans.withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.min(low).alias("low"), F.max(high).alias("high"))


def placed(items: DataFrame, boxes: DataFrame) -> DataFrame:
    """``doc_id, page_number, item_no, id``: the box of its page in which an item's start lies.

    A range join within the page: pages bound what meets.
    """
    i, b = items.distinct().alias("i"), once(boxes).alias("b")
    on = (F.col("i.doc_id") == F.col("b.doc_id")) & (F.col("i.page_number") == F.col("b.page_number")) & F.col("i.x").between(F.col("b.x_left"), F.col("b.x_right")) & F.col("i.y").between(F.col("b.y_bottom"), F.col("b.y_top"))
    return i.join(b, on).select("i.doc_id", "i.page_number", "i.item_no", "b.id").distinct()


def nearest(items: DataFrame, boxes: DataFrame) -> DataFrame:
    """``doc_id, page_number, item_no, id, distance``: for each item the box of its page nearest in height.

    Boxes above or below the item's place come before others; of equals the first
    in order wins.
    """
    i, b = items.distinct().alias("i"), once(boxes).alias("b")
    on = (F.col("i.doc_id") == F.col("b.doc_id")) & (F.col("i.page_number") == F.col("b.page_number"))
    far = F.round(F.greatest(F.col("b.y_bottom") - F.col("i.y"), F.col("i.y") - F.col("b.y_top"), F.lit(0.0)), 4)
    inside = F.col("i.x").between(F.col("b.x_left"), F.col("b.x_right"))
    met = i.join(b, on).select("i.doc_id", "i.page_number", "i.item_no", "b.id", far.alias("distance"), F.struct(~inside, far, F.col("b.seq")).alias("rank"))
    return met.groupBy("doc_id", "page_number", "item_no").agg(F.min_by(F.struct("id", "distance"), "rank").alias("best")).select("doc_id", "page_number", "item_no", "best.id", "best.distance")


def fill(cells: DataFrame, table: list[str], row: str, column: str, text: str, widest: int = 25) -> DataFrame:
    """``table, rows, columns, filled, repeated, is_diagram``: how full grids are, and whether they are drawings.

    ``repeated`` is the share of texts over three bytes that repeat, but no more than stand in
    several columns, where there are over two. Drawings are wider than ``widest`` or
    emptier than a quarter; sparse and repeating; wide and repeating; or wide and sparse.
    """
    trimmed = F.trim(F.col(text))
    texts = cells.where(trimmed != "").groupBy(*table, trimmed.alias("t")).agg(F.count("*").alias("n"), F.count_distinct(column).alias("columns_"))
    long = F.octet_length("t") > 3
    told = texts.groupBy(*table).agg(F.sum("n").alias("full"), F.sum(F.when(long, F.col("n"))).alias("said"), F.sum(F.when(long, F.col("n") - 1)).alias("again"), F.sum(F.when(long & (F.col("columns_") > 1), F.col("n"))).alias("across"))
    sizes = cells.groupBy(*table).agg(F.count_distinct(row).alias("rows"), F.count_distinct(column).alias("columns"))
    grid = sizes.join(told, table, "left").na.fill(0, ["full", "said", "again", "across"])
    filled = F.col("full") / (F.col("rows") * F.col("columns"))
    repeated = F.when(F.col("said") > 2, F.least("again", "across") / F.col("said")).otherwise(0.0)
    wide = F.col("columns") >= 6
    drawing = (F.col("columns") > widest) | (F.col("filled") < 0.25) | ((F.col("filled") < 0.5) & (F.col("repeated") > 0.3)) | (wide & ((F.col("repeated") > 0.4) | (F.col("filled") < 0.4)))
    return grid.withColumn("filled", filled).withColumn("repeated", repeated).withColumn("is_diagram", drawing).drop("full", "said", "again", "across")


def markdown_table(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """``keys, markdown``: the rows of each group as a Markdown table under a head of ``columns``."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n| " + " | ".join(["---"] * len(columns)) + " |\n"
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, line.alias("line")))), lambda r: r["line"]), "\n")
    return rows.groupBy(*keys).agg(F.concat(F.lit(head), body).alias("markdown"))


def sections(rows: DataFrame, keys: list[str], order: list[str], title: Column, body: Column) -> DataFrame:
    """``keys, markdown``: titled sections of each group in order, a blank line between."""
    part = F.concat(F.lit("## "), title, F.lit("\n\n"), body)
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, part.alias("part")))), lambda r: r["part"]), "\n\n").alias("markdown"))


def sized_regions(regions: DataFrame, width: Column, height: Column, order: str, least: int = 5000) -> DataFrame:
    """``regions`` of at least ``least`` whole square points with ``id``, their number on the page in order; those without a size are none."""
    size = F.floor(F.coalesce(width, F.lit(0.0))) * F.floor(F.coalesce(height, F.lit(0.0)))
    k = F.row_number().over(Window.partitionBy(*PAGE).orderBy(order)) - 1
    return regions.where(size >= least).withColumn("id", F.concat(F.lit("p"), F.col("page_number").cast("string"), F.lit("-i"), k.cast("string")))


def segments(boxes: DataFrame) -> DataFrame:
    """``doc_id, page_number, seq, x1, y1, x2, y2``: the lower edges of boxes, as ruling lines to work with where a table has none."""
    return once(boxes).select(*PAGE, "seq", F.col("x_left").alias("x1"), F.col("y_bottom").alias("y1"), F.col("x_right").alias("x2"), F.col("y_bottom").alias("y2"))


def classified(rules: DataFrame, slack: float = 0.8) -> DataFrame:
    """``rules`` with ``kind``: 'h' or 'v' for lines along an axis of some length, null for others."""
    w, h = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    return rules.withColumn("kind", F.when((h <= slack) & (w > slack), "h").when((w <= slack) & (h > slack), "v"))


def line_positions(rules: DataFrame, at: str, tolerance: float = 2.0) -> DataFrame:
    """``doc_id, page_number, position, rules``: places of parallel lines, those within ``tolerance`` of the one before merged."""
    w = Window.partitionBy(*PAGE).orderBy(at)
    new = F.coalesce((F.col(at) - F.lag(at).over(w) > tolerance).cast("int"), F.lit(1))
    numbered = rules.withColumn("new", new).withColumn("k", F.sum("new").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*PAGE, "k").agg(F.min(at).alias("position"), F.count("*").alias("rules")).drop("k")


def overlapping(rules: DataFrame, groups: DataFrame, margin: float = 10.0) -> DataFrame:
    """``doc_id, page_number, seq, group``: the groups (left, right, bottom, top) whose extent, widened by ``margin``, a line meets.

    An overlap join in both axes within the page.
    """
    r, g = rules.alias("r"), groups.alias("g")
    on = (
        (F.col("r.doc_id") == F.col("g.doc_id"))
        & (F.col("r.page_number") == F.col("g.page_number"))
        & (F.greatest("r.x1", "r.x2") >= F.col("g.left") - margin)
        & (F.least("r.x1", "r.x2") <= F.col("g.right") + margin)
        & (F.greatest("r.y1", "r.y2") >= F.col("g.bottom") - margin)
        & (F.least("r.y1", "r.y2") <= F.col("g.top") + margin)
    )
    return r.join(g, on).select("r.doc_id", "r.page_number", "r.seq", "g.group").distinct()


def pruned(cells: DataFrame, table: list[str], row: str, column: str, text: str) -> DataFrame:
    """The cells of grids without empty rows and columns, numbered anew in order."""
    full = F.trim(F.coalesce(F.col(text), F.lit(""))) != ""
    rows = cells.where(full).select(*table, row).distinct().withColumn("r", F.row_number().over(Window.partitionBy(*table).orderBy(row)) - 1)
    columns = cells.where(full).select(*table, column).distinct().withColumn("c", F.row_number().over(Window.partitionBy(*table).orderBy(column)) - 1)
    return cells.join(rows, [*table, row]).join(columns, [*table, column]).select(*table, "r", "c", text)


#: What ends a sentence, or a bracket, at the end of a line.
ENDED = r"[.!?…)\]]\s*$"


def paragraphs(marked: DataFrame, least: int = 25) -> DataFrame:
    """``doc_id, page_number, paragraph, text``: wrapped lines of body text joined; headings and tabular lines stand alone.

    A line goes on what lies at most two body sizes above it, does not end a
    sentence, and has more than ``least`` UTF-16 units. What is joined has them, so that a line
    goes on where, since the last that could not, one before it is so long.
    """
    down = Window.partitionBy(*PAGE).orderBy("line")
    before = lambda c: F.lag(c).over(down)
    plain = (F.col("mark") == "") & ~F.col("is_tabular")
    gap = before("top") - F.col("top")
    rows = marked.withColumn("plain", plain).withColumn("long", utf16_units(F.col("text")) > least).withColumn("end", F.col("text").rlike(ENDED))
    may = F.col("plain") & before("plain") & ~before("end") & (gap > 0) & (gap <= 2 * F.col("body"))
    rows = rows.withColumn("may", F.coalesce(may, F.lit(False))).withColumn("was", before("long")).withColumn("run", F.sum((~F.col("may")).cast("int")).over(down))
    grown = F.max(F.col("was") & F.col("may")).over(Window.partitionBy(*PAGE, "run").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("paragraph", F.sum((~(F.col("may") & F.coalesce(grown, F.lit(False)))).cast("int")).over(down).cast("bigint") - 1)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"])
    listed = rows.groupBy(*PAGE, "paragraph").agg(parts.alias("parts"), F.min_by("mark", "line").alias("mark"))
    whole = F.aggregate(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), F.element_at("parts", 1), wrapped)
    return listed.select(*PAGE, "paragraph", F.concat("mark", whole).alias("text"))


def wrapped(done: Column, line: Column) -> Column:
    """A line joined to a paragraph; a hyphen behind a letter goes where the line begins in lower case, and stays without a space in compounds."""
    broken = done.rlike(r"[\p{L}\p{Nl}]-$") & line.rlike(r"^\p{Ll}")
    compound = done.rlike(r"-[^\s]*-$")
    return F.when(~broken, F.concat(done, F.lit(" "), line)).when(compound, F.concat(done, line)).otherwise(F.concat(F.regexp_replace(done, "-$", ""), line))
