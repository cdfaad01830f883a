"""Tables of ruled pages as relations: rays, bridges between level lines, groups of lines, tables with level rules only.

``rules`` have doc_id, page_number, x1, y1, x2, y2; a rule is level or upright where its
ends differ by at most SLACK along the other axis. All work is done within pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.operators.layout import PAGE, _filed, islands, middle, once

SLACK = 0.8
#: How far a chain of upright rules may have gaps, and miss the lines it bridges.
CHAIN = 1.5


def uprights(boxes: DataFrame) -> DataFrame:
    """``doc_id, page_number, seq, x1, y1, x2, y2``: the left edges of boxes, as upright rules to work with where a table has none."""
    return once(boxes).select(*PAGE, "seq", F.col("x_left").alias("x1"), F.col("y_bottom").alias("y1"), F.col("x_left").alias("x2"), F.col("y_top").alias("y2"))


def rays(boxes: DataFrame, rules: DataFrame) -> DataFrame:
    """``doc_id, page_number, seq, up, down, left, right``: in which directions a ray from a box's centre meets a rule of its page.

    Rules through the centre count for both of their directions; boxes that meet none
    have no row.
    """
    b = once(boxes).select(*PAGE, "seq", ((F.col("x_left") + F.col("x_right")) / 2).alias("cx"), middle().alias("cy"))
    low_x, high_x, low_y, high_y = F.least("x1", "x2"), F.greatest("x1", "x2"), F.least("y1", "y2"), F.greatest("y1", "y2")
    level, upright = F.abs(F.col("y1") - F.col("y2")) <= SLACK, F.abs(F.col("x1") - F.col("x2")) <= SLACK
    kinds = rules.select(*PAGE, level.alias("is_h"), upright.alias("is_v"), low_x.alias("lx"), high_x.alias("hx"), low_y.alias("ly"), high_y.alias("hy"), F.col("x1").alias("x"), F.col("y1").alias("y")).where("is_h or is_v").distinct()
    across, beside = F.col("is_h") & F.col("cx").between(F.col("lx"), F.col("hx")), F.col("is_v") & F.col("cy").between(F.col("ly"), F.col("hy"))
    met = b.join(kinds, list(PAGE)).where(across | beside)
    hits = {"up": across & (F.col("y") >= F.col("cy")), "down": across & (F.col("y") <= F.col("cy")), "left": beside & (F.col("x") <= F.col("cx")), "right": beside & (F.col("x") >= F.col("cx"))}
    return met.groupBy(*PAGE, "seq").agg(*(F.bool_or(c).alias(n) for n, c in hits.items()))


def bridges(levels: DataFrame, rules: DataFrame) -> DataFrame:
    """``doc_id, page_number, upper, lower, columns, outer``: neighbouring level lines, and at how many places upright rules lead from one to the other.

    ``levels`` has doc_id, page_number, y. Upright rules at one place, to a point, are chained where
    gaps are small, and a chain must reach both lines. ``outer`` says that they
    all stand at the outermost places of the page. Pairs without a bridge have 0 columns.
    """
    down = Window.partitionBy(*PAGE).orderBy(F.col("y").desc())
    pairs = levels.select(*PAGE, "y").distinct().select(*PAGE, F.lag("y").over(down).alias("upper"), F.col("y").alias("lower")).where("upper is not null")
    walls = rules.where(F.abs(F.col("x1") - F.col("x2")) <= SLACK).select(*PAGE, F.floor(F.col("x1") + 0.5).alias("x"), F.least("y1", "y2").alias("low_y"), F.greatest("y1", "y2").alias("high_y")).distinct()
    chains = islands(walls, [*PAGE, "x"], "low_y", "high_y", CHAIN).select(*PAGE, "x", "low", "high")
    ends = walls.groupBy(*PAGE).agg(F.min("x").alias("first"), F.max("x").alias("last"))
    met = pairs.join(chains, list(PAGE)).where((F.col("low") <= F.col("lower") + CHAIN) & (F.col("high") >= F.col("upper") - CHAIN)).join(ends, list(PAGE))
    edge = (F.col("x") - F.col("first") <= CHAIN) | (F.col("last") - F.col("x") <= CHAIN)
    counts = met.groupBy(*PAGE, "upper", "lower").agg(F.count_distinct("x").alias("columns"), F.bool_and(edge).alias("outer"))
    return pairs.join(counts, [*PAGE, "upper", "lower"], "left").na.fill(0, ["columns"]).withColumn("outer", F.coalesce("outer", F.lit(True)))


def line_groups(levels: DataFrame, rules: DataFrame, rich: int = 3) -> DataFrame:
    """``doc_id, page_number, group, y``: the level lines of each table.

    A group ends where no upright rule leads to the next line. Where at least
    ``rich`` places lead to a line and fewer from it, not only the page's outermost ones,
    the line ends one group and begins the next: it is in both.
    """
    met = bridges(levels, rules)
    down = Window.partitionBy(*PAGE).orderBy(F.col("lower").desc())
    before = F.coalesce(F.lag("columns").over(down), F.lit(0))
    parted = F.when(F.col("columns") == 0, "gone").when((before >= rich) & (F.col("columns") < rich) & ~F.col("outer"), "shared")
    rows = met.withColumn("parted", parted).withColumn("group", F.sum(F.col("parted").isNotNull().cast("int")).over(down).cast("bigint"))
    first = levels.groupBy(*PAGE).agg(F.max("y").alias("y")).select(*PAGE, F.lit(0).cast("bigint").alias("group"), "y")
    own = rows.select(*PAGE, "group", F.col("lower").alias("y"))
    twice = rows.where("parted = 'shared'").select(*PAGE, "group", F.col("upper").alias("y"))
    return first.unionByName(own).unionByName(twice)


def level_tables(frames: DataFrame, boxes: DataFrame, near: float = 30.0, gap: float = 20.0, band: float = 8.0, spread: float = 50.0) -> DataFrame:
    """``doc_id, page_number, frame, row, column, text``: cells of tables that have level rules only.

    ``frames`` has doc_id, page_number, frame, x_min, x_max, y_min, y_max. A frame holds the boxes whose middle
    lies between its lines, ``near`` to its sides, and those that go on below it in steps of
    at most ``near``. Columns part where centres lie ``gap`` apart, rows gather the
    boxes ``band`` below their first. Frames whose left edges span less than ``spread`` are no tables.
    """
    b = once(boxes).select(*PAGE, "seq", "text", "x_left", "x_right", ((F.col("x_left") + F.col("x_right")) / 2).alias("cx"), middle().alias("cy"))
    key = [*PAGE, "frame"]
    met = frames.join(b, list(PAGE))
    inside = (F.col("x_left") >= F.col("x_min") - near) & (F.col("x_right") <= F.col("x_max") + near) & F.col("cy").between(F.col("y_min"), F.col("y_max"))
    below = F.col("cx").between(F.col("x_min"), F.col("x_max")) & (F.col("cy") < F.col("y_min"))
    down = Window.partitionBy(*key).orderBy(F.col("cy").desc(), "x_left", "seq")
    step = F.coalesce(F.lag("cy").over(down), F.col("y_min")) - F.col("cy") > near
    more = met.where(below).withColumn("far", F.sum(step.cast("int")).over(down)).where("far = 0").drop("far")
    held = met.where(inside).unionByName(more)
    sizes = held.groupBy(*key).agg(F.sort_array(F.collect_list("cx")).alias("centres"), F.reverse(F.sort_array(F.collect_set("cy"))).alias("heights"), (F.max("x_left") - F.min("x_left")).alias("wide")).where(F.col("wide") >= spread)
    # Between neighbouring centres that lie far apart there is a border; rows are marked by their first box.
    borders = F.filter(F.transform(F.sequence(F.lit(1), F.size("centres") - 1), lambda i: F.when(F.col("centres")[i] - F.col("centres")[i - 1] >= gap, (F.col("centres")[i] + F.col("centres")[i - 1]) / 2)), lambda x: x.isNotNull())
    marks = F.aggregate("heights", F.array().cast("array<double>"), lambda a, y: _filed(a, y, band))
    grid = sizes.select(*key, F.when(F.size("centres") > 1, borders).otherwise(F.array().cast("array<double>")).alias("borders"), marks.alias("marks"))
    placed = held.join(grid, key).where(F.col("cx").between(F.col("x_min"), F.col("x_max")))
    row = F.size(F.filter("marks", lambda m: m >= F.col("cy"))) - 1
    column = F.size(F.filter("borders", lambda x: x < F.col("cx")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x_left", "seq", "text"))), lambda x: x["text"]), " ")
    return placed.withColumn("row", row).withColumn("column", column).groupBy(*key, "row", "column").agg(text.alias("text"))
