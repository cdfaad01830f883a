"""Problem 10: long exact spans shared between records.

Difference-cover anchors: windows are hashed only where their place in the text,
modulo a period, lies in a difference cover. Any two places then have a common
shift below the period that puts both on the cover, so any long match shares an
aligned anchor. The spans around shared anchors are then extended to the full
length and compared again.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.packed import BLOCK_BYTES, BUCKET_BYTES, PACKED, Hashes, blocks, laid_out, opened, prefix, repeated, windows

SPAN = 200


def cover(period: int) -> np.ndarray:
    """A small difference cover: its pairwise differences meet every residue.

    Places 0..s-1 give the short differences and every s-th place the long ones,
    with s about the square root of half the period; greedy removal then thins it.
    """
    s = max(1, math.isqrt(period // 2))
    places = sorted({i % period for i in [*range(s), *range(s, period, s), period - s]})
    full = lambda d: len({(a - b) % period for a in d for b in d}) == period
    for x in sorted(places, key=lambda p: (-p)):
        less = [p for p in places if p != x]
        if full(less):
            places = less
    if not full(places):
        raise ValueError(f"no cover for period {period}")
    return np.array(places, np.int64)


#: A perfect difference set modulo 73 (a projective plane of order 8): every residue is a difference exactly once.
PERIOD, COVER = 73, np.array([0, 1, 3, 7, 15, 31, 36, 54, 63], np.int64)


def _anchors(block, span: int, period: int, places: np.ndarray):
    """(hash, document, text, place) of every window that starts on the cover."""
    width, got, ladder = span - period + 1, [], np.zeros(0, np.int64)
    for first, codes, starts, ends in block.chunks():
        room = ends - starts - width
        if len(room) and room.max() >= len(ladder) // len(places) * period:
            turns = int(room.max()) // period + 1
            ladder = (np.arange(turns)[:, None] * period + np.sort(places)).ravel()
        counts = np.searchsorted(ladder, room, side="right")
        place = np.concatenate([ladder[:n] for n in counts])
        text = np.repeat(np.arange(len(starts)), counts)
        got.append((windows(prefix(codes), starts[text] + place, width), block.number[first + text], first + text, place))
    return _joined(got)


def _joined(got):
    kinds = (np.uint64, np.int64, np.int64, np.int64)
    return tuple(np.concatenate([g[k] for g in got]) if got else np.zeros(0, kinds[k]) for k in range(4))


def _extended(block, span: int, period: int, text: np.ndarray, place: np.ndarray):
    """(hash, document, text, start) of every window of the full length around the given anchors."""
    got, order = [], np.lexsort((place, text))
    text, place = text[order], place[order]
    for first, codes, starts, ends in block.chunks():
        mine = slice(*np.searchsorted(text, [first, first + len(starts)]))
        local = text[mine] - first
        low = np.maximum(starts[local] + place[mine] - period + 1, starts[local])
        high = np.minimum(starts[local] + place[mine], ends[local] - span)
        keep = low <= high
        marks = np.zeros(len(codes) + 1, np.int64)
        np.add.at(marks, low[keep], 1)
        np.add.at(marks, high[keep] + 1, -1)
        at = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
        if not len(at):
            continue
        owner = np.searchsorted(ends, at, side="right")
        got.append((windows(prefix(codes), at, span), block.number[first + owner], first + owner, at - starts[owner]))
    return _joined(got)


def shared(df: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, period: int = PERIOD, places: np.ndarray | None = None, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """How much of every text stands, character for character, in another record.

    Returns one row for each text of at least ``span`` characters that shares a
    span: ``key`` (as its own type), ``n_chars``, ``shared_chars`` (characters
    inside at least one shared span of ``span`` or more), ``spans`` (maximal
    runs of such characters). Texts that share nothing, and null, empty or
    shorter ones, give no row: they share 0 characters. Rows with equal keys are
    one record, so a row repeated under its own key shares nothing by that; a null
    key is a record of its own. Other columns are ignored.

    Work grows in proportion to the text: hashes travel packed, once for each
    block that has them, and no pairs are built. Blocks have about ``block_bytes`` of
    text and buckets the hashes of about ``bucket_bytes``, whatever the number of
    texts; a key that alone holds more is spread over blocks of its own.

    Windows are compared by hashes, not by their text: hashes have 28 bits more than
    the number of all bytes (64 at most), so that a window that no other record has
    is taken for a shared one with a chance below 1 in 2**28.
    """
    places = np.asarray(places if places is not None else COVER if period == PERIOD else cover(period))
    if not 1 <= period <= span:
        raise ValueError("the period must lie between 1 and the span")
    kind = df.schema[key].dataType.simpleString()
    layout = laid_out(df, key, text, span, block_bytes, bucket_bytes)
    texts = blocks(df, key, text, layout, span)

    def first(rows: pa.Table) -> pa.Table:
        block = opened(rows)
        h, doc, _, _ = _anchors(block, span, period, places)
        return Hashes(block, h, doc, layout, 1).rows()

    def replies(rows: pa.Table, stage: int) -> dict[int, bytes]:
        mine = rows.filter(pa.compute.equal(rows.column("stage"), stage))
        return dict(zip(mine.column("bucket").to_pylist(), mine.column("bits").to_pylist()))

    def candidates(rows: pa.Table, answers: pa.Table):
        block = opened(rows)
        h, doc, at_text, place = _anchors(block, span, period, places)
        hit = Hashes(block, h, doc, layout, 1).shared(replies(answers, 1))
        return block, _extended(block, span, period, at_text[hit], place[hit])

    def second(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary()), ("owners", pa.binary())]).empty_table()
        block, (h, doc, _, _) = candidates(rows, answers)
        return Hashes(block, h, doc, layout, 2).rows()

    def last(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = {"key": [], "n_chars": [], "shared_chars": [], "spans": []}
        if rows.num_rows:
            block, (h, doc, at_text, start) = candidates(rows, answers)
            hit = Hashes(block, h, doc, layout, 2).shared(replies(answers, 2))
            at_text, start = at_text[hit], start[hit]
            fresh, added = np.ones(len(at_text), bool), np.full(len(at_text), span, np.int64)
            step = np.diff(start)
            inside = (at_text[1:] == at_text[:-1]) & (step <= span)
            fresh[1:] = ~inside
            added[1:][inside] = step[inside]
            heads = np.flatnonzero(np.concatenate([[True], at_text[1:] != at_text[:-1]])) if len(at_text) else np.zeros(0, np.int64)
            if len(heads):
                mine = at_text[heads].tolist()
                out = {"key": [block.ids[t] for t in mine], "n_chars": [len(block.texts[t]) for t in mine], "shared_chars": np.add.reduceat(added, heads), "spans": np.add.reduceat(fresh.astype(np.int64), heads)}
        return pa.table({"key": pa.array(out["key"], pa.string()), **{c: pa.array(out[c], pa.int64()) for c in list(out)[1:]}})

    one = repeated(texts.groupBy("block").applyInArrow(first, PACKED), layout).withColumn("stage", F.lit(1))
    two = texts.groupBy("block").cogroup(one.repartitionById(layout.last, "block").groupBy("block")).applyInArrow(second, PACKED)
    answers = one.unionByName(repeated(two, layout).withColumn("stage", F.lit(2))).repartitionById(layout.last, "block")
    found = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(last, "key string, n_chars bigint, shared_chars bigint, spans bigint")
    return found.select(F.col("key").cast(kind).alias(key), "n_chars", "shared_chars", "spans")
