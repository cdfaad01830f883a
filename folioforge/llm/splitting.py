"""Problem 7: cut oversized texts at natural boundaries, with a fixed overlap.

Balanced targets: the least number of pieces is computed first, equal-length
targets are placed, each target is snapped to the strongest boundary nearby, and
one more piece is tried whenever a limit fails.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 6000, 200
#: Boundaries from the strongest to the weakest; a cut falls behind the match.
BOUNDARIES = (
    re.compile(r"\n[ \t]*\n+(?=#)"),
    re.compile(r"\n[ \t]*\n+"),
    re.compile(r"\n"),
    re.compile(r"[.!?…][\"'”’»)\]]*\s+|[。！？]"),
    re.compile(r"[;:,]\s+"),
    re.compile(r"\s+"),
)
#: The share of a piece's length, to either side of its target, searched for a boundary.
REACH = 0.25


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """Ends of the pieces of ``text``; the next piece starts ``overlap`` before an end.

    A text within the limit is one piece, the empty text none. Raises ValueError
    unless ``0 <= overlap < limit``.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must lie between 0 and the limit")
    size, step = len(text), limit - overlap
    if size <= limit:
        return [size] if size else []
    pieces = -(-(size - overlap) // step)
    while True:
        found = _place(text, size, pieces, limit, overlap)
        if found:
            return found
        pieces += 1


def _place(text: str, size: int, pieces: int, limit: int, overlap: int) -> list[int] | None:
    ends: list[int] = []
    share = (size - overlap) / pieces
    for k in range(1, pieces):
        start = ends[-1] - overlap if ends else 0
        target = round(overlap + k * share)
        # Never beyond the limit, nor so early that the rest no longer fits.
        high = min(start + limit, size - 1)
        rest = size - (pieces - k) * (limit - overlap)
        low = max(start + overlap + 1, rest)
        if low > high:
            return None
        ends.append(_snap(text, min(max(target, low), high), low, high, int(share * REACH)))
    return [*ends, size] if size - (ends[-1] - overlap) <= limit else None


def _snap(text: str, target: int, low: int, high: int, reach: int) -> int:
    low, high = max(low, target - reach), min(high, target + reach)
    for rule in BOUNDARIES:
        # A match may begin before the range, as long as the cut behind it lies within.
        ends = [m.end() for m in rule.finditer(text, max(0, low - 8), min(len(text), high + 1)) if low <= m.end() <= high]
        if ends:
            return min(ends, key=lambda e: (abs(e - target), e))
    # Inside one unbroken run: keep combining marks with their letter.
    while target > low and text[target : target + 1] and 0x300 <= ord(text[target]) <= 0x36F:
        target -= 1
    return target


def split(df: DataFrame, key: str = "doc_id", text: str = "markdown", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every text longer than ``limit`` characters (code points).

    Returns ``key, piece_no, pieces, start, end, piece``; other columns are left
    out, so clashing names cannot matter. Null and empty texts and texts within
    the limit give no rows. Repeated rows give repeated pieces. Narrow: no
    shuffle, the length filter runs in the JVM, so short texts never reach Python.
    """
    source = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.length("text") > limit)
    out = pa.schema([("piece_no", pa.int32()), ("pieces", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("piece", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = [], batch.column("text").to_pylist()
            for at, whole in enumerate(texts):
                ends = cuts(whole, limit, overlap)
                for k, end in enumerate(ends):
                    start = ends[k - 1] - overlap if k else 0
                    rows.append((at, k, len(ends), start, end, whole[start:end]))
            columns = list(zip(*rows)) if rows else [()] * 6
            keys = batch.column("key").take(pa.array(columns[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, f.type) for c, f in zip(columns[1:], out))], names=["key", *out.names])

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, piece_no int, pieces int, start bigint, end bigint, piece string").withColumnRenamed("key", key)
