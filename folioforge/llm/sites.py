"""What recurs on the pages of a site: line keys and counts by host, shared by problems 1 and 3."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.lookalikes import LETTERS, UNSEEN

FOLD = {ord(a): b for a, b in LETTERS}
FOLD |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
FOLD |= {ord(c): None for c in UNSEEN} | dict.fromkeys([0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
FOLD |= dict.fromkeys([0x00A0, 0x2007, 0x2009, 0x202F, 0x3000, *range(0x2000, 0x200B)], " ")
TARGET = re.compile(r"\]\([^)\s]*\)")
BEYOND = re.compile(r"[^\x00-\x7f]+")
DIGITS = re.compile(r"\d+")


def folded(line: str) -> str:
    """``line`` with look-alike letters, odd spaces and invisible signs brought to plain ones."""
    return line if line.isascii() else unicodedata.normalize("NFC", line.translate(FOLD))


def slices(batches, rows: int = 1000):
    """Batches in slices, so that no more texts than that are Python strings at a time."""
    for batch in batches:
        for at in range(0, max(batch.num_rows, 1), rows):
            yield batch.slice(at, rows)


class Memo(dict):
    """What a function gave for each argument, forgotten when it grows beyond a bound."""

    def __init__(self, function, bound: int = 50_000):
        super().__init__()
        self.function, self.bound = function, bound

    def __missing__(self, x):
        if len(self) >= self.bound:
            self.clear()
        value = self[x] = self.function(x)
        return value


#: What words with signs beyond ASCII become; neither folds nor runs of such signs reach over a space.
BONES = Memo(lambda word: word if word.isascii() else BEYOND.sub("*", folded(word)))


def skeleton(line: str) -> str:
    """Lower case, with each run of non-ASCII characters as one star: garbled and clean spellings agree."""
    return line.lower() if line.isascii() else " ".join([w if w.isascii() else BONES[w] for w in line.split(" ")]).lower()


def key_of(bones: str) -> int:
    """The key of a line from its skeleton without link targets."""
    bones = bones if bones.startswith("#") else DIGITS.sub("0", bones)
    return xxhash.xxh3_64_intdigest(bones.strip("#*_+-•>: \t\r")) - (1 << 63)


def line_key(line: str) -> int:
    """A 64-bit key under which lines count as the same: no link targets, any case, any mark-up around them, and any figures but in headings."""
    return key_of(skeleton(TARGET.sub("]", line) if "](" in line else line))


def host(url: str | F.Column):
    """The host of a URL column, in lower case; null where there is none."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit("")))


def recurring(pages: DataFrame, sizes: DataFrame, least: int = 3, share: float = 0.1) -> DataFrame:
    """``host, recurring``: keys of the lines on at least ``least`` pages and ``share`` of a host's pages.

    ``pages`` has ``host``, ``markdown`` and ``text``, a hash of the markdown, one row
    for each distinct text of a host: copies of an article do not make its lines
    recur; ``sizes`` has ``host, pages``, their number. Repeats of a row that lie in one partition count once. The counts are summed
    before the shuffle, and a host's list is bounded by its lines a page over ``share``.
    """

    def run(batches):
        met: set[tuple[str, int]] = set()
        for batch in slices(batches):
            seen: dict[tuple[str, int], int] = {}
            for h, text, mark in zip(*(batch.column(c).to_pylist() for c in ("host", "markdown", "text"))):
                if (h, mark) in met:
                    continue
                met.add((h, mark))
                for k in {line_key(x) for x in text.split("\n") if x and not x.isspace()}:
                    seen[h, k] = seen.get((h, k), 0) + 1
            hosts, keys = zip(*seen) if seen else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["host", "line", "n"])

    # Lines of one page only, by far the most, end at the having; pages without a host have no furniture.
    lines = pages.where("host is not null and markdown is not null").select("host", "markdown", "text").mapInArrow(run, "host string, line bigint, n bigint")
    counts = lines.groupBy("host", "line").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return counts.join(sizes, "host").where(F.col("n") >= share * F.col("pages")).groupBy("host").agg(F.collect_set("line").alias("recurring"))
