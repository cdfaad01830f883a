"""Problem 2: one form for text that looks the same.

Look-alike classes are the components of a union-find over strings and code
points: Unicode's own equivalences (composed and combining accents, width
variants, ligatures), all spaces, all invisible characters, and the look-alike
letters below. The most frequent member over the whole corpus represents its
class, and texts are rewritten greedily, longest pattern first, by a
multi-pattern automaton.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.runtime import cut

# Letters that most typefaces draw alike, Cyrillic, Greek, Armenian or Cherokee first, Latin second.
LETTERS = (
    "аa еe оo рp сc уy хx іi јj ѕs һh ԁd ԛq ԝw ѵv ӏl "
    "АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ІI ЈJ ЅS ԜW ԚQ "
    "οo νv ρp αa ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ɡg кĸ Ьb օo ոn ԛq ᎥI ᎪA ᏟC ᎬE ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᎢT ᏙV ᏃZ"
).split()
# Signs drawn alike.
SIGNS = (("‐", "-"), ("‑", "-"), ("‒", "–"), ("−", "–"), ("µ", "μ"), ("ʼ", "’"), ("ʹ", "'"), ("′", "'"))
#: Compatibility forms that look like what they stand for: wide, narrow and styled letters and figures, ligatures, roman numerals.
ALIKE = ("<wide>", "<narrow>", "<font>")
#: Code points that show nothing, beside all of category Cf.
UNSEEN = frozenset(map(chr, [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]))


#: Slots over which the pairs of a class are spread.
SPREAD = 8


class Classes:
    """Union-find over strings."""

    def __init__(self):
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while (up := self.parent.setdefault(root, root)) != root:
            root = up
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def join(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in list(self.parent):
            out.setdefault(self.find(x), []).append(x)
        return out


def unseen(c: str) -> bool:
    return c in UNSEEN or unicodedata.category(c) == "Cf"


def space(c: str) -> bool:
    return c == "\t" or unicodedata.category(c) == "Zs"


def rewriting(counts: dict[str, int]) -> dict[str, str]:
    """Pattern -> representative, for the code points that occur.

    ``counts`` holds how often each code point occurs in all texts. Classes are
    transitive: a Cyrillic letter with a combining accent, its composed form, and
    the Latin letter with the same accent fall together.
    """
    classes = Classes()
    letters: dict[str, str] = {}
    for a, b in [*LETTERS, *SIGNS]:
        classes.join(a, b)
        letters[a] = b
    marks = [c for c in counts if unicodedata.combining(c)]
    for c in counts:
        if unseen(c):
            classes.join("", c)
        elif space(c):
            classes.join(" ", c)
        else:
            kind = unicodedata.decomposition(c)
            parts = unicodedata.normalize("NFD", c)
            if kind.startswith(ALIKE) or 0xFB00 <= ord(c) <= 0xFB06 or 0x2160 <= ord(c) <= 0x217F:
                parts = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", c))
                classes.join(c, unicodedata.normalize("NFC", parts))
            if parts != c:
                classes.join(c, parts)
                base = "".join(letters.get(x, x) for x in parts)
                classes.join(parts, base)
                classes.join(base, unicodedata.normalize("NFC", base))
            if not unicodedata.combining(c) and unicodedata.category(c)[0] == "L":
                for mark in marks:
                    whole = unicodedata.normalize("NFC", letters.get(c, c) + mark)
                    if len(whole) == 1:
                        classes.join(c + mark, letters.get(c, c) + mark)
                        classes.join(letters.get(c, c) + mark, whole)
    out: dict[str, str] = {}
    for members in classes.members().values():
        if "" in members:
            best = ""
        elif " " in members:
            best = " "
        else:
            # The most frequent, a string at most as its rarest sign; of equals the shortest, then the least.
            best = min(members, key=lambda m: (-min(counts.get(c, 0) for c in m), len(m), m))
        out |= {m: best for m in members if m and m != best}
    return out


class Rewriter:
    """Greedy rewriting by an automaton over all patterns; built once for each worker process."""

    def __init__(self, table: dict[str, str]):
        self.table = table
        self.automaton = ahocorasick.Automaton()
        for pattern, best in table.items():
            self.automaton.add_word(pattern, (len(pattern), best))
        if table:
            self.automaton.make_automaton()
        odd = {p for p in table if len(p) == 1} | {p[-1] for p in table}
        self.odd = re.compile("[" + "".join(map(re.escape, sorted(odd))) + "]") if odd else None

    def __call__(self, text: str) -> str:
        """The text's one form; rewriting repeats until nothing changes, since a removed sign can join two others."""
        while self.odd is not None and self.odd.search(text):
            parts, at = [], 0
            for end, (size, best) in self.automaton.iter_long(text):
                parts += (text[at : end - size + 1], best)
                at = end + 1
            new = "".join([*parts, text[at:]])
            if new == text:
                break
            text = new
        return text


def code_points(df: DataFrame, columns: Iterable[str]) -> dict[str, int]:
    """How often each code point occurs in ``columns``, over all rows: at most one entry for each of Unicode's code points."""

    def count(batches):
        total = np.zeros(0x110000, np.int64)
        for batch in batches:
            for column in batch.columns:
                for at in range(0, len(column), 2000):
                    joined = "".join(x for x in column.slice(at, 2000).to_pylist() if x)
                    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
                    found = np.bincount(codes)
                    total[: len(found)] += found
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["cp", "n"])

    rows = df.select(*columns).mapInArrow(count, "cp int, n bigint").groupBy("cp").agg(F.sum("n").alias("n")).collect()
    return {chr(r.cp): r.n for r in rows}


def one_form(df: DataFrame, text: str, table: dict[str, str], out: str = "one_form") -> DataFrame:
    """``df`` with the one form of ``text`` as ``out``; null stays null, all columns and rows are kept."""
    rewriter: list[Rewriter] = []

    @F.pandas_udf("string")
    def rewrite(values):
        if not rewriter:
            rewriter.append(Rewriter(table))
        return values.map(rewriter[0], na_action="ignore")

    return df.withColumn(out, rewrite(F.col(text)))


def _prints(df: DataFrame, table: dict[str, str], text: str) -> DataFrame:
    """``scope, key, form (16 bytes), raw (bigint)`` of each row with a text."""
    kept: list[Rewriter] = []

    def run(batches):
        if not kept:
            kept.append(Rewriter(table))
        for batch in batches:
            form, raw = [], []
            for t in batch.column("text").to_pylist():
                form.append(xxhash.xxh3_128_digest(kept[0](t).encode("utf-8", "surrogatepass")))
                raw.append(xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63))
            yield pa.RecordBatch.from_arrays([batch.column("scope"), batch.column("key"), pa.array(form, pa.binary()), pa.array(raw, pa.int64())], names=["scope", "key", "form", "raw"])

    return df.select("scope", "key", F.col(text).alias("text")).where("text is not null").mapInArrow(run, "scope string, key string, form binary, raw bigint")


def _mixed(df: DataFrame, table: dict[str, str], key: str, text: str, scope: str | None) -> DataFrame:
    """``key, raw, g1, g2`` of the distinct rows whose class holds two different texts at least."""
    rows = df.select((F.col(scope).cast("string") if scope else F.lit("")).alias("scope"), F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    # Read twice, and far smaller than the texts: written once, so that no text is rewritten again.
    prints = cut(_prints(rows, table, "text").select("key", "raw", F.xxhash64("scope", "form").alias("g1"), F.xxhash64("form", "scope", F.lit(1)).alias("g2")))
    mixed = prints.groupBy("g1", "g2").agg(F.min("raw").alias("low"), F.max("raw").alias("high")).where("low <> high").select("g1", "g2")
    return prints.join(mixed, ["g1", "g2"], "left_semi").where("key is not null").distinct()


def classes(df: DataFrame, table: dict[str, str], key: str, text: str, scope: str | None = None) -> DataFrame:
    """``key, class, texts, links``: the rows of every class with two different texts at least, one row each, however large a class is.

    ``texts`` counts the class's different texts and ``links`` the rows whose text differs
    from the row's own. Scopes, nulls and repeats are as in :func:`pairs`. Rows are
    counted by text before any class is brought together.
    """
    some = _mixed(df, table, key, text, scope)
    by_text = some.groupBy("g1", "g2", "raw").agg(F.count("*").alias("n"))
    by_class = by_text.groupBy("g1", "g2").agg(F.sum("n").alias("all"), F.count("*").alias("texts"))
    sizes = by_text.join(by_class, ["g1", "g2"]).select("g1", "g2", "raw", "texts", (F.col("all") - F.col("n")).alias("links"))
    return some.join(sizes, ["g1", "g2", "raw"]).select("key", F.hex("g1").alias("class"), "texts", "links")


def pairs(df: DataFrame, table: dict[str, str], key: str, text: str, scope: str | None = None) -> DataFrame:
    """Pairs ``key_a < key_b`` of rows whose texts differ but have one form.

    Compared within equal ``scope`` (all rows where none is given; rows with a null
    scope share one). Null texts match nothing; the empty text is a text. Repeated
    rows count once. Exact copies are no pairs, and groups without two different
    texts are dropped by an aggregate before any join, so that a large group of
    copies is never paired with itself. Each side of a class is spread over
    SPREAD slots of the other, so that no task holds a whole class; where only
    membership is wanted, :func:`classes` gives one row for each row.
    """
    some = _mixed(df, table, key, text, scope)
    a = some.select("g1", "g2", F.col("raw").alias("raw_a"), F.col("key").alias("key_a"), F.pmod(F.xxhash64("key", "raw"), F.lit(SPREAD)).cast("int").alias("slot"))
    b = some.select("g1", "g2", F.col("raw").alias("raw_b"), F.col("key").alias("key_b"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("slot"))
    return a.join(b, ["g1", "g2", "slot"]).where("raw_a <> raw_b and key_a < key_b").select("key_a", "key_b").distinct()
