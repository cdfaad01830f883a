"""Problem 5: per-document text statistics, and whether a text is natural prose.

The distributions of function words, character classes and line shapes of a main
body are compared by Jensen-Shannon divergence with prose profiles of each
language, counted over all records, and with the profiles of lists, tables and
kinds of junk; the nearest profile is the verdict.
"""

from __future__ import annotations

import re
import string
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.boilerplate import Pages
from folioforge.llm.residue import evidence, outside_code, removed
from folioforge.llm.sites import slices

#: Character classes.
CLASSES = ("letter", "digit", "space", "sentence", "quote", "line", "symbol")
LETTER, DIGIT, SPACE, SENTENCE, QUOTE, LINE, SYMBOL = range(len(CLASSES))
#: Shapes of lines, by which the characters of a body are shared out.
SHAPES = ("sentence", "list", "table", "pairs", "fields", "log", "code", "symbols", "words", "other")
PLACE = {name: k for k, name in enumerate(SHAPES)}
#: Distributions of the structural profiles over CLASSES, and the share of function words among their words.
# What such texts look like, rounded.
STRUCTURES = {
    "list": ((0.76, 0.03, 0.12, 0.01, 0.02, 0.05, 0.01), 0.08),
    "table": ((0.34, 0.16, 0.24, 0.02, 0.01, 0.03, 0.20), 0.05),
    "pairs": ((0.68, 0.07, 0.07, 0.07, 0.02, 0.07, 0.02), 0.05),
    "fields": ((0.48, 0.28, 0.06, 0.05, 0.00, 0.13, 0.00), 0.01),
    "log": ((0.36, 0.36, 0.11, 0.07, 0.00, 0.02, 0.08), 0.01),
    "code": ((0.43, 0.19, 0.04, 0.07, 0.06, 0.01, 0.20), 0.01),
    "symbols": ((0.02, 0.01, 0.12, 0.10, 0.08, 0.04, 0.63), 0.01),
    "words": ((0.78, 0.00, 0.16, 0.00, 0.01, 0.01, 0.04), 0.04),
}
#: Common words that every task may receive.
MOST_COMMON = 100_000
#: Weights of the three divergences: characters, function words, line shapes.
WEIGHTS = (1.0, 0.5, 1.5)
HAS_LETTER = re.compile(r"[^\W\d_]")
END = re.compile(r"[.!?…:;][\"'”»’)\]]*$")
MARK = re.compile(r"^\s*(?:[-*+•]|\d{1,3}[.)])\s+")
PAIR = re.compile(r"^[^\s:][^:]{0,40}:\s\S{0,30}(?:\s\S{1,20})?$")
TIMED, LEVEL = re.compile(r"\d\d:\d\d(?::\d\d)?\b.*\w="), re.compile(r"\b(?:INFO|WARN|DEBUG|ERROR|TRACE)\b.*\d")
ASCII_SIGNS = string.punctuation.encode()
SIGNS = re.compile(r"[{}()\[\]=;<>+*/\\|^~_#]")


def _table() -> np.ndarray:
    out = np.full(1 << 16, LETTER, np.uint8)
    for c in range(1 << 16):
        ch, kind = chr(c), unicodedata.category(chr(c))
        if kind == "Nd":
            out[c] = DIGIT
        elif ch == "\n":
            out[c] = LINE
        elif ch == "\t" or kind == "Zs":
            out[c] = SPACE
        elif ch in ".,;:!?…¿¡":
            out[c] = SENTENCE
        elif ch in "'\"’‘“”„«»‹›-–—":
            out[c] = QUOTE
        elif c < 128 and not ch.isalpha():
            out[c] = SYMBOL
        # All else counts as letters: garbled letters of prose turn into any sign beyond ASCII.
    return out


OF_CLASS = _table()


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(OF_CLASS[np.minimum(codes, (1 << 16) - 1)], minlength=len(CLASSES)).astype(np.float64)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence of ``p`` from each row of ``q``, in bits: 0 for equal, 1 for disjoint distributions."""
    p, q = (x / np.maximum(x.sum(axis=-1, keepdims=True), 1e-12) for x in (p, q))
    m = np.log2(np.maximum((p + q) / 2, 1e-300))
    a = (p * (np.log2(np.maximum(p, 1e-300)) - m)).sum(axis=-1)
    b = (q * (np.log2(np.maximum(q, 1e-300)) - m)).sum(axis=-1)
    return np.maximum(0.0, (a + b) / 2)


def shape(s: str) -> tuple[str, int]:
    """The shape of one stripped line by itself, a piece of running text being 'run', and how many pieces stand between its spaces."""
    tight, data = s.replace(" ", ""), s.encode("utf-8", "surrogatepass")
    signs = len(data) - len(data.translate(None, ASCII_SIGNS))
    if signs > 0.6 * len(tight):
        return "table" if s.startswith("|") and s.endswith("|") and set(tight) <= set("|-:") else "symbols", 0
    if s.startswith("|") and s.endswith("|") and len(s) > 1:
        return "table", 0
    if "\t" in s and s.count("\t") >= 2:
        return "fields", 0
    # What a pattern cannot match without is looked for first.
    if "=" in s and ":" in s and TIMED.search(s) or ("INFO" in s or "WARN" in s or "DEBUG" in s or "ERROR" in s or "TRACE" in s) and LEVEL.search(s):
        return "log", 0
    if signs > 6 and (marks := len(SIGNS.findall(s))) > 6 and marks > 0.1 * len(s) and not s.startswith(("[", "!")):
        return "code" if re.search(r"[(){};=]", s) and "](" not in s else "words" if " / " in s else "run", len(s.split())
    words = s.split()
    if len(s) > 40 and len(s) > 30 * len(words) and s.isascii():
        return "code", 0
    if (s[0] in "-*+•" or s[0].isdigit()) and MARK.match(s):
        # An item that is a whole sentence is prose with a dash before it.
        return "run" if len(words) > 8 and END.search(s) else "list", len(words)
    if len(words) <= 6 and ", " in s and any(c.isdigit() for c in s) and not END.search(s) and all(len(f.split()) <= 2 for f in s.split(", ")) and s.split(", ")[-1].replace(".", "").isdigit():
        return "fields", 0
    if len(words) <= 5 and PAIR.match(s):
        return "pairs", 0
    return "run", len(words)


def shapes(lines: list[str], common: frozenset[str]) -> np.ndarray:
    """Characters of ``lines`` by shape. Neighbouring pieces of running text are one paragraph, however they are broken."""
    out = np.zeros(len(SHAPES))
    block: list[str] = []
    pieces = 0

    def close() -> None:
        nonlocal pieces
        if not block:
            return
        text = " ".join(block)
        size, n, ended = len(text), pieces, bool(END.search(text[-8:]))
        pieces = 0
        stops = text.count(". ") + text.count("! ") + text.count("? ") + ended
        if stops and n >= 4 * stops and n >= 6 or ended and n >= 4:
            out[0] += size
        elif n >= 6:
            words = text.split()
            known = sum(w.lower().strip(",;:()") in common for w in words)
            out[0 if known >= 0.5 * len(words) or not text.isascii() and known == 0 and stops else 8] += size
        else:
            out[9] += size
        block.clear()

    fenced = False
    for line in lines:
        if line.lstrip().startswith("```"):
            close()
            fenced = not fenced
        elif not line or line.isspace():
            close()
        elif fenced:
            out[6] += len(line)
        elif line.startswith("#") and re.match(r"#{1,6}\s", line):
            close()
        else:
            bare = line.strip()
            kind, n = shape(bare)
            if kind == "run":
                block.append(bare)
                pieces += n
            else:
                close()
                out[PLACE[kind]] += len(line)
    close()
    return out


def body(lines: list[str], gone: set[int]) -> list[str]:
    """The lines of the main body, blank ones kept as borders of paragraphs."""
    return ["" if no in gone else line for no, line in enumerate(lines)]


def worded(text: str) -> tuple[Counter, int]:
    """What stands between spaces, in lower case, with counts, and how many of that are words: pieces with a letter.

    Signs stay at their words. Function words seldom have any.
    """
    sums = Counter(text.lower().split())
    return sums, sum([n for t, n in sums.items() if t[0].isalpha() or HAS_LETTER.search(t)])


def spoken(words: Counter, common: dict[str, frozenset[str]]) -> dict[str, int]:
    """How many of ``words`` are common ones of each language."""
    return {lang: sum([words[w] for w in known if w in words]) for lang, known in common.items()}


def counted(lines: list[str], common: dict[str, frozenset[str]], every: frozenset[str]) -> dict:
    """Basic counts of one body and its distributions."""
    kept = [x for x in lines if x and not x.isspace()]
    text = "\n".join(kept)
    sums, words = worded(text)
    hits = spoken(sums, common)
    lang = max(hits, key=lambda k: (hits[k], k)) if hits and max(hits.values()) else None
    chars = classes(text)
    return {
        "words": words,
        "mean_word_length": float(chars[LETTER]) / words if words else 0.0,
        "symbol_ratio": float(chars[SYMBOL] / max(chars.sum(), 1)),
        "ended_lines": sum(bool(END.search(x[-8:].rstrip())) for x in kept) / len(kept) if kept else 0.0,
        "common_words": sum([sums[w] for w in every if w in sums]) / words if words else 0.0,
        "lang": lang,
        "function": hits[lang] / words if lang and words else 0.0,
        "chars": chars,
        "shapes": shapes(lines, every),
        "sums": sums,
        "lines": len(kept),
    }


class Profiles:
    """The profiles to compare with: each language's prose, as counted, and the structural ones."""

    def __init__(self, prose: dict[str, tuple[np.ndarray, float]]):
        rows = [(f"prose:{k}", *v, "sentence") for k, v in sorted(prose.items())] + [(k, *v, k) for k, v in STRUCTURES.items()]
        self.names = [r[0] for r in rows]
        self.chars = np.array([np.asarray(r[1], float) / np.sum(r[1]) for r in rows])
        self.function = np.array([[r[2], 1 - r[2]] for r in rows])
        self.shapes = np.full((len(rows), len(SHAPES)), 0.01)
        self.shapes[np.arange(len(rows)), [SHAPES.index(r[3]) for r in rows]] = 0.9

    def nearest(self, found: list[dict]) -> list[tuple[str, float]]:
        """The nearest profile of each body and its weighted divergence; 'empty' where there is no text. Ties fall to the first."""
        if not found:
            return []
        rows = lambda name: np.array([f[name] for f in found], float)[:, None, :]
        share = np.array([f["function"] for f in found])
        d = WEIGHTS[0] * divergence(rows("chars"), self.chars) + WEIGHTS[1] * divergence(np.stack([share, 1 - share], axis=1)[:, None, :], self.function) + WEIGHTS[2] * divergence(rows("shapes"), self.shapes)
        at = d.argmin(axis=1)
        return [("empty", 0.0) if not f["words"] and not f["shapes"].sum() else (self.names[k], float(d[i, k])) for i, (f, k) in enumerate(zip(found, at.tolist()))]


def prose_profiles(texts: DataFrame, common: dict[str, frozenset[str]]) -> dict[str, tuple[np.ndarray, float]]:
    """Character classes and share of function words of each language's running text, over all rows of ``texts``: one row a language.

    A text speaks for the language most of its common words are of, with its
    long lines that end as sentences do; a repeated row speaks again.
    """
    names = [*CLASSES, "words", "function"]

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for text in batch.column("markdown").to_pylist():
                lines = [x for x in text.split("\n") if len(x) > 80 and x[-1] in ".!?"]
                if not lines:
                    continue
                joined = "\n".join(lines)
                sums, n = worded(joined)
                hits = spoken(sums, common)
                lang = max(hits, key=lambda k: (hits[k], k))
                # Garbled text and word lists have too few common words to speak for a language.
                if n and hits[lang] >= 0.15 * n:
                    total[lang] = total.get(lang, np.zeros(len(names))) + np.array([*classes(joined), n, hits[lang]])
        rows = list(total.items())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), *(pa.array([float(v[i]) for _, v in rows], pa.float64()) for i in range(len(names)))], names=["lang", *names])

    sums = texts.select("markdown").mapInArrow(run, "lang string, " + ", ".join(f"{n} double" for n in names)).groupBy("lang").agg(*(F.sum(n).alias(n) for n in names))
    return {r.lang: (np.array([r[n] for n in CLASSES]), r.function / r.words) for r in sums.collect() if r.words}


def quality(found_: Pages, common_words: DataFrame) -> DataFrame:
    """Statistics and verdict of each record of ``found_`` (see boilerplate.pages).

    Returns ``doc_id, words, mean_word_length, symbol_ratio, ended_lines,
    common_words, lang, profile, divergence, evidence, prose``. ``evidence`` is
    what problem 3 found; ``prose`` is true for natural prose, null for records with
    evidence or without a main body. Null and blank texts give no row, repeated
    rows repeated ones.
    """
    # Common words are a fixed, short list for each language; a table that is none is refused, not cut.
    rows = common_words.where("lang is not null and word is not null").distinct().limit(MOST_COMMON + 1).collect()
    if len(rows) > MOST_COMMON:
        raise ValueError("too many common words to send to every task")
    common: dict[str, set[str]] = {}
    for r in rows:
        common.setdefault(r.lang, set()).add(r.word.lower())
    by = {k: frozenset(v) for k, v in common.items()}
    every = frozenset().union(*by.values())
    profiles = Profiles(prose_profiles(found_.texts, by) if by else {})
    sent = found_.rows.sparkSession.sparkContext.broadcast((by, every, profiles, found_.model))
    kinds = "doc_id string, words bigint, mean_word_length double, symbol_ratio double, ended_lines double, common_words double, lang string, profile string, divergence double, evidence string, prose boolean"
    names = [k.split()[0] for k in kinds.split(", ")]
    types = [pa.int64(), *[pa.float64()] * 4, pa.string(), pa.string(), pa.float64(), pa.string(), pa.bool_()]

    def run(batches):
        by, every, profiles, model = sent.value
        for batch in slices(batches):
            rows, bodies, proofs = [], [], []
            for text, host, web, keys in zip(*(batch.column(c).to_pylist() for c in ("markdown", "host", "web", "recurring"))):
                lines = text.split("\n")
                gone, again = removed(lines, host, web, frozenset(keys or ()), model)
                found = counted(body(lines, gone), by, every)
                # Problem 3's residual; the counts are its own where there is no code.
                plain = outside_code(lines, gone)
                others = outside_code(lines, again) if gone or again else plain
                proofs.append(evidence(plain, others, found["sums"] if len(plain) == found["lines"] else None))
                bodies.append(found)
            for found, proof, (name, d) in zip(bodies, proofs, profiles.nearest(bodies)):
                verdict = None if proof or name == "empty" else name.startswith("prose")
                rows.append((found["words"], found["mean_word_length"], found["symbol_ratio"], found["ended_lines"], found["common_words"], found["lang"], name, d, proof, verdict))
            c = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(c, types))], names=names)

    return found_.rows.where(F.col("markdown").rlike(r"\S")).select("doc_id", "markdown", "host", "web", "recurring").mapInArrow(run, kinds)
