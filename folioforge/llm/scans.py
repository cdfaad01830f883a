"""Problem 6: noise in text from scanned pages.

Words the corpus does not know are compared with its vocabulary: candidates are
retrieved by an inverted join on character q-grams and ranked by a
gradient-boosted model, trained on words that known confusions corrupt. Line
pairs are classified as joins of a broken word or hyphens to keep, and lines at
page edges as furniture or text.
"""

from __future__ import annotations

import re
import statistics
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.boosting import Boosted
from folioforge.llm.sites import Memo, skeleton
from folioforge.runtime import cut

# What optical recognition takes one sign for; true first, seen second.
CONFUSIONS = (
    "l1 l! li i! i1 il Il o0 O0 s5 S5 a@ g9 gq b6 B8 z2 Z2 ec ce tf ft hb bh qg yv vy u:ii n:ri d:cl m:rn rn:m cl:d ri:n ii:u w:vv vv:w h:li li:h m:in m:nn "
    "éc èc êc ée èe êe óo òo ôo úu ùu ûu áa àa âa íi ìi îi ñn äa öo üu ó0 ö0 ô0 á@ à@ ä@ í! î! ì! í1 ü:ii ú:ii û:ii ß:B éè èé"
).split()
HYPHENS = "-‐‑¬\xad"
EDGES = ".,;:“”\"«»()[]…?„‘"
WORD = re.compile(r"[^\W\d_]+(?:[’'\-‐‑][^\W\d_]+)*")
LETTER = re.compile(r"[^\W\d_]")
#: Signs that stand for letters inside misread words.
FALSE = re.compile(r"[0-9!@|]")
PAGE_NO = re.compile(r"^[\W_]*(?:page|seite|p\*gina|pagina|strona|p|s|str|blatt|folio)?[\W_]*(?:\d{1,5}|[ivxlc]{1,7})(?:[\W_]*(?:/|of|von|de|sur|z)?[\W_]*\d{1,5})?[\W_]*$")
NUMBERED = re.compile(r"^(?:\d{1,5}\s{2,}\S.*|.*\S\s{2,}\d{1,5})$")
YEARED = re.compile(r"^[^\W\d_][\w*-]+\s(?:19|20)\d\d(?:\s{2,}\d{1,5})?$|^\d{1,5}\s{2,}[^\W\d_][\w*-]+\s(?:19|20)\d\d$")
ENDED = re.compile(r"[.!?…:;,][\"'”»’)\]]*$")

#: Words sent to every task as known; beyond them the lookup is a join.
MOST_KNOWN = 200_000
#: Distinct texts in which a word must stand to be a candidate, and the share of them that a misreading may reach.
LEAST_DF, RARE = 5, 0.05
#: Distinct texts in which a word must stand to train the ranking.
SURE_DF = 30
#: Words of the vocabulary drawn, by hash, to train the ranking; pages drawn to train the furniture model.
SAMPLE_WORDS, SAMPLE_PAGES = 3000, 800


def scanned(lines: list[str]) -> bool:
    """Whether a converted text keeps the short lines of a page, as scans do, and is running text."""
    kept = [x for x in lines if x.strip()]
    if len(kept) < 3 or max(map(len, kept)) > 160 or any(x.startswith("# ") for x in kept[:3]):
        return False
    running = sum(len(x.split()) >= 5 and not x.startswith(("|", "- ", "* ")) and "\t" not in x for x in kept)
    return running >= 0.5 * len(kept)


NOT_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())


def key_of(line: str) -> str:
    """Letters only, in lower case: what repeats in running heads whatever their number.

    Letters beyond ASCII count only where they are most of the line, since garbling
    and capitals change them.
    """
    s = line.replace("ß", "ss").lower()
    plain = s.encode("ascii", "ignore").translate(None, NOT_LETTERS).decode()
    return plain if s.isascii() or 2 * len(plain) > len(s) else re.sub(r"[\W\d_]+", "", s)


def numbered(line: str) -> bool:
    """Whether a line is a page number: bare, between signs, or after the word for page."""
    s = line.strip()
    if not s or len(s) > 24 or "|" in s or "\t" in s or s[-1] in ".,;:" or s.startswith("#"):
        return False
    return bool(PAGE_NO.match(skeleton(s))) and bool(re.search(r"\d|^[\W_]*[ivxlc]+[\W_]*$", skeleton(s)))


def vocabulary_form(token: str) -> str:
    """The form under which a token enters the vocabulary, '' where it is no word."""
    w = token.strip(EDGES + "!").lower()
    return w if len(w) <= 40 and WORD.fullmatch(w) else ""


def lexicon(texts: DataFrame) -> DataFrame:
    """``word, df``: in how many distinct texts each word stands, in lower case, without the halves of words broken over lines.

    Copies of a text count once, else what is misread in it would be as frequent as a word.
    """

    def run(batches):
        form = Memo(vocabulary_form, 400_000)
        for batch in batches:
            df: dict[str, int] = {}
            for text in batch.column("text").to_pylist():
                seen: set[str] = set()
                if any(h + "\n" in text for h in HYPHENS):
                    broken = False
                    for line in text.split("\n"):
                        tokens = line.split()
                        if not tokens:
                            continue
                        first = 1 if broken else 0
                        broken = line.rstrip()[-1] in HYPHENS
                        seen.update(tokens[first : len(tokens) - broken])
                else:
                    seen.update(text.split())
                for w in {form[t] for t in seen}:
                    df[w] = df.get(w, 0) + 1
            df.pop("", None)
            yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64())], names=["word", "df"])

    return texts.where("text is not null").select("text").distinct().mapInArrow(run, "word string, df bigint").groupBy("word").agg(F.sum("df").alias("df"))


# ---------------------------------------------------------------- furniture

def line_features(line: str, following: str, title: str, top: int, bottom: int, font: float, bold: bool) -> list[float]:
    s = line.strip()
    key = key_of(s)
    return [
        float(bool(NUMBERED.match(s))),
        float(bool(YEARED.match(s))),
        float(bool(key) and bool(title) and (key == title or key.startswith(title) and len(key) <= len(title) + 4)),
        float(bool(ENDED.search(s))),
        float(len(s.split())),
        float(s[:1].islower()),
        float(s.isupper()),
        float(following[:1].islower()),
        float(len(s)),
        float(min(top, 2)),
        float(min(bottom, 2)),
        font,
        float(bold),
    ]


#: Features that a text without geometry lacks.
GEOMETRY = (9, 10, 11, 12)


def page_lines(boxes: DataFrame) -> DataFrame:
    """``doc_id, page_number, lines``: the distinct boxes of each page in order."""
    rows = boxes.where("doc_id is not null and text is not null")
    return rows.groupBy("doc_id", "page_number").agg(F.sort_array(F.collect_set(F.struct("seq", "text", F.coalesce("font_size", F.lit(0.0)).alias("font"), F.coalesce("is_bold", F.lit(False)).alias("bold")))).alias("lines"))


def unnested(column: pa.ListArray) -> list[tuple[list, list, list, list]]:
    """(numbers, texts, font sizes, bold flags) of each page's lines, without building a record for each line."""
    values, ends = column.flatten(), [0]
    for n in column.value_lengths().to_pylist():
        ends.append(ends[-1] + (n or 0))
    parts = [values.field(k).to_pylist() for k in range(4)]
    return [tuple(p[a:b] for p in parts) for a, b in zip(ends, ends[1:])]


def page_edges(pages: DataFrame) -> DataFrame:
    """``doc_id, page_number, key, title, mark``: keys of the outer lines of each page, and of its title where one is set larger.

    ``mark`` is a hash of the page's number and text, on one row of the page only.
    """

    def run(batches):
        for batch in batches:
            at, keys, titles, marks = [], [], [], []
            for k, ((_, texts, fonts, _), page) in enumerate(zip(unnested(batch.column("lines")), batch.column("page_number").to_pylist())):
                mark = xxhash.xxh3_64_intdigest("\n".join([str(page), *texts])) - (1 << 63)
                big = 1.3 * statistics.median(fonts)
                title = next((t for t, f in zip(texts[:6], fonts) if f > big > 0), None)
                n = len(texts)
                # Two small lines from either end, beyond any that are set larger.
                small = [t for t, f in zip(texts[:6], fonts) if not f > big > 0][:2] + [t for t, f in zip(texts[max(0, n - 6) :], fonts[max(0, n - 6) :]) if not f > big > 0][-2:]
                for key in sorted({key_of(t) for t in small if not ENDED.search(t.strip())} - {""}) or [""]:
                    at.append(k)
                    keys.append(key)
                    titles.append(key_of(title) if title else None)
                    marks.append(mark)
                    mark = None
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), batch.column("page_number").take(pa.array(at, pa.int64())), pa.array(keys, pa.string()), pa.array(titles, pa.string()), pa.array(marks, pa.int64())], names=["doc_id", "page_number", "key", "title", "mark"])

    return pages.mapInArrow(run, "doc_id string, page_number int, key string, title string, mark bigint")


def with_document(pages: DataFrame) -> DataFrame:
    """``pages`` with ``size`` (pages of the document), ``heads`` (keys that recur at its page edges), ``title`` and ``mark`` (alike for copies of a document).

    A key counts from two pages and a twentieth of them, which bounds the list
    however long a document is; small rows of pages meet it first, so that no
    document's pages are brought together.
    """
    edges = cut(page_edges(pages))
    size = edges.groupBy("doc_id").agg(F.count_distinct("page_number").alias("size"), F.min_by("title", F.when(F.col("title").isNotNull(), F.col("page_number"))).alias("title"), F.bit_xor("mark").alias("mark"))
    often = edges.where("key <> ''").groupBy("doc_id", "key").agg(F.count_distinct("page_number").alias("n"))
    heads = often.join(size, "doc_id").where((F.col("n") >= 2) & (F.col("n") >= 0.05 * F.col("size"))).groupBy("doc_id").agg(F.collect_set("key").alias("heads"))
    small = edges.select("doc_id", "page_number").distinct().join(size.join(heads, "doc_id", "left"), "doc_id")
    return pages.join(small, ["doc_id", "page_number"])


def furniture_model(pages: DataFrame) -> tuple[Boosted, Boosted]:
    """Models of lone furniture lines, with and without geometry, from lines whose repetition labels them.

    Labelled are edge lines of documents of four pages or more: those that recur
    are furniture, others are text, and so are inner lines. The sample is that of
    about SAMPLE_PAGES pages, drawn by hash.
    """
    many = pages.where("size >= 4")
    share = min(1.0, SAMPLE_PAGES / max(1, many.select("doc_id").count()))

    def run(batches):
        for batch in batches:
            rows = []
            for (_, texts, fonts, bolds), heads, title in zip(unnested(batch.column("lines")), batch.column("heads").to_pylist(), batch.column("title").to_pylist()):
                heads, size, n = set(heads or ()), statistics.median(fonts), len(texts)
                for i, text in enumerate(texts):
                    edge = i < 2 or i >= n - 2
                    if numbered(text) or not edge and i % 7:
                        continue
                    f = line_features(text, texts[i + 1] if i + 1 < n else "", title or "", i, n - 1 - i, fonts[i] / size if size else 1.0, bolds[i])
                    rows.append((f, float(edge and key_of(text) in heads and f[11] < 1.3)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.float64())), pa.array([r[1] for r in rows], pa.float64())], names=["x", "y"])

    drawn = many.where(F.pmod(F.xxhash64("doc_id", "page_number"), F.lit(1_000_003)) < F.lit(int(share * 1_000_003) + 1))
    rows = sorted((list(r.x), r.y) for r in drawn.select("lines", "heads", "title").mapInArrow(run, "x array<double>, y double").collect())
    x, y = np.array([r[0] for r in rows] or np.zeros((0, 13))), np.array([r[1] for r in rows])
    flat = x.copy()
    flat[:, GEOMETRY] = 0
    return Boosted().fit(x, y), Boosted().fit(flat, y)


def page_furniture(texts: list[str], fonts: list[float], bolds: list[bool], heads: set[str], title: str, model: Boosted) -> list[bool]:
    """Which lines of one page are furniture: outer lines that are numbers, recur, or look like it."""
    n, size, ask = len(texts), statistics.median(fonts), []
    out = [False] * n
    for i in sorted({0, 1, n - 2, n - 1} & set(range(n))):
        text = texts[i].strip()
        if numbered(text):
            out[i] = True
        elif not fonts[i] > 1.3 * size > 0 and not ENDED.search(text):
            if key_of(text) in heads or YEARED.match(text) or NUMBERED.match(text):
                out[i] = True
            elif len(text) < 90:
                ask.append((i, line_features(text, texts[i + 1] if i + 1 < n else "", title, i, n - 1 - i, fonts[i] / size if size else 1.0, bolds[i])))
    if ask:
        for (i, f), p in zip(ask, model.probability(np.array([f for _, f in ask]))):
            # Text that runs on is no furniture, however its words look.
            out[i] = bool(p >= 0.5) and not (i + 1 < n and f[7] and f[4] > 3 and not f[2])
    # A line of furniture is outermost or beside another one.
    for i in (1, n - 2):
        if 0 < i < n - 1 and out[i] and not out[0 if i == 1 else -1]:
            out[i] = numbered(texts[i]) or key_of(texts[i]) in heads
    return out


def text_furniture(lines: list[str], model: Boosted) -> list[bool]:
    """The same for a text without geometry: numbers anywhere, repeated heads, and what stands above the title."""
    out, keys = [False] * len(lines), [key_of(x) for x in lines]
    at = [i for i, x in enumerate(lines) if x.strip()]
    wide = max((len(lines[i]) for i in at), default=0)
    short = [i for i in at if not ENDED.search(lines[i].strip()) and len(lines[i].split()) <= 14]
    # The title is the last of the leading lines that no text continues.
    lead = []
    for n, i in enumerate(at[:4]):
        rest = [j for j in at[n + 1 : n + 4] if not numbered(lines[j])]
        following = lines[rest[0]].strip() if rest else ""
        line = lines[i].strip()
        if numbered(line) or NUMBERED.match(line) or YEARED.match(line):
            lead.append(i)
        elif i in short and following[:1].isupper() and (len(line) < 0.85 * wide or keys[i] in keys[i + 1 :]):
            lead.append(i)
        else:
            break
    titles = [i for i in lead if not numbered(lines[i]) and not NUMBERED.match(lines[i].strip()) and not YEARED.match(lines[i].strip())]
    title = titles[-1] if titles else None
    seen: dict[str, int] = {}
    for i in short:
        if keys[i]:
            seen[keys[i]] = seen.get(keys[i], 0) + 1
    for i in at:
        line = lines[i].strip()
        if numbered(line):
            out[i] = True
        elif i != title and i in short:
            lone = bool(YEARED.match(line)) or bool(NUMBERED.match(line)) and len(line.split()) <= 14
            again = bool(keys[i]) and (seen[keys[i]] >= 2 or title is not None and keys[i] == keys[title])
            out[i] = again or lone or i in lead
    ask = [i for i in (at[-1:] if at else []) if not out[i] and i in short and i != title]
    for i in ask:
        f = line_features(lines[i], "", keys[title] if title is not None else "", 0, 0, 1.0, False)
        out[i] = bool(model.probability(np.array([[0.0 if k in GEOMETRY else v for k, v in enumerate(f)]]))[0] >= 0.5)
    return out


# ---------------------------------------------------------------- words and line pairs

def examined(lines: list[tuple[int, str]], unknown: Memo) -> tuple[list[tuple], tuple | None, tuple | None]:
    """(items, open end, head) of body lines: ('word', no, token, '', 0) and ('pair', no, left, right, next no).

    The open end is a broken word that the last line leaves, the head the first
    token, which may continue what came before. ``unknown`` gives the bare form of
    a token that may be misread, '' for others.
    """
    items, left, head = [], None, None
    for no, line in lines:
        tokens = line.split()
        if not tokens:
            continue
        start = 0
        if left is not None:
            items.append(("pair", left[0], left[1], tokens[0].strip(EDGES), no))
            left, start = None, 1
        elif head is None:
            head, start = (no, tokens[0].strip(EDGES)), 1
        last = tokens[-1]
        # A dash by itself, or behind a sign, breaks no word.
        if len(last) > 1 and last[-1] in HYPHENS and last[-2].isalpha() and (len(tokens) > start or len(tokens) == 1 and head == (no, last)):
            if len(tokens) == 1:
                head = (no, "")
            left = (no, last[:-1].strip(EDGES))
            tokens.pop()
        for t in tokens[start:]:
            if bare := unknown[t]:
                items.append(("word", no, bare, "", 0))
    return items, left, head


def odd(token: str, known: frozenset[str]) -> bool:
    """Whether a token may be misread: not a known word, not a figure, and of letters for the most part."""
    t = token.lower()
    if t in known or t.rstrip("!") in known or len(t) > 40:
        return False
    letters = len(LETTER.findall(t))
    if not letters:
        return False
    if any(p and p not in known for p in re.split(r"[-‐‑’']", t.rstrip("!"))) or FALSE.search(t):
        return letters >= 0.4 * len(t) and not re.fullmatch(r"\d+[^\W\d_]{0,3}|[ivxlc]+", t)
    return False


@lru_cache(maxsize=1)
def confusion_table() -> dict[str, list[str]]:
    """Seen -> true strings."""
    out: dict[str, list[str]] = {}
    for pair in CONFUSIONS:
        true, seen = pair.split(":") if ":" in pair else (pair[0], pair[1])
        out.setdefault(seen, []).append(true)
    return out


def confusion_cost(seen: str, true: str, limit: float = 3.0) -> float:
    """Least cost of turning ``true`` into ``seen``: 0.25 for a known confusion, 1 for any other edit."""
    table, n, m = confusion_table(), len(seen), len(true)
    rows = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        row = rows[i]
        for j in range(m + 1):
            if not i and not j:
                continue
            best = 1e9
            if i and j:
                best = rows[i - 1][j - 1] + (0.0 if seen[i - 1] == true[j - 1] else 1.0)
            if i and rows[i - 1][j] + 1 < best:
                best = rows[i - 1][j] + 1
            if j and row[j - 1] + 1 < best:
                best = row[j - 1] + 1
            for a in (1, 2):
                if a <= i:
                    for t in table.get(seen[i - a : i], ()):
                        b = len(t)
                        if b <= j and true[j - b : j] == t and rows[i - a][j - b] + 0.25 < best:
                            best = rows[i - a][j - b] + 0.25
            row[j] = best
        if min(row) > limit:
            return limit + 1
    return rows[n][m]


def grams(word: str, q: int) -> set[str]:
    s = f"^{word}$"
    return {s[i : i + q] for i in range(len(s) - q + 1)}


def width(word: str) -> int:
    """Grams of three for words long enough to share two of them after one confusion."""
    return 3 if len(word) >= 6 else 2


def pair_features(seen: str, true: str, n: int, df: int) -> list[float]:
    a, b = grams(seen, 2), grams(true, 2)
    return [
        confusion_cost(seen, true),
        float(abs(len(seen) - len(true))),
        len(a & b) / len(a | b),
        # Only how much rarer it is, never how often it stands: that grows with the corpus.
        float(np.log(max(df, 1) / max(n, 1))),
        float(len(true)),
        float(len(FALSE.findall(seen))),
        float(seen[:1] == true[:1]),
        float(seen[-1:] == true[-1:]),
    ]


def ranking_model(words: list[tuple[str, int]], seed: int = 5) -> Boosted:
    """The ranking model, from vocabulary words that known confusions corrupt.

    A corrupted word and its original are a positive pair; the corrupted word
    and a look-alike, or two words of the vocabulary, are negative ones. How much
    rarer the first is than the second is drawn alike for both, over all ratios that
    a misreading may have in a corpus of whatever size.
    """
    rng = np.random.default_rng(seed)
    spoil = [p.split(":") if ":" in p else (p[0], p[1]) for p in CONFUSIONS]
    index: dict[str, list[int]] = {}
    for k, (w, _) in enumerate(words):
        for g in grams(w, 2):
            index.setdefault(g, []).append(k)
    x, y = [], []
    known = {w for w, _ in words}
    rarer = lambda df: max(1, int(df * 10 ** rng.uniform(-6, np.log10(RARE))))
    for k, (w, df) in enumerate(words):
        near: dict[int, int] = {}
        for g in grams(w, 2):
            for j in index[g]:
                if j != k and abs(len(words[j][0]) - len(w)) <= 2:
                    near[j] = near.get(j, 0) + 1
        like = sorted(near, key=lambda j: (-near[j], words[j][0]))[:2]
        options = [(a, b, m.start()) for a, b in spoil for m in re.finditer(re.escape(a), w)]
        if options:
            a, b, at = options[int(rng.integers(len(options)))]
            bad = w[:at] + b + w[at + len(a) :]
            if bad not in known:
                x.append(pair_features(bad, w, rarer(df), df))
                y.append(1.0)
                for j in like[:1]:
                    x.append(pair_features(bad, words[j][0], rarer(words[j][1]), words[j][1]))
                    y.append(0.0)
        for j in like:
            # A word of its own, rare or not.
            x.append(pair_features(w, words[j][0], df if rng.random() < 0.3 else rarer(words[j][1]), words[j][1]))
            y.append(0.0)
    return Boosted().fit(np.array(x or np.zeros((0, 8))), np.array(y))


def least_shared(q: Column, length: Column) -> Column:
    """How many grams a candidate must share with a word."""
    return F.when((q == 3) | (length > 3), 2).otherwise(1)


def corrections(suspects: DataFrame, vocabulary: DataFrame, model: Boosted) -> DataFrame:
    """``word, true, p``: the best replacement of each suspect word and its probability.

    ``suspects`` has ``word, n``; ``vocabulary`` has ``word, df``. Candidates come
    from an inverted join on q-grams and lengths, so that only words that share
    grams and could be as long ever meet. Two words that must share two grams share
    one besides any: the gram of a word that most of the vocabulary has is not
    looked up, and neither are those that none has. What is shared is counted when a pair is scored.
    """

    def asked(batches):
        for batch in batches:
            rows = [(w, n, q, g) for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()) for q in (width(w),) for g in grams(w, q)]
            c = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.string())], names=["word", "n", "q", "gram"])

    def posted(batches):
        for batch in batches:
            rows = [(w, d, q, g, len(w)) for w, d in zip(batch.column("word").to_pylist(), batch.column("df").to_pylist()) for q in (2, 3) if q == 2 and len(w) <= 7 or q == 3 and len(w) >= 4 for g in grams(w, q)]
            c = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.string()), pa.array(c[4], pa.int32())], names=["true", "df", "q", "gram", "size"])

    right = vocabulary.where(F.col("df") >= LEAST_DF).select("word", "df").mapInArrow(posted, "true string, df bigint, q int, gram string, size int")
    often = right.groupBy("q", "gram").agg(F.count("*").alias("often"))
    place = F.row_number().over(Window.partitionBy("word", "q").orderBy(F.desc("often"), "gram"))
    left = suspects.mapInArrow(asked, "word string, n bigint, q int, gram string").join(often, ["q", "gram"]).withColumn("place", place)
    left = left.where((F.col("place") > 1) | (least_shared(F.col("q"), F.length("word")) < 2)).select("word", "n", "q", "gram", F.explode(F.sequence(F.greatest(F.length("word") - 2, F.lit(1)), F.length("word") + 1)).alias("size"))
    met = left.join(right, ["q", "gram", "size"]).where(F.col("n") <= F.greatest(F.lit(1.0), RARE * F.col("df")))
    pairs = met.groupBy("word", "n", "true", "df", "q").agg(F.lit(1).alias("met"))

    def score(batches):
        for batch in batches:
            rows = []
            for w, n, t, d, q in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "true", "df", "q"))):
                if len(grams(w, q) & grams(t, q)) < (2 if q == 3 or len(w) > 3 else 1):
                    continue
                f = pair_features(w, t, n, d)
                if f[0] <= 2:
                    rows.append((w, t, f))
            p = model.probability(np.array([r[2] for r in rows])) if rows else []
            # The ranking needs the cost as a tie-breaker between equally likely words.
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([float(v) for v in p], pa.float64()), pa.array([r[2][0] for r in rows], pa.float64()), pa.array([r[2][3] for r in rows], pa.float64())], names=["word", "true", "p", "cost", "weight"])

    scored = pairs.select("word", "n", "true", "df", "q").mapInArrow(score, "word string, true string, p double, cost double, weight double")
    best = F.max_by(F.struct("true", "p", "cost"), F.struct("p", -F.col("cost"), "weight", "true"))
    return scored.groupBy("word").agg(best.alias("b")).select("word", "b.*")


def hyphen_features(df_whole: int, df_kept: int, cost: float | None, cost_kept: float | None, left: str, right: str) -> list[float]:
    """A line pair with a hyphen between: how common the joined and the hyphened word are, or what they are misread from."""
    return [float(np.log1p(df_whole)), float(np.log1p(df_kept)), 9.0 if cost is None else cost, 9.0 if cost_kept is None else cost_kept, float(len(left)), float(len(right)), float(left[:1].isupper())]


def hyphen_model(words: list[tuple[str, int]], hyphened: list[tuple[str, int]], seed: int = 6) -> Boosted:
    """Whether a hyphen at a line's end stays (1) or was set for the line (0).

    Trained on vocabulary words broken at random, on hyphened ones broken at their
    hyphen, on both misread, and on words that the vocabulary lacks, which break.
    """
    rng, x, y = np.random.default_rng(seed), [], []
    counts = dict(words)
    for w, df in words:
        if "-" in w or len(w) < 4:
            continue
        at, luck = int(rng.integers(2, len(w) - 1)), rng.random()
        a, b = w[:at], w[at:]
        if luck < 0.7:
            x.append(hyphen_features(df, 0, None, None, a, b))
        elif luck < 0.85:
            x.append(hyphen_features(0, 0, 0.25 * int(rng.integers(1, 3)), None, a, b))
        else:
            x.append(hyphen_features(0, 0, None, None, a, b))
        y.append(0.0)
    # Hyphened words are few; each is broken as often as evens the classes out.
    for w, df in hyphened:
        for _ in range(max(1, len(x) // max(1, 2 * len(hyphened)))):
            at = w.index("-", 1) if w.count("-") == 1 else [m.start() for m in re.finditer("-", w)][int(rng.integers(w.count("-")))]
            a, b, luck = w[:at], w[at + 1 :], rng.random()
            joined = counts.get(a + b, 0)
            x.append(hyphen_features(joined, df, None, None, a, b) if luck < 0.8 else hyphen_features(0, 0, 1.25 if luck < 0.9 else None, 0.25 * int(rng.integers(1, 3)), a, b))
            y.append(1.0)
    return Boosted().fit(np.array(x or np.zeros((0, 7))), np.array(y))


def misread_at(seen: str, true: str) -> int:
    """Place of the first sign of ``seen`` that differs from ``true``."""
    k = 0
    while k < min(len(seen), len(true)) and seen[k] == true[k]:
        k += 1
    return k


ITEM = "tbl string, doc_id string, page_number int, line_no int, kind string, a string, b string, page2 int, line2 int, mark bigint"


def _items(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows)) or [()] * 10
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds)], names=[x.split()[0] for x in ITEM.split(", ")])


def cased(seen: str, true: str) -> str:
    """``true`` with the capital of ``seen``."""
    return true[:1].upper() + true[1:] if seen[:1].isupper() else true


def noise(documents: DataFrame, boxes: DataFrame, corpus: DataFrame) -> DataFrame:
    """``tbl, doc_id, page_number, line_no, noise, seen, fixed, next_page`` of scanned text.

    ``documents`` has ``doc_id, markdown`` of PDF records, ``boxes`` the text boxes,
    ``corpus`` a column ``text`` from which the vocabulary is counted. ``noise`` is
    'furniture', 'hyphen' or 'misread', or 'kept' for a line that ends at a hyphen
    which stays; ``fixed`` is what takes the place of ``seen``: a word, or for a
    broken one the whole word, whose second half stands on ``next_page``. Null texts have no rows, repeated boxes count once, a
    box without a document is left out.
    """
    counted = cut(lexicon(corpus).where("df >= 2"))
    sample = counted.where((F.col("df") >= SURE_DF) & (F.length("word") >= 3)).orderBy(F.xxhash64("word")).limit(SAMPLE_WORDS).collect()
    model = ranking_model([(r.word, r.df) for r in sample])
    hyphened = counted.where((F.col("df") >= LEAST_DF) & F.col("word").rlike(r"^[^-]+(-[^-]+)+$")).orderBy(F.xxhash64("word")).limit(SAMPLE_WORDS).collect()
    pairs = hyphen_model([(r.word, r.df) for r in sample], [(r.word, r.df) for r in hyphened])
    # A misreading repeats too: what a far more frequent word explains is no word of the vocabulary.
    wrong = corrections(counted.select("word", F.col("df").alias("n")), counted, model).where("p >= 0.5").select("word")
    vocabulary = cut(counted.join(wrong, "word", "left_anti"))
    top = vocabulary.where(F.col("df") >= LEAST_DF).orderBy(F.desc("df"), "word").limit(MOST_KNOWN).select("word").collect()
    known = frozenset(r.word for r in top)
    pages = with_document(page_lines(boxes))
    edged, flat = furniture_model(pages)

    def suspicious(token: str) -> str:
        bare = token.strip(EDGES)
        return bare if odd(bare, known) else ""

    def of_text(batches):
        unknown = Memo(suspicious, 400_000)
        for batch in batches:
            rows = []
            for doc, text, mark in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "markdown", "mark"))):
                lines = text.split("\n")
                if not scanned(lines):
                    continue
                gone = text_furniture(lines, flat)
                rows += [("documents_out", doc, 0, i, "furniture", None, None, None, None, None) for i, g in enumerate(gone) if g]
                items, _, head = examined([(i, x) for i, (x, g) in enumerate(zip(lines, gone)) if not g and x], unknown)
                rows += [("documents_out", doc, 0, no, kind, a, b, 0, to, mark) for kind, no, a, b, to in items]
                if head and odd(head[1], known):
                    rows.append(("documents_out", doc, 0, head[0], "word", head[1], "", 0, 0, mark))
            yield _items(rows)

    def of_pages(batches):
        unknown = Memo(suspicious, 400_000)
        for batch in batches:
            rows = []
            for (numbers, texts, fonts, bolds), doc, page, heads, title, mark in zip(unnested(batch.column("lines")), *(batch.column(c).to_pylist() for c in ("doc_id", "page_number", "heads", "title", "mark"))):
                gone = page_furniture(texts, fonts, bolds, set(heads or ()), title or "", edged)
                rows += [("text_boxes", doc, page, no, "furniture", None, None, None, None, None) for no, g in zip(numbers, gone) if g]
                items, left, head = examined([(no, x) for no, x, g in zip(numbers, texts, gone) if not g], unknown)
                rows += [("text_boxes", doc, page, no, kind, a, b, page, to, mark) for kind, no, a, b, to in items]
                if left:
                    rows.append(("text_boxes", doc, page, left[0], "open", left[1], None, page + 1, None, mark))
                if head:
                    rows.append(("text_boxes", doc, page, head[0], "head", head[1], None, None, None, mark))
            yield _items(rows)

    found = documents.where("markdown is not null").select("doc_id", "markdown", F.xxhash64("markdown").alias("mark")).mapInArrow(of_text, ITEM)
    every = cut(found.unionByName(pages.select("doc_id", "page_number", "lines", "heads", "title", "mark").mapInArrow(of_pages, ITEM)).distinct())
    # A word broken over pages meets the head of the next page; other heads are words of their own.
    opens = every.where("kind = 'open'").select("doc_id", F.col("page_number").alias("p"), F.col("line_no").alias("l"), "a", "page2")
    heads_ = every.where("kind = 'head'").select("doc_id", F.col("page_number").alias("page2"), F.col("line_no").alias("line2"), F.col("a").alias("b"), "mark")
    met = heads_.join(opens, ["doc_id", "page2"], "left")
    over = met.where("a is not null").select(F.lit("text_boxes").alias("tbl"), "doc_id", F.col("p").alias("page_number"), F.col("l").alias("line_no"), F.lit("pair").alias("kind"), "a", "b", "page2", "line2", "mark")
    lone = met.where("a is null and b <> ''").select(F.lit("text_boxes").alias("tbl"), "doc_id", F.col("page2").alias("page_number"), F.col("line2").alias("line_no"), F.lit("word").alias("kind"), F.col("b").alias("a"), F.lit("").alias("b"), "page2", F.lit(0).alias("line2"), "mark")
    items = cut(every.where("kind in ('word', 'pair')").unionByName(over).unionByName(lone))
    joined = F.lower(F.concat("a", "b"))
    items = items.withColumn("whole", F.when(F.col("kind") == "pair", joined).otherwise(F.lower("a"))).withColumn("kept", F.when(F.col("kind") == "pair", F.lower(F.concat("a", F.lit("-"), "b"))))
    plain = vocabulary.select(F.col("word").alias("whole"), F.col("df").alias("df_whole"))
    hyphened = vocabulary.select(F.col("word").alias("kept"), F.col("df").alias("df_kept"))
    looked = items.join(plain, "whole", "left").join(hyphened, "kept", "left").na.fill(0, ["df_whole", "df_kept"])
    # What no vocabulary explains is a suspect; the head of a page may be a word of the vocabulary.
    unknown = F.col("df_kept") < LEAST_DF
    open_ = looked.where(unknown & (F.length("whole") <= 40)).select("tbl", "mark", "df_whole", F.explode(F.array("whole", "kept")).alias("word")).where("word is not null")
    # As in the vocabulary, copies count once; a record mostly stands in both tables, so these are not added up.
    seen = open_.groupBy("word", "tbl").agg(F.count_distinct("mark").alias("n"), F.max("df_whole").alias("df_whole"))
    suspects = seen.groupBy("word").agg(F.greatest(F.max("n"), F.max("df_whole")).alias("n"))
    best = cut(corrections(cut(suspects), vocabulary, model).where("p >= 0.5"))
    judged = looked.join(best.select(F.col("word").alias("whole"), "true", "cost"), "whole", "left")
    other = best.where(F.col("true").contains("-")).select(F.col("word").alias("kept"), F.col("true").alias("true_kept"), F.col("cost").alias("cost_kept"))
    judged = judged.join(other, "kept", "left").withColumn("true", F.when(unknown, F.col("true"))).withColumn("true_kept", F.when(unknown & (F.col("df_whole") < LEAST_DF), F.col("true_kept")))

    def decide(batches):
        for batch in batches:
            rows, records = [], batch.to_pylist()
            broken = [r for r in records if r["kind"] == "pair"]
            x = [hyphen_features(r["df_whole"], r["df_kept"], r["cost"] if r["true"] else None, r["cost_kept"] if r["true_kept"] else None, r["a"], r["b"]) for r in broken]
            stays = dict(zip(map(id, broken), pairs.probability(np.array(x)) >= 0.5)) if x else {}
            for r in records:
                seen, true = r["whole"], r["true"]
                at = (r["tbl"], r["doc_id"], r["page_number"], r["line_no"])
                if r["kind"] == "word":
                    if true and true != seen:
                        rows.append((*at, "misread", r["a"], cased(r["a"], true), None))
                    continue
                stay = stays[id(r)]
                if stay:
                    # Misread, but nearest to a word that has its hyphen just there.
                    seen, true = r["kept"], r["true_kept"]
                wrong = bool(true) and true != seen
                whole = cased(r["a"], true) if wrong else r["a"] + ("-" if stay else "") + r["b"]
                rows.append((*at, "kept" if stay else "hyphen", r["a"], whole, r["page2"]))
                if wrong:
                    # The sign that differs lies on this line or on the next.
                    here = misread_at(seen, true) < len(r["a"])
                    rows.append((*at, "misread", r["a"], whole, None) if here else (r["tbl"], r["doc_id"], r["page2"], r["line2"], "misread", r["b"], whole, None))
            c = list(zip(*rows)) or [()] * 8
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds)], names=["tbl", "doc_id", "page_number", "line_no", "noise", "seen", "fixed", "next_page"])

    result = judged.select("tbl", "doc_id", "page_number", "line_no", "kind", "a", "b", "page2", "line2", "whole", "kept", "true", "cost", "true_kept", "cost_kept", "df_whole", "df_kept")
    result = result.mapInArrow(decide, "tbl string, doc_id string, page_number int, line_no int, noise string, seen string, fixed string, next_page int")
    none = F.lit(None).cast("string")
    furniture = every.where("kind = 'furniture'").select("tbl", "doc_id", "page_number", "line_no", F.lit("furniture").alias("noise"), none.alias("seen"), none.alias("fixed"), none.cast("int").alias("next_page"))
    return result.unionByName(furniture).distinct()


def mended(lines: list[str], fixes: list[dict], carry: str | None = None, over: bool = False) -> str:
    """Paragraphs from the lines of a page or text: furniture gone, misread words put right, broken ones and lines joined.

    Blank lines part paragraphs, except where they stand beside furniture. ``carry``
    is the whole word whose second half begins the text; ``over`` says that the next
    page gets the word that is broken at its end.
    """
    gone, swaps, ends = set(), {}, {}
    for f in fixes:
        if f["noise"] == "furniture":
            gone.add(f["line_no"])
        elif f["noise"] == "misread":
            swaps.setdefault(f["line_no"], []).append((f["seen"], f["fixed"]))
        else:
            ends[f["line_no"]] = (f["seen"], f["fixed"])
    paragraphs, now = [], []
    text_lines = [no for no, line in enumerate(lines) if no not in gone and line.strip()]
    wide = max((len(lines[no]) for no in text_lines), default=0)
    # The first line is a title where it is short, ends no sentence and a new one follows.
    title = text_lines[0] if len(text_lines) > 1 and len(lines[text_lines[0]]) < 0.85 * wide and not ENDED.search(lines[text_lines[0]].strip()) and lines[text_lines[1]].strip()[:1].isupper() else None
    for no, line in enumerate(lines):
        if no in gone:
            continue
        if not line.strip():
            near = no - 1 in gone or no + 1 in gone
            if now and not (near and carry) and not near:
                paragraphs.append(" ".join(now))
                now = []
            continue
        words = line.strip().split()
        if carry is not None and words:
            # The whole word stands before what its second half carried along.
            half = words[0]
            tail = half[len(half.rstrip(EDGES)) :]
            words[0], carry = carry + tail, None
        text = " ".join(words)
        for seen, fixed in swaps.get(no, ()):
            text = text.replace(seen, fixed, 1)
        if no in ends and text and text[-1] in HYPHENS:
            seen, fixed = ends[no]
            parts = text.split(" ")
            text, carry = " ".join(parts[:-1]), parts[-1][: len(parts[-1]) - len(parts[-1].lstrip(EDGES))] + fixed
        if text:
            now.append(text)
        if no == title and now:
            paragraphs.append(" ".join(now))
            now = []
    if carry is not None and not over:
        now.append(carry)
    if now:
        paragraphs.append(" ".join(now))
    return "\n\n".join(paragraphs)


def parted(rows: list[dict]) -> tuple[list[str], dict[int, int]]:
    """(lines, place of each seq) of one page: blank lines stand where the space above a line is wider than most, and around larger lines."""
    steps = [a["top"] - b["top"] for a, b in zip(rows, rows[1:]) if a["top"] is not None and b["top"] is not None]
    down = [x for x in steps if x > 0]
    usual, size = statistics.median(down) if down else 0.0, statistics.median(r["font"] for r in rows)
    lines, at = [], {}
    for k, r in enumerate(rows):
        if k:
            last = rows[k - 1]
            wide = usual and r["top"] is not None and last["top"] is not None and last["top"] - r["top"] > 1.3 * usual
            if wide or (r["font"] > 1.3 * size > 0) != (last["font"] > 1.3 * size > 0):
                lines.append("")
        at[r["seq"]] = len(lines)
        lines.append(r["text"])
    return lines, at


def repaired(documents: DataFrame, found: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """``tbl, doc_id, page_number, text``: the readable paragraphs of converted scans, and of each page of ``boxes``.

    ``documents`` has ``doc_id, markdown``, ``found`` is :func:`noise` of both. Scans
    and pages without noise come out too, their lines joined; texts that are no scans
    do not, nor pages of nothing but furniture. A page number is 0 for a document. A word broken over pages
    stands on the later one. Fixes are as many as lines and words of a text or page,
    so they meet it as one row, and a document of any length spreads over tasks.
    """
    fix = F.sort_array(F.collect_list(F.struct("line_no", "noise", "seen", "fixed", "next_page"))).alias("fixes")
    kind = "tbl string, doc_id string, page_number int, text string"

    def rows_of(batch, tbl, pages, texts):
        kept = pa.array([k for k, t in enumerate(texts) if t], pa.int64())
        columns = [pa.array([tbl] * len(texts), pa.string()), batch.column("doc_id"), pages, pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays([c.take(kept) for c in columns], names=["tbl", "doc_id", "page_number", "text"])

    def of_text(batches):
        for batch in batches:
            texts = []
            for text, fixes in zip(batch.column("markdown").to_pylist(), batch.column("fixes").to_pylist()):
                lines = text.split("\n")
                texts.append(mended(lines, fixes or []) if scanned(lines) else "")
            yield rows_of(batch, "documents_out", pa.array([0] * len(texts), pa.int32()), texts)

    fixes = found.where("tbl = 'documents_out'").groupBy("doc_id").agg(fix)
    out = documents.where("markdown is not null").select("doc_id", "markdown").join(fixes, "doc_id", "left").mapInArrow(of_text, kind)
    if boxes is None:
        return out

    def of_pages(batches):
        for batch in batches:
            texts = []
            for page, rows, fixes, carry in zip(*(batch.column(c).to_pylist() for c in ("page_number", "lines", "fixes", "carry"))):
                lines, at = parted(rows)
                fixes = fixes or []
                over = any(f["next_page"] is not None and f["next_page"] > page for f in fixes)
                texts.append(mended(lines, [f | {"line_no": at[f["line_no"]]} for f in fixes], carry, over))
            yield rows_of(batch, "text_boxes", batch.column("page_number"), texts)

    found = found.where("tbl = 'text_boxes'")
    fixes = found.groupBy("doc_id", "page_number").agg(fix)
    carried = found.where("next_page > page_number").groupBy("doc_id", F.col("next_page").alias("page_number")).agg(F.min("fixed").alias("carry"))
    top = F.col("y_top") if "y_top" in boxes.columns else F.lit(None).cast("double")
    line = F.struct("seq", "text", F.coalesce("font_size", F.lit(0.0)).alias("font"), top.alias("top"))
    pages = boxes.where("doc_id is not null and text is not null").groupBy("doc_id", "page_number").agg(F.sort_array(F.collect_set(line)).alias("lines"))
    joined = pages.join(fixes, ["doc_id", "page_number"], "left").join(carried, ["doc_id", "page_number"], "left")
    return out.unionByName(joined.select("doc_id", "page_number", "lines", "fixes", "carry").mapInArrow(of_pages, kind))
