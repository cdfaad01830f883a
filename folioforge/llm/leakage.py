"""Problem 9: held-out test items that leaked into a corpus.

Latent semantic retrieval. Passages of the corpus are weighted by TF-IDF over the
vocabulary of the items, a randomised SVD is computed from sketches that each
task sums over its own passages, items and passages are compared by cosine in
the latent space, and every candidate is then checked: longest common run,
longest common subsequence, and the item's figures.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.runtime import cut, partitions

#: Words are maximal runs of letters and digits.
WORD = re.compile(r"[^\W_]+")
RUN = 12


@dataclass(frozen=True)
class Setting:
    """Parameters of the search; items beyond the two bounds of what every task receives are searched in blocks."""

    run: int = RUN
    rank: int = 128
    oversample: int = 16
    least_cosine: float = 0.25
    item_stride: int = 4
    #: Cosine and share of a window's words in common order from which a passage may be a paraphrase.
    close_cosine: float = 0.6
    close_words: float = 0.5
    max_item_words: int = 200_000
    max_terms: int = 50_000
    seed: int = 7


@dataclass
class Items:
    """The query set: tokenised items, their vocabulary and their passages."""

    ids: list
    words: list[np.ndarray]
    vocabulary: dict[str, int]
    passage_item: np.ndarray
    passages: np.ndarray
    grams: dict[bytes, list[int]]
    figures: list[frozenset]


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def item_blocks(df: DataFrame, setting: Setting) -> list[DataFrame]:
    """``key, text`` of the distinct items in blocks within the setting's bounds; a larger item is a block of its own."""
    rows = df.where("text is not null and key is not null").distinct()
    # Words are at least one sign and one gap apart, so this bounds them and the terms from above.
    sizes = rows.groupBy(F.pmod(F.xxhash64("key"), F.lit(1 << 20)).alias("m")).agg(F.sum((F.length("text") + 1) / 2).alias("words"))
    blocks, bound = 1, min(setting.max_item_words, setting.max_terms * 4)
    while blocks < 1 << 20 and sizes.groupBy(F.pmod("m", F.lit(blocks)).alias("b")).agg(F.sum("words").alias("words"), F.count("*").alias("n")).where((F.col("words") > bound) & (F.col("n") > 1)).limit(1).count():
        blocks *= 2
    if blocks == 1:
        return [rows]
    return [rows.where(F.pmod(F.pmod(F.xxhash64("key"), F.lit(1 << 20)), F.lit(blocks)) == b) for b in range(blocks)]


def read_items(rows: DataFrame, setting: Setting) -> Items:
    """One block of items, as every task receives it."""
    vocabulary: dict[str, int] = {}
    ids, words, owners, parts, grams, figures = [], [], [], [], {}, []
    for key_, text_ in rows.orderBy("key", "text").collect():
        found = tokens(text_)
        at, n = len(ids), np.array([vocabulary.setdefault(w, len(vocabulary)) for w in found], np.int32)
        ids.append(key_)
        words.append(n)
        figures.append(frozenset(vocabulary[w] for w in found if w.isdigit()))
        starts = {*range(0, max(1, len(n) - setting.run + 1), setting.item_stride), max(0, len(n) - setting.run)}
        for s in sorted(starts):
            part = np.full(setting.run, -1, np.int32)
            part[: len(n[s : s + setting.run])] = n[s : s + setting.run]
            owners.append(at)
            parts.append(part)
        for s in range(len(n) - setting.run + 1):
            mine = grams.setdefault(n[s : s + setting.run].tobytes(), [])
            if at not in mine:
                mine.append(at)
    return Items(ids, words, vocabulary, np.array(owners, np.int64), np.array(parts, np.int32).reshape(-1, setting.run), grams, figures)


def passages(df: DataFrame, key: str, text: str, vocabulary: dict[str, int], run: int) -> DataFrame:
    """Windows of ``2 * run`` words, ``run`` apart, as numbers in ``vocabulary`` (-1: not in it).

    A window with fewer than ``run`` words of the vocabulary can't hold a run of an
    item and is left out; every run of ``run`` words lies wholly in one window.
    A row without a key holds, for each task, in how many windows each word of the
    vocabulary stands: document frequencies count every window of every text.
    """
    source = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull() & (F.length("text") > 0))
    kind, size, width = source.schema["key"].dataType.simpleString(), len(vocabulary), 2 * run

    def split(batches):
        seen, windows_, typed = np.zeros(size, np.int64), 0, None
        get, find = vocabulary.get, WORD.findall
        for batch in batches:
            typed = batch.schema.field("key").type
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                flat, ends = [], []
                for text_ in part.column("text").to_pylist():
                    flat += [get(w, -1) for w in find(text_.lower())]
                    # At least one window's width, and none beyond the text's own words.
                    ends.append(len(flat))
                terms, ends = np.array(flat, np.int32), np.array(ends, np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                counts = np.maximum(1, -(-(ends - starts - run) // run))
                counts[ends == starts] = 0
                owner = np.repeat(np.arange(len(ends)), counts)
                first = starts[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * run
                place = first[:, None] + np.arange(width)
                inside = place < ends[owner][:, None]
                got = np.where(inside, terms[np.minimum(place, max(len(terms) - 1, 0))], -1) if len(terms) else np.zeros((0, width), np.int32)
                windows_ += len(got)
                known = (got >= 0).sum(axis=1) if len(got) else np.zeros(0, np.int64)
                ordered = np.sort(got, axis=1)
                new = np.concatenate([ordered[:, :1] >= 0, (ordered[:, 1:] != ordered[:, :-1]) & (ordered[:, 1:] >= 0)], axis=1) if len(got) else np.zeros((0, width), bool)
                seen += np.bincount(ordered[new], minlength=size)[:size] if new.any() else 0
                keep = np.flatnonzero(known >= run)
                if len(keep):
                    yield pa.RecordBatch.from_arrays(
                        [part.column("key").take(pa.array(owner[keep])), pa.array([x.tobytes() for x in got[keep].astype("<i4")], pa.binary()), pa.nulls(len(keep), pa.binary()), pa.nulls(len(keep), pa.int64())],
                        names=["key", "terms", "seen", "windows"],
                    )
        if typed is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, typed), pa.nulls(1, pa.binary()), pa.array([seen.astype("<i8").tobytes()], pa.binary()), pa.array([windows_], pa.int64())], names=["key", "terms", "seen", "windows"])

    return source.mapInArrow(split, f"key {kind}, terms binary, seen binary, windows bigint")


def _summed(df: DataFrame, column: str, dtype: str, width: int) -> np.ndarray | None:
    """The sum of the equally long vectors in ``column``, in two steps; the result has ``width`` numbers."""

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(width, dtype)
        for x in rows.column("v").to_pylist():
            total += np.frombuffer(x, dtype)
        return pa.table({"v": pa.array([total.tobytes()], pa.binary())})

    wide = max(1, int(partitions(df.sparkSession) ** 0.5))
    salted = df.where(F.col(column).isNotNull()).select(F.col(column).alias("v"), F.pmod(F.spark_partition_id(), F.lit(wide)).alias("g"))
    parts = [np.frombuffer(r.v, dtype) for r in salted.groupBy("g").applyInArrow(add, "v binary").toLocalIterator()]
    return np.sum(parts, axis=0) if parts else None


def _weighted(terms: np.ndarray, idf: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Rows of TF-IDF (1 + log tf) times ``matrix``, each row first brought to unit length."""
    ordered = np.sort(terms, axis=1)
    n, width = ordered.shape
    count = np.ones((n, width), np.float32)
    for shift in range(1, width):
        count[:, shift:] += (ordered[:, shift:] == ordered[:, :-shift])
    last = np.concatenate([ordered[:, 1:] != ordered[:, :-1], np.ones((n, 1), bool)], axis=1) & (ordered >= 0)
    weight = np.where(last, (1 + np.log(count)) * idf[np.maximum(ordered, 0)], 0).astype(np.float32)
    norm = np.linalg.norm(weight, axis=1, keepdims=True)
    weight /= np.where(norm > 0, norm, 1)
    out = np.zeros((n, matrix.shape[1]), np.float32)
    for k in range(width):
        out += weight[:, k : k + 1] * matrix[np.maximum(ordered[:, k], 0)]
    return out


def latent_basis(kept: DataFrame, idf: np.ndarray, setting: Setting) -> np.ndarray:
    """Orthonormal right singular directions (terms x rank) of the TF-IDF passages.

    Every task adds up A'(A W) over its passages for a random W; the sum, one
    matrix of the vocabulary's height, is all that leaves the executors.
    """
    size, rank = len(idf), min(setting.rank + setting.oversample, len(idf))
    noise = np.random.default_rng(setting.seed).standard_normal((size, rank)).astype(np.float32)

    def sketch(batches):
        total = np.zeros((size, rank), np.float64)
        some = False
        for batch in batches:
            if not batch.num_rows:
                continue
            some = True
            terms = np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<i4").reshape(batch.num_rows, -1)
            for at in range(0, len(terms), 20_000):
                part = terms[at : at + 20_000]
                low = _weighted(part, idf, noise)
                ones = np.sort(part, axis=1)
                first = np.concatenate([ones[:, :1] >= 0, (ones[:, 1:] != ones[:, :-1]) & (ones[:, 1:] >= 0)], axis=1)
                row, col = np.nonzero(first)
                term = ones[row, col]
                order = np.argsort(term, kind="stable")
                value = low[row[order]] * idf[term[order]][:, None]
                heads = np.flatnonzero(np.concatenate([[True], np.diff(term[order]) != 0])) if len(order) else []
                if len(heads):
                    total[term[order][heads]] += np.add.reduceat(value, heads, axis=0)
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["y"])

    total = _summed(kept.select("terms").mapInArrow(sketch, "y binary"), "y", "<f8", size * rank)
    if total is None:
        return np.zeros((size, 1), np.float32)
    y = total.reshape(size, rank)
    q, _ = np.linalg.qr(y)
    # Order the directions by what the sketch says of their singular values.
    _, s, vt = np.linalg.svd(q.T @ y, full_matrices=False)
    u = q @ np.linalg.svd(q.T @ y, full_matrices=False)[0]
    return np.ascontiguousarray(u[:, : min(setting.rank, (s > s[0] * 1e-9).sum())], np.float32)


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | (1 << i)
    row = (1 << len(a)) - 1
    full = row
    for x in b:
        hit = row & masks.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def common_run(a: list[int], b: list[int]) -> int:
    """Length of the longest run of words that both hold."""
    best, previous = 0, {}
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        if x >= 0:
            places.setdefault(x, []).append(j)
    for x in a:
        now = {j: previous.get(j - 1, 0) + 1 for j in places.get(x, ())}
        best = max(best, max(now.values(), default=0))
        previous = now
    return best


def search(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text", setting: Setting = Setting()) -> DataFrame:
    """Candidate pairs of documents and items, with the checks' results.

    Returns ``doc_key, item_key, cosine, run_words, lcs_words, item_words, figures,
    exact``, one row a pair (the best passage): the longest common run and
    subsequence of one passage, the share of the item's figures in it (1 where it
    has none), and whether at least ``setting.run`` consecutive words agree
    (``exact``). Pairs that are not exact are passages close in the latent space
    whose words stand in the item in the same order for the most part. Null or empty
    texts match nothing; an item shorter than the run can be no exact case; repeated
    rows count once; null keys of documents give a row under null. Neither items nor
    documents have a bound.
    """
    kind, item_kind = docs.schema[doc_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    columns = f"{doc_key} {kind}, {item_key} {item_kind}, cosine double, run_words int, lcs_words int, item_words int, figures double, exact boolean"
    found = None
    for block in item_blocks(items.select(F.col(item_key).alias("key"), F.col(item_text).alias("text")), setting):
        part = _search(docs, read_items(block, setting), doc_key, doc_text, item_key, item_kind, columns, setting)
        found = part if found is None else found.unionByName(part)
    return found


def _search(docs: DataFrame, known: Items, doc_key: str, doc_text: str, item_key: str, item_kind: str, columns: str, setting: Setting) -> DataFrame:
    spark, run = docs.sparkSession, setting.run
    if not known.vocabulary:
        return spark.createDataFrame([], columns)
    # Read three times and a small share of the text: written once, so that nothing is tokenised again.
    every = cut(passages(docs, doc_key, doc_text, known.vocabulary, run))
    size = len(known.vocabulary)
    seen = _summed(every.where("seen is not null"), "seen", "<i8", size)
    if seen is None:
        return spark.createDataFrame([], columns)
    windows_ = every.agg(F.sum("windows")).first()[0] or 0
    idf = np.log((1 + windows_) / (1 + seen)).astype(np.float32) + 1
    kept = every.where("terms is not null").select("key", "terms")
    basis = latent_basis(kept, idf, setting)
    asked = _weighted(known.passages, idf, basis)
    asked /= np.maximum(np.linalg.norm(asked, axis=1, keepdims=True), 1e-12)
    order = np.argsort(known.passage_item, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], np.diff(known.passage_item[order]) != 0]))
    asked, owners = np.ascontiguousarray(asked[order].T), known.passage_item[order][heads]
    sent = spark.sparkContext.broadcast((known.grams, [w.tolist() for w in known.words], known.figures, known.ids, basis, idf, asked, owners, heads))
    # As many windows at once as give some 64 MB of cosines.
    step = max(16, min(4096, (1 << 24) // asked.shape[1]))
    item_type = pa.int64() if item_kind == "bigint" else pa.int32() if item_kind == "int" else pa.string()

    def look(batches):
        grams, words, figures, ids, basis, idf, asked, owners, heads = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                terms = np.frombuffer(b"".join(part.column("terms").to_pylist()), "<i4").reshape(part.num_rows, -1)
                low = _weighted(terms, idf, basis)
                low /= np.maximum(np.linalg.norm(low, axis=1, keepdims=True), 1e-12)
                best = np.maximum.reduceat(low @ asked, heads, axis=1)
                rows = []
                which, item_at = np.nonzero(best >= setting.least_cosine)
                exact: dict[int, set[int]] = {}
                for p in np.unique(which):
                    t = terms[p]
                    exact[p] = {i for s in range(run + 1) for i in grams.get(t[s : s + run].tobytes(), ())}
                for p, c in zip(which.tolist(), item_at.tolist()):
                    i, cosine = int(owners[c]), float(best[p, c])
                    hit = i in exact[p]
                    # Paraphrases are weighed only where the latent space puts them close.
                    if not hit and cosine < setting.close_cosine:
                        continue
                    mine = terms[p].tolist()
                    lcs = common_subsequence(mine, words[i])
                    if not hit and lcs < setting.close_words * min(2 * run, len(words[i])):
                        continue
                    share = len(figures[i] & set(mine)) / len(figures[i]) if figures[i] else 1.0
                    rows.append((p, ids[i], cosine, common_run(mine, words[i]), lcs, len(words[i]), share, hit))
                if rows:
                    c = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("key").take(pa.array(c[0], pa.int64())), pa.array(c[1], item_type), pa.array(c[2], pa.float64()), *(pa.array(x, pa.int32()) for x in c[3:6]), pa.array(c[6], pa.float64()), pa.array(c[7], pa.bool_())],
                        names=[doc_key, item_key, "cosine", "run_words", "lcs_words", "item_words", "figures", "exact"],
                    )

    pairs = kept.mapInArrow(look, columns)
    best = ("cosine", "run_words", "lcs_words", "item_words", "figures", "exact")
    return pairs.groupBy(doc_key, item_key).agg(*(F.max(c).alias(c) for c in best))
