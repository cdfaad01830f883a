"""Problem 8: fill containers of fixed capacity with documents.

Variable-capacity best-fit. All items are counted by their size, which takes one
number for each size up to the capacity however many items there are. The plan
is made on these counts: each size, from the largest, goes to the open bins it
fits best, new bins open at the permitted length that costs least, and in the
end each bin shrinks to the least permitted length of its contents. Items then
find their bins by their rank within their size.
"""

from __future__ import annotations

import base64
import bisect

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.runtime import cut, partitions

CAPACITY = 2048
#: Permitted lengths of a container.
LENGTHS = (256, 512, 1024, 2048)
#: What opening one more container costs, in tokens.
OPENING = 16


def default_tokenizer() -> str:
    """Path of the vocabulary used where none is given."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def tokenizer(path: str):
    """The encoding of a vocabulary file of ranks; nothing is fetched or trained."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """``key, tokens`` of each row; null texts have null, empty ones 0. Repeated rows repeat."""
    path = path or default_tokenizer()
    kept: list = []

    def run(batches):
        if not kept:
            kept.append(tokenizer(path))
        for batch in batches:
            sizes = [None if t is None else len(kept[0].encode_ordinary(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sizes, pa.int64())], names=["key", "tokens"])

    source = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return source.mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, tokens bigint").withColumnRenamed("key", key)


#: Ranges of bins for each size of an item that a plan may need.
MOST_RANGES = 32


def plan(counts: dict[int, int], lengths: tuple[int, ...] = LENGTHS, opening: int = OPENING) -> list[tuple[int, dict[int, int], int]]:
    """Bins for items counted by size: [(how many, {size: items in each}, final length)].

    Sizes run from the largest; each goes to the open bins with the least room that
    takes it, and opens new ones of the length whose cost for each token of this
    size is least. Raises ValueError for a size beyond the largest length.
    """
    lengths = tuple(sorted(set(lengths)))
    if any(s > lengths[-1] or s < 1 for s in counts):
        raise ValueError("an item is larger than the largest container, or empty")
    room: dict[int, list[list]] = {}
    spaces: list[int] = []

    def put(space: int, group: list) -> None:
        if space not in room:
            room[space] = []
            bisect.insort(spaces, space)
        room[space].append(group)

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect.bisect_left(spaces, size)
            if at < len(spaces):
                space = spaces[at]
                group = room[space][-1]
                # As many of this size as stay a best fit: all bins of the group take equally many.
                each = min(space // size, -(-left // group[0]))
                used = min(group[0], left // each) or 1
                each = each if used * each <= left else left
                room[space].pop()
                if used < group[0]:
                    room[space].append([group[0] - used, group[1]])
                if not room[space]:
                    del room[space]
                    spaces.pop(at)
                put(space - each * size, [used, {**group[1], size: group[1].get(size, 0) + each}])
                left -= used * each
            else:
                length = min((x for x in lengths if x >= size), key=lambda x: ((x + opening) / (x // size * size), -x))
                each = min(length // size, left)
                used = left // each
                put(length - each * size, [used, {size: each}])
                left -= used * each
    bins = []
    for space in spaces:
        for used, items in room[space]:
            filled = sum(s * k for s, k in items.items())
            bins.append((used, items, next(x for x in lengths if x >= filled)))
    return sorted(bins, key=lambda b: (-b[2], -b[0], sorted(b[1].items())))


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, lengths: tuple[int, ...] = LENGTHS, spread: int = 8) -> DataFrame:
    """The containers of all documents: ``key, part, parts, token_start, tokens, bin, bin_length``.

    A document within the largest length is one part; a larger one fills containers
    of its own and leaves a last part that is packed like a document. Null and
    empty texts take no container: their ``bin`` is null. Repeated rows are
    documents of their own. The same input gives the same bins, whatever its order
    and partitions, except that exact repeats may change places.
    """
    capacity = max(lengths)
    counted = token_counts(df, key, text, path)
    whole = (F.col("tokens") / capacity).cast("bigint")
    parts = F.greatest(F.lit(1), F.ceil(F.col("tokens") / capacity)).cast("int")
    # Tokenised once: sizes are a small share of the texts.
    items = cut(
        counted.withColumn("parts", F.coalesce(parts, F.lit(1)))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("token_start", F.col("part").cast("bigint") * capacity)
        .withColumn("size", F.least(F.col("tokens") - F.col("token_start"), F.lit(capacity)))
        .withColumn("full", F.coalesce(F.col("part") < whole, F.lit(False)))
        .withColumn("slot", F.pmod(F.xxhash64(F.col(key).cast("string"), "part"), F.lit(spread * partitions(df.sparkSession))).cast("int"))
        .select(key, "part", "parts", "token_start", "size", "full", "slot")
    )
    loose = items.where(~F.col("full") & (F.col("size") > 0))
    # At most one row for each size and slot; the plan needs one for each size.
    sizes = cut(loose.groupBy("size", "slot").agg(F.count("*").alias("n")))
    counts = {r.size: r.n for r in sizes.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    ranges, base, taken = [], 0, dict.fromkeys(counts, 0)
    for used, inside, length in plan(counts, lengths):
        for size, each in inside.items():
            ranges.append((size, taken[size], taken[size] + used * each, each, base, length))
            taken[size] += used * each
        base += used
    spark = df.sparkSession
    # A few rows for each size, whatever the number of documents: sent to every task where that holds.
    shelf = spark.createDataFrame(ranges, "size bigint, low bigint, high bigint, each int, base bigint, bin_length int")
    if len(ranges) <= MOST_RANGES * capacity:
        shelf = F.broadcast(shelf)
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    # Ranks within a size and slot: a size that a third of all documents have is still spread over all slots.
    ranked = loose.withColumn("at", F.row_number().over(Window.partitionBy("size", "slot").orderBy(F.col(key).asc_nulls_first(), "part")) - 1)
    ranked = ranked.join(before, ["size", "slot"]).withColumn("rank", F.col("before") + F.col("at"))
    placed = ranked.join(shelf, "size").where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    number = F.col("base") + ((F.col("rank") - F.col("low")) / F.col("each")).cast("bigint")
    columns = (key, "part", "parts", "token_start", F.col("size").alias("tokens"))
    shared = placed.select(*columns, F.concat(F.lit("s"), number.cast("string")).alias("bin"), "bin_length")
    own = items.where("full").select(*columns, F.concat(F.lit("d"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("."), F.col("part").cast("string")).alias("bin"), F.lit(capacity).alias("bin_length"))
    none = items.where("not full and coalesce(size, 0) = 0").select(*columns, F.lit(None).cast("string").alias("bin"), F.lit(None).cast("int").alias("bin_length"))
    return shared.unionByName(own).unionByName(none)
