"""Packed text blocks and packed hash sets, the carriers of the span search.

Texts travel as compressed blocks of a bounded size and hashes as sorted,
delta-coded arrays, one row for each block and bucket. A row of Spark thus holds
thousands of hashes, a hash occurs at most once for each block however often the
block repeats it, and the answer to "does another record have it?" returns as one
bit a hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.runtime import cut, partitions

#: Bytes of text that a block aims at, and bytes of text whose hashes share a bucket: what one task holds at a time.
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20
#: Sizes of texts are summed by so many hash classes of keys; also the most blocks.
CLASSES = 1 << 24
#: A block of more than so many times the aim holds a hot key and is spread by its texts.
HOT = 4
#: Bits by which hashes exceed those of the texts' total length: of anchors, whose collisions only cost candidates, and of windows.
SPARE = (8, 28)
#: Characters hashed at once, which bounds the tables of powers.
CHUNK = 1 << 20
MIX_A, MIX_B, BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), 0xD6E8FEB86659FD93


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(32))) * MIX_A
    x = (x ^ (x >> np.uint64(29))) * MIX_B
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, kept by the worker."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            inverse = pow(BASE, -1, 1 << 64)
            for name, base in (("up", BASE), ("down", inverse)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))
        return cls.up[:n], cls.down[:n]


def prefix(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash over code points; one longer than ``codes``."""
    up, _ = Powers.upto(len(codes) + 1)
    terms = _values(codes)
    terms *= up[: len(codes)]
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(terms, out=out[1:])
    return out


#: The random value of each code point of the first plane.
VALUES = mixed(np.arange(1 << 16, dtype=np.uint64) + np.uint64(0x51_7C_C1))


def _values(codes: np.ndarray) -> np.ndarray:
    if len(codes) and codes.max() >= len(VALUES):
        return mixed(codes.astype(np.uint64) + np.uint64(0x51_7C_C1))
    return VALUES.take(codes)


def windows(sums: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows of ``width`` code points that start at ``at``."""
    _, down = Powers.upto(len(sums))
    return mixed((sums[at + width] - sums[at]) * down[at])


def pack(values: np.ndarray) -> bytes:
    """Sorted distinct values as gaps, in as many bits as the widest needs: whole bytes first, then the bits that are left."""
    gaps = np.diff(values, prepend=np.uint64(0))
    width = int(gaps.max()).bit_length() if len(gaps) else 0
    parts, (whole, rest) = gaps.astype("<u8").view(np.uint8).reshape(-1, 8), divmod(width, 8)
    bits = np.unpackbits(parts[:, whole : whole + 1], axis=1, bitorder="little")[:, :rest] if rest else parts[:0]
    return len(gaps).to_bytes(4, "little") + bytes([width]) + parts[:, :whole].tobytes() + np.packbits(bits).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    n, (whole, rest) = int.from_bytes(blob[:4], "little"), divmod(blob[4], 8)
    parts = np.zeros((n, 8), np.uint8)
    parts[:, :whole] = np.frombuffer(blob, np.uint8, n * whole, 5).reshape(n, whole)
    if rest:
        bits = np.unpackbits(np.frombuffer(blob, np.uint8, offset=5 + n * whole), count=n * rest).reshape(n, rest)
        parts[:, whole] = np.packbits(bits, axis=1, bitorder="little")[:, 0] if n else 0
    return np.cumsum(parts.view("<u8").ravel(), dtype=np.uint64)


def owner(key: str | None) -> int:
    """A hash of a record's key; null is a record of its own."""
    return 0 if key is None else xxhash.xxh3_64_intdigest(key) | 1


@dataclass(frozen=True)
class Layout:
    """How much is in a block and a bucket, from the bytes of all texts."""

    blocks: int
    bucket_bits: int
    #: Bits of the hashes that travel: of anchors, and of windows of the full length.
    widths: tuple[int, int]
    #: Blocks of hot keys: the first of their sub-blocks and how many.
    hot: dict[int, tuple[int, int]]

    @property
    def last(self) -> int:
        """One more than the number of the last block."""
        return self.blocks + sum(n for _, n in self.hot.values())


def laid_out(df: DataFrame, key: str, text: str, shortest: int, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> Layout:
    """The layout of ``df``: one pass that sums the texts' bytes by hash classes of their keys.

    A class of blocks has at most ``HOT`` times its aim but where a key holds more;
    such blocks are at most a quarter of all, and only their numbers reach the driver.
    """
    sized = df.where(F.length(text) >= shortest).groupBy(F.pmod(F.xxhash64(key), F.lit(CLASSES)).alias("m")).agg(F.sum(F.octet_length(text)).alias("bytes"))
    sized = cut(sized)
    total = sized.agg(F.sum("bytes")).first()[0] or 0
    power = lambda n: 1 << max(0, int(n) - 1).bit_length()
    blocks = min(CLASSES, power(max(-(-total // block_bytes), partitions(df.sparkSession))))
    buckets = power(max(-(-total // bucket_bytes), partitions(df.sparkSession)))
    heavy = sized.groupBy(F.pmod("m", F.lit(blocks)).alias("b")).agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") > HOT * max(block_bytes, total // blocks)).orderBy("b").collect()
    hot, at = {}, blocks
    for r in heavy:
        parts = -(-r.bytes // block_bytes)
        hot[r.b] = (at, parts)
        at += parts
    bits = max(buckets.bit_length() - 1, 1)
    length = max(1, int(total)).bit_length()
    return Layout(blocks, bits, tuple(min(64, max(length + s, bits + 8)) for s in SPARE), hot)


@dataclass
class Block:
    """The documents of one block, in the order of their ids."""

    number_of_block: int
    ids: list
    #: Number of each text's document; equal ids are one document.
    number: np.ndarray
    texts: list[str]

    def chunks(self):
        """(first text, code points, start of each text, ends) of about CHUNK characters at a time."""
        at = 0
        while at < len(self.texts):
            size, end = 0, at
            while end < len(self.texts) and (end == at or size + len(self.texts[end]) <= CHUNK):
                size += len(self.texts[end])
                end += 1
            codes = np.frombuffer("".join(self.texts[at:end]).encode("utf-32-le", "surrogatepass"), np.uint32)
            ends = np.cumsum([len(t) for t in self.texts[at:end]])
            yield at, codes, np.concatenate([[0], ends[:-1]]), ends
            at = end


def blocks(df: DataFrame, key: str, text: str, layout: Layout, shortest: int = 0) -> DataFrame:
    """``block int, blob binary``: all texts of at least ``shortest`` characters, by the hash of their key, those of hot keys by their own hash too."""
    home = F.pmod(F.pmod(F.xxhash64(key), F.lit(CLASSES)), F.lit(layout.blocks)).cast("int")
    source = df.select(home.alias("block"), F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where(F.length("text") >= shortest)
    out, hot = pa.schema([("block", pa.int32()), ("blob", pa.binary())]), layout.hot

    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            home = batch.column("block").to_numpy()
            if hot:
                home = home.copy()
                for i in np.flatnonzero(np.isin(home, list(hot))):
                    first, parts = hot[int(home[i])]
                    home[i] = first + xxhash.xxh3_64_intdigest(batch.column("text")[int(i)].as_py()) % parts
            for b in np.unique(home):
                part = batch.take(pa.array(np.flatnonzero(home == b))).select(["key", "text"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as to:
                    to.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([press.compress(sink.getvalue())], pa.binary())], schema=out)

    # One partition a block, however few the session shuffles to: a task's share does not grow with the texts.
    return source.mapInArrow(run, "block int, blob binary").repartitionById(layout.last, "block")


def opened(rows: pa.Table) -> Block:
    """The documents in the blobs of one block."""
    press, keys, texts = zstandard.ZstdDecompressor(), [], []
    for blob in rows.column("blob").to_pylist():
        part = pa.ipc.open_stream(press.decompress(blob)).read_all()
        keys += part.column("key").to_pylist()
        texts += part.column("text").to_pylist()
    order = sorted(range(len(keys)), key=lambda i: (keys[i] is not None, keys[i] or "", texts[i]))
    ids = [keys[i] for i in order]
    number = np.cumsum([k > 0 and ids[k] != ids[k - 1] for k in range(len(ids))]).astype(np.int64)
    return Block(rows.column("block")[0].as_py(), ids, number, [texts[i] for i in order])


class Hashes:
    """The distinct hashes of a block, cut to the bits that travel."""

    def __init__(self, block: Block, hashes: np.ndarray, documents: np.ndarray, layout: Layout, stage: int):
        self.block, self.buckets, width = block, layout.bucket_bits, layout.widths[stage - 1]
        self.low = np.uint64(width - layout.bucket_bits)
        keys = hashes >> np.uint64(64 - width)
        order = np.argsort(keys)
        keys, documents = keys[order], documents[order]
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.values = keys[start]
        size = np.diff(np.append(start, len(keys)))
        self.inverse = np.empty(len(keys), np.int64)
        self.inverse[order] = np.repeat(np.arange(len(start)), size)
        least, most = (np.minimum.reduceat(documents, start), np.maximum.reduceat(documents, start)) if len(start) else (np.zeros(0, np.int64),) * 2
        #: Whether two documents of this block have the hash.
        self.local = least != most
        # Records of a hot key lie in several blocks, so their hashes name their owner; others are known by their block.
        self.owners = np.array([owner(block.ids[i]) for i in np.unique(block.number, return_index=True)[1]], np.uint64)[least] if block.number_of_block >= layout.blocks and len(start) else None
        self.home = self.values >> self.low
        self.edges = np.searchsorted(self.home, np.arange((1 << self.buckets) + 1, dtype=np.uint64))

    def rows(self) -> pa.Table:
        some = np.flatnonzero(np.diff(self.edges)).tolist()
        low = self.values & ((np.uint64(1) << self.low) - np.uint64(1))
        part = [slice(self.edges[b], self.edges[b + 1]) for b in some]
        names = [None] * len(some) if self.owners is None else [self.owners[p].astype("<u8").tobytes() for p in part]
        return pa.table(
            {
                "block": pa.array([self.block.number_of_block] * len(some), pa.int32()),
                "bucket": pa.array(some, pa.int32()),
                "blob": pa.array([pack(low[p]) for p in part], pa.binary()),
                "owners": pa.array(names, pa.binary()),
            }
        )

    def shared(self, replies: dict[int, bytes]) -> np.ndarray:
        """For each hash as it was given: whether another document has it."""
        flags = self.local.copy()
        for b, bits in replies.items():
            n = self.edges[b + 1] - self.edges[b]
            flags[self.edges[b] : self.edges[b + 1]] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
        return flags[self.inverse] if len(self.inverse) else np.zeros(0, bool)


PACKED = "block int, bucket int, blob binary, owners binary"


def repeated(df: DataFrame, layout: Layout) -> DataFrame:
    """``block, bucket, bits``: which hashes of each packed row another record has too, in another block.

    One group for each bucket. A hash stands once in a row, so a hash that a third
    of all texts repeat has one entry for each block, not for each text.
    """

    def run(rows: pa.Table) -> pa.Table:
        blobs = [unpack(x) for x in rows.column("blob").to_pylist()]
        sizes = np.array([len(x) for x in blobs])
        every = np.concatenate(blobs)
        # A block's own number stands for its records, which no other block has.
        who = np.repeat(rows.column("block").to_numpy().astype(np.uint64) << np.uint64(1), sizes)
        ends = np.cumsum(sizes)
        for k, names in enumerate(rows.column("owners").to_pylist()):
            if names is not None:
                who[ends[k] - sizes[k] : ends[k]] = np.frombuffer(names, "<u8")
        order = np.argsort(every)
        sorted_, who = every[order], who[order]
        start = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        several = np.minimum.reduceat(who, start) != np.maximum.reduceat(who, start)
        twice = np.zeros(len(every), bool)
        twice[order] = np.repeat(several, np.diff(np.append(start, len(every))))
        bits = [np.packbits(twice[e - n : e]).tobytes() if twice[e - n : e].any() else None for n, e in zip(sizes, ends)]
        keep = pa.array([i for i, x in enumerate(bits) if x is not None], pa.int64())
        return pa.table({"block": rows.column("block").take(keep), "bucket": rows.column("bucket").take(keep), "bits": pa.array([bits[i] for i in keep.to_pylist()], pa.binary())})

    return df.repartitionById(1 << layout.bucket_bits, "bucket").groupBy("bucket").applyInArrow(run, "block int, bucket int, bits binary")
