"""Problem 4: text that was decoded with another charset than it had.

Every clean word of the corpus is garbled under every chain of a writing and a
reading charset; the tokens of the corpus are hash-joined against that table.
Hits name the records and the chain, and verified originals are put back.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.runtime import cut

#: Single-byte charsets a text may have been written or read in.
SINGLE = ("cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "koi8-r", "iso8859-5", "cp866", "mac_roman", "cp850", "cp437")
#: More of them, and charsets of two bytes a sign, which are taken with UTF-8 and the Western ones only.
RARER = ("cp1253", "cp1254", "cp1257", "iso8859-7", "iso8859-9", "iso8859-15")
DOUBLE = ("gbk", "big5", "shift_jis", "euc_jp", "euc_kr", "utf-16-le", "utf-16-be")
WESTERN = ("cp1252", "latin-1")
#: Written in the first, read in the second; some twice over. What latin-1 writes, cp1252 reads alike.
CHAINS = tuple(
    [("utf-8", c) for c in SINGLE]
    + [("utf-8", c, "utf-8", c) for c in ("cp1252", "latin-1", "cp1250", "mac_roman", "cp1251")]
    + [(a, b) for a in SINGLE for b in SINGLE if a != b and {a, b} != {"cp1252", "latin-1"}]
    + [(a, "utf-8?") for a in ("cp1252", "cp1250", "cp1251", "mac_roman", "cp850", "koi8-r")]
    + [("cp1252", "latin-1")]
    + [("utf-8", c) for c in RARER + DOUBLE]
    + [("utf-8", c, "utf-8", c) for c in ("cp1254", "iso8859-15", "cp437", "cp850")]
    + [pair for c in RARER for w in WESTERN for pair in ((c, w), (w, c))]
    + [pair for c in DOUBLE[:5] for w in WESTERN for pair in ((c, w), (w, c))]
)
LOST = "�"
QUOTES = "’‘“”„«»‹›‚"
DASHES = "–—…‐‑•·¿¡"
#: Signs that stand by themselves or beside figures in clean text.
SIGNS = frozenset("€£©®™°§№½¼¾²³º ª±×÷µ    　→←≥≤≠")
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@lru_cache(maxsize=None)
def byte_table(charset: str) -> tuple[str, dict[str, int]]:
    """The 256 characters of a charset, undefined bytes read as C1 controls as browsers do."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(charset))
        except UnicodeDecodeError:
            chars.append(chr(b))
    back: dict[str, int] = {}
    for b, c in enumerate(chars):
        back.setdefault(c, b)
    return "".join(chars), back


def write(text: str, charset: str) -> bytes | None:
    if charset == "utf-8":
        return text.encode("utf-8", "surrogatepass")
    if charset in DOUBLE:
        try:
            return text.encode(charset)
        except UnicodeEncodeError:
            return None
    back = byte_table(charset)[1]
    try:
        return bytes([back[c] for c in text])
    except KeyError:
        return None


def read(data: bytes, charset: str) -> str | None:
    if charset == "utf-8?":
        return data.decode("utf-8", "replace")
    if charset == "utf-8" or charset in DOUBLE:
        try:
            return data.decode(charset)
        except UnicodeDecodeError:
            return None
    chars = byte_table(charset)[0]
    return "".join([chars[b] for b in data])


def garble(text: str, chain: tuple[str, ...]) -> str | None:
    """``text`` after each (written, read) step of ``chain``; None where a charset lacks a character."""
    for a, b in zip(chain[::2], chain[1::2]):
        data = write(text, a)
        text = read(data, b) if data is not None else None
        if text is None:
            return None
    return text


def restore(text: str, chain: tuple[str, ...]) -> str | None:
    """The inverse of :func:`garble`; None where it can't be undone."""
    if chain[-1] == "utf-8?":
        return None
    return garble(text, tuple(reversed(chain)))


def strange(token: str) -> bool:
    """Whether the shape of ``token`` is one that no clean word has.

    Clean are letters of one script in lower, upper or title case, with quotes and
    dashes at their places; signs only where no letter stands beside them.
    """
    scripts, before = set(), ""
    letters = any(c.isalpha() and c not in "ªº" for c in token)
    for k, c in enumerate(token):
        o = ord(c)
        if o < 128:
            kind = "L" if c.isalpha() else "x"
        elif c == LOST or 0x80 <= o < 0xA0:
            return True
        elif c in QUOTES:
            # Inside a word only the apostrophe; a low quote opens, and no quote follows another.
            if c in "‚„" and before.isalpha() or before in QUOTES and before:
                return True
            kind = "x"
        elif c in DASHES or 0x300 <= o < 0x370:
            if c == "·" and before.isalpha() or c in "¿¡" and before.isalpha():
                return True
            kind = "x"
        elif c in "ªº":
            if before.isalpha():
                return True
            kind = "x"
        elif c.isalpha():
            kind = "L"
            if o >= 0x250 and not 0x400 <= o < 0x530 and not 0xFB00 <= o < 0xFB07 and not 0x370 <= o < 0x400 and not 0xFF00 <= o < 0xFFF0:
                return True
            if 0x400 <= o < 0x460 and not (0x410 <= o < 0x450 or c in "ёЁіІїЇєЄ"):
                return True
        elif c in SIGNS:
            if letters and (before.isalpha() or c in "¼½¾"):
                return True
            kind = "x"
        else:
            return True
        if kind == "L":
            scripts.add("c" if 0x400 <= o < 0x530 else "l")
            if c.isupper() and before.islower() and o >= 128:
                return True
            if before.isupper() and c.islower() and k > 1 and token[k - 2].isupper() and (o >= 128 or ord(before) >= 128) and token[k - 2].isalpha():
                return True
        before = c
    # A capital vowel with an accent inside a word of small letters, seen from the left.
    return len(scripts) > 1 or bool(LOWER_UPPER.search(token))


LOWER_UPPER = re.compile(r"[a-zß-öø-ÿа-яё][À-ÖØ-ÞŸŠŽŒА-ЯЁ]")


def tokens(text: str) -> list[str]:
    """Pieces between plain spaces and line ends that hold more than ASCII, without ASCII signs at their ends."""
    if text.isascii():
        return []
    out = []
    for w in text.replace("\n", " ").replace("\t", " ").replace("|", " ").split(" "):
        if not w.isascii():
            w = w.strip(EDGE)
            if len(w) <= 60:
                out.append(w)
            else:
                out += [w[i : i + 60] for i in range(0, len(w), 60)]
    return out


def forms(word: str) -> dict[str, tuple[str, ...]]:
    """Every garbled form of ``word`` with the first chain that gives it."""
    out: dict[str, tuple[str, ...]] = {}
    for chain in CHAINS:
        bad = garble(word, chain)
        if bad is not None and bad != word and not bad.isascii():
            # Tokens are cut at spaces, so that only the longest piece can be met again.
            bad = bad.replace("\n", " ").strip(EDGE + " ")
            if bad and " " not in bad:
                out.setdefault(bad, chain)
    return out


#: A strange token must be at least this long, one of clean shape this long.
LEAST_STRANGE, LEAST_CLEAN = 2, 4
#: Distinct strange tokens a chain must explain before tokens of clean shape count.
LEAST_CHAIN = 5
#: Hits up to which the table is sent to every task; a larger one is joined by shuffle.
MOST_SENT = 200_000


def _counted(df: DataFrame) -> DataFrame:
    """``token, n``: in how many texts each token stands; ``df`` has a column ``text``."""

    def run(batches):
        for batch in batches:
            seen: dict[str, int] = {}
            for text in batch.column("text").to_pylist():
                for t in set(tokens(text)):
                    seen[t] = seen.get(t, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])

    return df.where("text is not null").select("text").mapInArrow(run, "token string, n bigint")


def garbled_table(texts: list[DataFrame]) -> DataFrame:
    """``token, original, chain, strong``: the corpus tokens that are garbled forms of clean corpus words.

    ``texts`` are frames with a column ``text``. A token of strange shape is a hit
    when some clean word gives it; one of clean shape only when its chain explains
    enough strange tokens and the other direction does not, or its original is
    much more frequent.
    """
    counted = _counted(texts[0])
    for more in texts[1:]:
        counted = counted.unionByName(_counted(more))
    words = cut(counted.where("token <> ''").groupBy("token").agg(F.sum("n").alias("n")))

    def shapes(batches):
        for batch in batches:
            flags = [strange(t) for t in batch.column("token").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flags, pa.bool_())], names=["token", "n", "strange"])

    def spread(batches):
        for batch in batches:
            rows = [(f, w, n, CHAINS.index(c)) for w, n in zip(batch.column("token").to_pylist(), batch.column("n").to_pylist()) if not strange(w) for f, c in forms(w).items()]
            c = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.string()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int32())], names=["token", "original", "m", "chain"])

    shaped = words.mapInArrow(shapes, "token string, n bigint, strange boolean")
    garbled = words.mapInArrow(spread, "token string, original string, m bigint, chain int")
    # One original a token: the most frequent, of equals the least.
    best = garbled.groupBy("token").agg(F.max_by(F.struct("original", "m", "chain"), F.struct("m", "original")).alias("b")).select("token", "b.*")
    found = cut(shaped.join(best, "token").withColumn("lost", F.col("token").contains(LOST)))
    strong = F.col("strange") & ~F.col("lost") & (F.length("token") >= LEAST_STRANGE)
    # At most one row for each chain.
    weight = {r.chain: r.s for r in found.where(strong).groupBy("chain").agg(F.count("*").alias("s")).collect()}
    trusted, one_way = [], []
    for k, chain in enumerate(CHAINS):
        back = tuple(reversed(chain))
        other = weight.get(CHAINS.index(back), 0) if back in CHAINS else 0
        if weight.get(k, 0) >= LEAST_CHAIN:
            trusted.append(k)
            if weight[k] > 4 * other:
                one_way.append(k)
    weak = ~F.col("strange") & (F.length("token") >= LEAST_CLEAN) & F.col("chain").isin(trusted) & (F.col("chain").isin(one_way) | (F.col("m") >= 3 * F.col("n")))
    return found.withColumn("strong", strong).where(strong | weak | F.col("lost")).select("token", "original", "chain", "strong", "lost")


def damaged(df: DataFrame, table: DataFrame, keys: list[str], text: str, group: str | None = None) -> DataFrame:
    """Rows whose text was wrongly decoded: ``keys, restored`` (null where it can't be had).

    Null and blank texts are no cases, repeated rows count once, other columns are
    ignored. With ``group``, a row without a hit of its own is a case too when other
    rows of its group hold at least two strong hits of a chain that turns the row's
    tokens into clean ones: short fragments share their document's fate.
    """
    rows = df.select(*keys, F.col(text).alias("text")).where("text is not null").where(~F.col("text").rlike(r"^[\x00-\x7f]*$"))
    sent = table.limit(MOST_SENT + 1).collect()
    if len(sent) <= MOST_SENT:
        direct = _looked_up(rows, keys, {r.token: (r.original, r.chain, r.strong, r.lost) for r in sent})
    else:
        direct = _joined(rows, table, keys)
    if not group:
        return direct.where("hit").select(*keys, "restored").distinct()
    direct = cut(direct)
    # A repeated row is no second proof.
    proofs = direct.where("hit").select(*keys, "text", "chains").distinct()
    chains = proofs.select(group, F.explode("chains").alias("chain")).groupBy(group, "chain").count().where("count >= 2")
    proof = chains.groupBy(group).agg(F.collect_set("chain").alias("proof"))
    rest = direct.where(~F.col("hit")).join(proof, group)
    kinds = ", ".join(f"{k} {direct.schema[k].dataType.simpleString()}" for k in keys)

    def look(batches):
        for batch in batches:
            keep, new = [], []
            for at, (text_, proof_) in enumerate(zip(batch.column("text").to_pylist(), batch.column("proof").to_pylist())):
                for c in sorted(proof_):
                    back = [(t, restore(t, CHAINS[c])) for t in tokens(text_)]
                    good = [(t, r) for t, r in back if r and r != t and not strange(r)]
                    if good and len(good) == len(back):
                        for t, r in good:
                            text_ = text_.replace(t, r)
                        keep.append(at)
                        new.append(text_)
                        break
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(keep, pa.int64())) for k in keys), pa.array(new, pa.string())], names=[*keys, "restored"])

    more = rest.mapInArrow(look, f"{kinds}, restored string")
    return direct.where("hit").select(*keys, "restored").unionByName(more).distinct()


def _judged(text: str, hits: list[tuple[str, tuple]]) -> tuple[bool, list[int], str | None]:
    """(affected, chains of the strong hits, restored text) from the hits among a text's tokens."""
    lost, chains = LOST in text, [c for _, (_, c, strong, _) in hits if strong]
    if not hits and not lost:
        return False, [], None
    swaps = {t: o for t, (o, _, _, _) in hits}
    main = max(set(chains), key=lambda c: (chains.count(c), -c)) if chains else None
    out = []
    for line in text.split("\n"):
        mine = tokens(line)
        here = {t: swaps[t] for t in mine if t in swaps}
        if main is not None and len(here) < len(mine):
            back = {t: r for t in mine if t not in here and (r := restore(t, CHAINS[main])) and not strange(r)}
            # A line is garbled as a whole, unless some token of it can't be.
            whole = bool(here) and len(here) + len(back) == len(set(mine))
            here |= {t: r for t, r in back.items() if whole or strange(t)}
        for t in sorted(here, key=len, reverse=True):
            line = line.replace(t, here[t])
        out.append(line)
    new = "\n".join(out)
    return True, chains, None if LOST in new else new


JUDGED = "text string, hit boolean, chains array<int>, restored string"


def _rows(batch: pa.RecordBatch, keys: list[str], found: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*found)) or [()] * 3
    return pa.RecordBatch.from_arrays([*(batch.column(k) for k in [*keys, "text"]), pa.array(c[0], pa.bool_()), pa.array(c[1], pa.list_(pa.int32())), pa.array(c[2], pa.string())], names=[*keys, "text", "hit", "chains", "restored"])


def _kinds(rows: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)


def _looked_up(rows: DataFrame, keys: list[str], table: dict) -> DataFrame:
    """Rows as they are, with what is found of each by a table that every task receives."""
    sent = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        known = sent.value
        for batch in batches:
            yield _rows(batch, keys, [_judged(text, [(t, known[t]) for t in dict.fromkeys(tokens(text)) if t in known]) for text in batch.column("text").to_pylist()])

    return rows.mapInArrow(run, f"{_kinds(rows, keys)}, {JUDGED}")


def _joined(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """The same, repeated rows once, through a shuffled join, for tables of any size."""
    # Tokens meet the table beside a hash of their row; texts are not carried along.
    rows = rows.distinct().withColumn("h", F.xxhash64(*keys, "text"))

    def split(batches):
        for batch in batches:
            at, out = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                mine = list(dict.fromkeys(tokens(text)))
                at += [k] * len(mine)
                out += mine
            yield pa.RecordBatch.from_arrays([batch.column("h").take(pa.array(at, pa.int64())), pa.array(out, pa.string())], names=["h", "token"])

    met = rows.select("h", "text").mapInArrow(split, "h bigint, token string").join(table, "token")
    hits = met.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("token", "original", "chain", "strong", "lost"))).alias("hits"))

    def judge(batches):
        for batch in batches:
            found = []
            for text, mine in zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist()):
                found.append(_judged(text, [(m["token"], (m["original"], m["chain"], m["strong"], m["lost"])) for m in mine or ()]))
            yield _rows(batch, keys, found)

    return rows.join(hits, "h", "left").select(*keys, "text", "hits").mapInArrow(judge, f"{_kinds(rows, keys)}, {JUDGED}")
