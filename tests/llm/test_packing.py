import random
from collections import Counter

import pytest

from folioforge.llm import packing


@pytest.mark.parametrize("seed", range(40))
def test_plan_holds_everything(seed):
    r = random.Random(seed)
    counts = {r.randint(1, 2048): r.randint(1, 60) for _ in range(r.randint(1, 80))}
    held = Counter()
    for used, items, length in packing.plan(counts):
        filled = sum(s * k for s, k in items.items())
        assert filled <= length and all(x < filled for x in packing.LENGTHS if x < length)
        for size, k in items.items():
            held[size] += used * k
    assert held == Counter(counts)


def test_plan_wastes_little():
    r = random.Random(3)
    counts = Counter(min(2047, int(r.lognormvariate(6.3, 0.7)) + 1) for _ in range(20_000))
    bins = packing.plan(counts)
    assert sum(s * n for s, n in counts.items()) > 0.99 * sum(u * length for u, _, length in bins)


def test_bad_sizes():
    with pytest.raises(ValueError):
        packing.plan({5000: 1})


def test_pack(spark):
    r = random.Random(4)
    rows = [(k, " ".join(r.choice(["court", "fence", "naïve", "market"]) for _ in range(r.randint(1, 900))), 7) for k in range(120)]
    rows += [(200, None, 1), (201, "", 1), (202, "word " * 9000, 1), (5, rows[5][1], 7), (None, "null key", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, bin int")
    got = packing.pack(df).collect()
    bins = {}
    for x in got:
        if x.bin is None:
            assert not x.tokens
        else:
            bins.setdefault((x.bin, x.bin_length), []).append(x.tokens)
    assert len({b for b, _ in bins}) == len(bins)
    assert all(sum(sizes) <= length for (_, length), sizes in bins.items())
    size = {r.doc_id: r.tokens for r in packing.token_counts(df, "doc_id", "text").collect()}
    total = Counter()
    for x in got:
        total[x.doc_id] += x.tokens or 0
        assert x.parts == 1 or size[x.doc_id] > packing.CAPACITY
    assert total[202] == size[202] and total[5] == 2 * size[5] and {200, 201, None} <= set(total)
    assert packing.pack(df.limit(0)).count() == 0
