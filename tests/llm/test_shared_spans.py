import random

import numpy as np
import pytest

from folioforge.llm import shared_spans
from folioforge.llm.packed import pack, unpack


def brute(rows, span):
    """Shared characters of each text, window by window."""
    homes = {}
    for key, text in rows:
        for i in range(len(text or "") - span + 1):
            homes.setdefault(text[i : i + span], set()).add(key)
    out = {}
    for key, text in rows:
        inside = set()
        for i in range(len(text or "") - span + 1):
            if len(homes[text[i : i + span]]) > 1:
                inside.update(range(i, i + span))
        if inside:
            out[key] = len(inside)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(40):
        text = "".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 300)))
        if rows and rng.random() < 0.7:
            other = rng.choice(rows)[1]
            at = rng.randint(0, max(0, len(other) - 1))
            text = text[:50] + other[at : at + rng.randint(10, 90)] + text[50:]
        rows.append((k, text))
    rows += [(100, rows[3][1]), (101, "𝔘nicode " * 20), (102, "𝔘nicode " * 20)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r.doc_id: r.shared_chars for r in shared_spans.shared(df, span=40, period=13).collect()}
    assert got == brute(rows, 40)


def test_edges(spark):
    long = "x" * 50_000
    rows = [(1, None, 1), (2, "", 1), (3, "short", 1), (4, long, 1), (4, long, 1), (None, "y" * 400, 1), (5, "y" * 400, 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spans int")
    got = {r.doc_id: (r.n_chars, r.shared_chars, r.spans) for r in shared_spans.shared(df).collect()}
    # A row repeated under its own key shares nothing; a null key is a record of its own.
    assert got == {None: (400, 400, 1), 5: (400, 400, 1)}
    assert shared_spans.shared(df.limit(0)).count() == 0


@pytest.mark.parametrize("sizes", [(2_000, 3_000), (200, 500)])
def test_one_key_with_a_third_of_all_rows(spark, sizes):
    rng = random.Random(7)
    rows = []
    for k in range(90):
        text = "".join(rng.choice("abcdé ") for _ in range(rng.randint(40, 300)))
        if rows and rng.random() < 0.7:
            other = rng.choice(rows)[1]
            at = rng.randint(0, len(other) - 1)
            text = text[:50] + other[at : at + rng.randint(10, 90)] + text[50:]
        rows.append((k if k % 3 else 0 if k % 2 else None, text))
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = sorted((str(r.doc_id), r.n_chars, r.shared_chars) for r in shared_spans.shared(df, span=40, period=13, block_bytes=sizes[0], bucket_bytes=sizes[1]).collect())
    homes = {}
    for key, text in rows:
        for i in range(len(text) - 39):
            homes.setdefault(text[i : i + 40], set()).add(key)
    want = []
    for key, text in rows:
        inside = {c for i in range(len(text) - 39) if len(homes[text[i : i + 40]]) > 1 for c in range(i, i + 40)}
        want += [(str(key), len(text), len(inside))] if inside else []
    assert got == sorted(want)


def test_collisions_of_anchors_cost_nothing(spark, monkeypatch):
    from folioforge.llm import packed

    # Hashes of next to no bits collide all the time; the windows around them are compared again.
    monkeypatch.setattr(packed, "SPARE", (-4, 28))
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice("abcdefgh") for _ in range(400))) for k in range(30)]
    rows += [(50, rows[0][1][100:300] + "z" * 90)]
    got = {r.doc_id: r.shared_chars for r in shared_spans.shared(spark.createDataFrame(rows, "doc_id int, text string"), span=60, period=13).collect()}
    assert got == brute(rows, 60)


@pytest.mark.parametrize("period", [1, 2, 5, 13, 50, 73, 101])
def test_cover_meets_every_residue(period):
    places = shared_spans.cover(period)
    assert len({(a - b) % period for a in places for b in places}) == period


def test_pack_round_trip():
    for values in ([], [0], [7], [255, 511], [5, 6, 1 << 39], [1 << 63, (1 << 64) - 1], list(range(0, 10**12, 10**10 + 7)), list(range(3, 9000, 3))):
        array = np.array(values, np.uint64)
        assert (unpack(pack(array)) == array).all()
