import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioforge.llm import splitting


def joined(text, ends, overlap):
    return "".join(text[(ends[k - 1] if k else 0) : e] for k, e in enumerate(ends))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n#,é", max_size=400), st.integers(5, 60), st.data())
def test_pieces_cover_and_keep_the_limit(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    ends = splitting.cuts(text, limit, overlap)
    assert joined(text, ends, overlap) == text
    starts = [0, *(e - overlap for e in ends[:-1])]
    assert all(0 < e - s <= limit for s, e in zip(starts, ends))
    assert ends == sorted(set(ends))
    if len(text) > limit:
        assert len(ends) >= -(-(len(text) - overlap) // (limit - overlap))


def test_cut_falls_on_a_paragraph():
    text = "\n\n".join("word " * 100 for _ in range(20))
    for end in splitting.cuts(text, 3000, 100)[:-1]:
        assert text[end - 2 : end] == "\n\n"


def test_bad_overlap():
    with pytest.raises(ValueError):
        splitting.cuts("abc", 10, 10)


def test_frame_edges(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abc d.\n") for _ in range(50_000))
    rows = [("a", None, 1), ("b", "", 2), (None, "y" * 101, 3), ("d", long, 4), ("d", long, 4)]
    df = spark.createDataFrame(rows, "doc_id string, markdown string, piece_no int")
    got = splitting.split(df, limit=100, overlap=10).collect()
    assert {r.doc_id for r in got} == {None, "d"}
    one = sorted((r.piece_no, r.start, r.piece) for r in got if r.doc_id == "d")
    half = one[::2]
    assert half == one[1::2]
    assert half[0][2] + "".join(p[2][10:] for p in half[1:]) == long
    assert splitting.split(df.limit(0)).count() == 0
