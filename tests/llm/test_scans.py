import random

import numpy as np
import pytest

from folioforge.llm import scans
from folioforge.llm.boosting import Boosted

WORDS = "harbour office measured northern fence market results storage shelves signal heating several hundred letters museum station village council reading careful district repaired because although".split()


def line_page(rng, page, body):
    return [("Northern fence near Pelley", 10.0, False), *[(b, 10.0, False) for b in body], (f"- {page} -", 10.0, False)]


def corpus(seed=1):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(WORDS) for _ in range(60)) + " first-class engine co-operative." for _ in range(60)]
    return texts


def test_noise(spark):
    rng = random.Random(3)
    clean = lambda: " ".join(rng.choice(WORDS) for _ in range(8))
    boxes, truth = [], set()
    for page in range(1, 7):
        body = [clean() for _ in range(12)]
        body[2] = "the stor@ge shelves " + body[2]
        body[4], body[5] = body[4] + " mea-", "sured " + body[5]
        body[7], body[8] = body[7] + " first-", "class " + body[8]
        body[11] = body[11] + " mar-" if page == 3 else body[11]
        body[0] = "ket " + body[0] if page == 4 else body[0]
        lines = line_page(rng, page, body)
        truth |= {(page, 0, "furniture"), (page, 13, "furniture"), (page, 3, "misread"), (page, 5, "hyphen")}
        truth |= {(page, 12, "hyphen")} if page == 3 else set()
        boxes += [("d", page, seq, f"{page}-{seq}", t, 1.0, f, b) for seq, (t, f, b) in enumerate(lines)]
    boxes += boxes[:5] + [(None, 1, 0, "n", "text", 1.0, 10.0, False), ("e", 1, 0, "m", None, 1.0, None, None)]
    frame = spark.createDataFrame(boxes, "doc_id string, page_number int, seq int, id string, text string, noise double, font_size double, is_bold boolean")
    whole = spark.createDataFrame([(t,) for t in corpus()], "text string")
    docs = spark.createDataFrame([("m", "Northern fence\n" + "\n".join([clean(), clean() + " hea-", "ting " + clean(), "wh" + clean() + " counci1 " + clean()] + [clean() + "." for _ in range(5)]) + "\n[3]", 1), ("n", None, 1), ("o", "", 1)], "doc_id string, markdown string, kind int")
    found = scans.noise(docs, frame, whole)
    got = {(r.tbl, r.doc_id, r.page_number, r.line_no, r.noise) for r in found.collect() if r.noise != "kept"}
    assert {x[2:] for x in got if x[0] == "text_boxes" and x[1] == "d"} == truth
    md = {x[3:] for x in got if x[0] == "documents_out"}
    text = scans.repaired(docs.where("markdown is not null"), found).first().text
    assert " heating " in text and " council " in text and "[3]" not in text and "hea-" not in text
    assert (2, "hyphen") in md and (4, "misread") in md and (10, "furniture") in md and (0, "furniture") not in md
    found = scans.noise(docs.limit(0), frame.limit(0), whole.limit(0))
    assert found.count() == 0


def test_paragraphs_of_pages_and_of_scans_without_noise(spark):
    lines = ["The harbour office measured the northern", "fence and the market results were kept", "by the station in the storage shelves."]
    docs = spark.createDataFrame([("clean", "\n".join(lines)), ("list", "- a\n- b\n- c"), ("empty", "")], "doc_id string, markdown string")
    page = lambda doc, no, texts: [(doc, no, k, t, 700.0 - 12 * k - 9 * (k > 2), 10.0) for k, t in enumerate(texts)]
    rows = page("reg", 1, ["Northern fence 4", "The stor@ge shelves of the", "market were seen.", "Then it was mea-"]) + page("reg", 2, ["sured, at last."]) + page("other", 1, lines)
    boxes = spark.createDataFrame(rows, "doc_id string, page_number int, seq int, text string, y_top double, font_size double")
    none = None
    found = [
        ("text_boxes", "reg", 1, 0, "furniture", none, none, none),
        ("text_boxes", "reg", 1, 1, "misread", "stor@ge", "storage", none),
        ("text_boxes", "reg", 1, 3, "hyphen", "mea", "measured", 2),
    ]
    frame = spark.createDataFrame(found, "tbl string, doc_id string, page_number int, line_no int, noise string, seen string, fixed string, next_page int")
    got = {(r.tbl, r.doc_id, r.page_number): r.text for r in scans.repaired(docs, frame, boxes).collect()}
    assert got == {
        ("documents_out", "clean", 0): " ".join(lines),
        ("text_boxes", "reg", 1): "The storage shelves of the market were seen.\n\nThen it was",
        ("text_boxes", "reg", 2): "measured, at last.",
        ("text_boxes", "other", 1): " ".join(lines),
    }


def test_copies_make_no_misreading_a_word(spark):
    rng = random.Random(4)
    clean = lambda: " ".join(rng.choice(WORDS) for _ in range(8))
    lines = [clean() for _ in range(10)]
    lines[4] = "the stor@ge " + lines[4]
    text = "\n".join(lines)
    whole = spark.createDataFrame([(t,) for t in corpus() + [text] * 30], "text string")
    assert {r.word: r.df for r in scans.lexicon(whole).collect()}["station"] <= 61
    docs = spark.createDataFrame([(f"m{k}", text) for k in range(30)], "doc_id string, markdown string")
    rows = [(f"m{k}", 1, no, x, 10.0, False) for k in range(30) for no, x in enumerate(lines)]
    boxes = spark.createDataFrame(rows, "doc_id string, page_number int, seq int, text string, font_size double, is_bold boolean")
    found = {(r.tbl, r.doc_id, r.line_no) for r in scans.noise(docs, boxes, whole).where("noise = 'misread'").collect()}
    assert found == {(t, f"m{k}", 4) for t in ("documents_out", "text_boxes") for k in range(30)}


def test_confusion_cost():
    assert scans.confusion_cost("cl@ss", "class") == 0.25
    assert scans.confusion_cost("srnall", "small") == 0.25
    assert scans.confusion_cost("planned", "planned") == 0
    assert scans.confusion_cost("plant", "plank") >= 1


def test_ranking_is_alike_at_every_size():
    words = [(w, 400) for w in WORDS] + [(w + "s", 300) for w in WORDS[:12]] + [("station", 900), ("nation", 500), ("canal", 700), ("which", 800)]
    for factor in (1, 100):
        model = scans.ranking_model([(w, d * factor) for w, d in words])
        ask = lambda seen, true, n, df: float(model.probability([scans.pair_features(seen, true, n * factor, df * factor)])[0])  # noqa: E731, B023
        assert ask("stat1on", "station", 3, 900) > 0.5 and ask("wh!ch", "which", 4, 800) > 0.5 and ask("carial", "canal", 4, 700) > 0.5
        assert ask("nation", "station", 40, 900) < 0.5 and ask("letter", "letters", 9, 400) < 0.5


def test_numbered():
    assert all(map(scans.numbered, ("- 4 -", "[12]", "— 3 —", "Page 4/5", "Seite 3 von 10", "xiv", "128", "p. 3/9")))
    assert not any(map(scans.numbered, ("2009.", "the 4", "| 12 |", "4 May 1999", "", "vivid")))


def test_boosting_learns_an_interaction():
    import numpy as np

    r = np.random.default_rng(1)
    x = r.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = Boosted().fit(x[:2000], y[:2000])
    assert ((model.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    assert len(Boosted().fit(np.zeros((0, 3)), np.zeros(0)).probability(np.zeros((2, 3)))) == 2


def test_mended():
    fix = lambda no, noise, seen=None, fixed=None: {"line_no": no, "noise": noise, "seen": seen, "fixed": fixed}
    lines = ["Title", "The stor@ge of mea-", "sured, and a first-", "[2]", "Head", "class things.", "", "Next."]
    fixes = [fix(1, "misread", "stor@ge", "storage"), fix(1, "hyphen", "mea", "measured"), fix(2, "kept", "first", "first-class"), fix(3, "furniture"), fix(4, "furniture")]
    assert scans.mended(lines, fixes) == "Title\n\nThe storage of measured, and a first-class things.\n\nNext."
    assert scans.mended([], []) == "" and scans.mended(["", " "], []) == ""


@pytest.mark.parametrize("size", [60, 400])
def test_candidates_are_those_of_all_pairs(spark, size):
    """However many words the vocabulary has, the join finds what comparing all pairs finds."""
    r = random.Random(size)
    parts = "an en er st ri lo ma te ung ion ver ge mi no al cl rn".split()
    vocabulary = sorted({"".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(size)})
    df = {w: r.choice([5, 40, 400]) for w in vocabulary}
    spoil = [p.split(":") if ":" in p else (p[0], p[1]) for p in scans.CONFUSIONS]
    suspects = {}
    for w in vocabulary[::3]:
        options = [(a, b) for a, b in spoil if a in w]
        if options:
            a, b = r.choice(options)
            suspects[w.replace(a, b, 1)] = 1
    suspects |= {w: df[w] for w in vocabulary[1::7]}
    model = scans.ranking_model(sorted(df.items()))
    got = {x.word: x.true for x in scans.corrections(spark.createDataFrame(sorted(suspects.items()), "word string, n bigint"), spark.createDataFrame(sorted(df.items()), "word string, df bigint"), model).collect()}
    want = {}
    for w, n in suspects.items():
        q = scans.width(w)
        for t, d in df.items():
            if n > max(1, scans.RARE * d) or not max(1, len(w) - 2) <= len(t) <= len(w) + 1 or not (len(t) <= 7 if q == 2 else len(t) >= 4):
                continue
            if len(scans.grams(w, q) & scans.grams(t, q)) < (2 if q == 3 or len(w) > 3 else 1):
                continue
            f = scans.pair_features(w, t, n, d)
            if f[0] <= 2:
                p = float(model.probability(np.array([f]))[0])
                want[w] = max(want.get(w, ()), (p, -f[0], f[3], t))
    assert got == {w: x[3] for w, x in want.items()} and len(got) > size / 10
