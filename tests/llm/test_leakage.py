import random

from folioforge.llm import leakage
from folioforge.llm.leakage import common_run, common_subsequence, tokens


def test_all_planted_runs_are_found(spark):
    rng = random.Random(2)
    common = [f"w{i}" for i in range(60)]
    special = [f"item{i}" for i in range(300)]
    items = [(k, " ".join(rng.choice(special if rng.random() < 0.4 else common) for _ in range(rng.randint(12, 40)))) for k in range(30)]
    docs = []
    for k in range(200):
        words = [rng.choice(common) for _ in range(rng.randint(0, 120))]
        if rng.random() < 0.5:
            source = items[rng.randrange(30)][1].split()
            size = rng.randint(8, 20)
            at = rng.randint(0, max(0, len(source) - size))
            place = rng.randint(0, len(words))
            words[place:place] = [w.upper() if rng.random() < 0.2 else w + rng.choice(["", ",", " –", "\n"]) for w in source[at : at + size]]
        docs.append((k, " ".join(words)))
    expected = set()
    for d, text in docs:
        words = tokens(text)
        runs = {tuple(words[i : i + 12]) for i in range(len(words) - 11)}
        for i, item in items:
            w = tokens(item)
            if any(tuple(w[k : k + 12]) in runs for k in range(len(w) - 11)):
                expected.add((d, i))
    found = leakage.search(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id bigint, text string")).where("exact")
    assert {(r.doc_id, r.item_id) for r in found.collect()} == expected


def test_items_of_any_number_are_searched_in_blocks(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    items = [(k, " ".join(rng.choice(words) for _ in range(30))) for k in range(40)]
    docs = [(k, " ".join(rng.choice(words) for _ in range(30)) + " " + " ".join(items[k % 40][1].split()[5:20]) + " " + " ".join(rng.choice(words) for _ in range(20))) for k in range(60)]
    d, i = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    small = leakage.Setting(max_item_words=600)
    assert len(leakage.item_blocks(i.select(i.item_id.alias("key"), "text"), small)) > 1
    pairs = [{(r.doc_id, r.item_id) for r in leakage.search(d, i, setting=s).where("exact").collect()} for s in (leakage.Setting(), small)]
    assert pairs[0] == pairs[1] == {(k, k % 40) for k in range(60)}


def test_paraphrases(spark):
    """Items of which every fourth word or so is another one: no run of 12 is left, yet nearly all are found, as brute force finds them."""
    rng = random.Random(9)
    common = [f"c{i}" for i in range(40)]
    special = [f"s{i}" for i in range(900)]
    items = [(k, " ".join([str(100 + k)] + [rng.choice(special) if rng.random() < 0.6 else rng.choice(common) for _ in range(23)])) for k in range(40)]
    docs = []
    for k in range(120):
        filler = [rng.choice(common) if rng.random() < 0.6 else rng.choice(special) for _ in range(rng.randint(20, 100))]
        if k < 80:
            other = [w if j % 4 or not j else rng.choice(special) for j, w in enumerate(items[k % 40][1].split())]
            at = rng.randint(0, len(filler))
            filler[at:at] = other
        docs.append((k, " ".join(filler)))
    found = leakage.search(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    got = {(r.doc_id, r.item_id) for r in found.where("not exact and figures >= 0.5").collect()}
    true = {(k, k % 40) for k in range(80)}
    assert len(got & true) >= 0.9 * len(true) and len(got - true) <= 0.1 * len(got)
    brute, number = set(), {}
    for d, text in docs:
        words = [number.setdefault(w, len(number)) for w in tokens(text)]
        for i, item in items:
            w = [number.setdefault(w, len(number)) for w in tokens(item)]
            for s in range(0, max(1, len(words) - 12), 12):
                part = words[s : s + 24]
                if w[0] in part and common_subsequence(part, w) >= 12 and common_run(part, w) < 12:
                    brute.add((d, i))
    assert len(got & brute) >= 0.9 * len(brute)


def test_edges(spark):
    text = " ".join(f"word{i}" for i in range(14))
    items = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (2, None, "x"), (3, "", "x"), (None, text, "x"), (4, "too short", "x")], "item_id int, text string, cosine string")
    docs = spark.createDataFrame([(1, text, 0.5), (1, text, 0.5), (2, None, 0.5), (3, "", 0.5), (None, "a " * 30_000 + text, 0.5)], "doc_id bigint, text string, cosine double")
    found = leakage.search(docs, items).where("exact").collect()
    assert sorted((str(r.doc_id), r.item_id, r.run_words) for r in found) == [("1", 1, 14), ("None", 1, 14)]
    assert leakage.search(docs.limit(0), items).count() == 0
    assert leakage.search(docs, items.limit(0)).count() == 0


def test_longest_common():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert common_subsequence(a, b) == table[-1][-1]
        runs = [k for k in range(len(a) + 1) for i in range(len(a) - k + 1) if any(a[i : i + k] == b[j : j + k] for j in range(len(b) - k + 1))]
        assert common_run(a, b) == max(runs)
