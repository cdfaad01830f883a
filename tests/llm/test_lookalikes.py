from collections import Counter

from folioforge.llm import lookalikes


def counts(*texts):
    return Counter("".join(t for t in texts if t))


def test_one_form():
    plain = "Café of the Pelley works 2019"
    same = ["Café of the Pelley works 2019", "Ｃafé ｏf the Pelley works 2019", "Café of the Pell​ey works 2019", "Cаfé оf the Реllеу works 20１9", "Caf﻿é of the Pel\xadley works 2019", "Cafе́ of the Pelley works 2019"]
    other = ["Cafe of the Pelley works 2019", "Café of the Pelley works 2O19", "café of the Pelley works 2019", "Café of the Pelley works 20¹9"]
    rewrite = lookalikes.Rewriter(lookalikes.rewriting(counts(plain * 9, *same, *other)))
    assert {rewrite(t) for t in same} == {rewrite(plain)} == {plain}
    assert not {rewrite(t) for t in other} & {plain}


def test_ligature_and_mark_behind_an_invisible_sign():
    texts = ["office" * 5, "oﬃce", "e‍́tude", "étude" * 3]
    rewrite = lookalikes.Rewriter(lookalikes.rewriting(counts(*texts)))
    assert rewrite("oﬃce") == "office"
    assert rewrite("e‍́tude") == "étude"
    assert rewrite("") == ""


def test_pairs(spark):
    rows = [("a", "x1", "one two"), ("a", "x2", "one two"), ("a", "x2", "one two"), ("a", "x3", "one two"), ("b", "x4", "оne two"), ("a", "x5", None), ("a", None, "one two"), (None, "x6", "one two"), (None, "x7", "one　two"), ("a", "x8", ""), ("a", "x9", "​")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "scope_ string, id string, text string, raw string")
    table = lookalikes.rewriting(lookalikes.code_points(df, ["text"]))
    got = {(r.key_a, r.key_b) for r in lookalikes.pairs(df, table, "id", "text", "scope_").collect()}
    assert got == {("x1", "x2"), ("x2", "x3"), ("x6", "x7"), ("x8", "x9")}
    assert lookalikes.pairs(df.limit(0), table, "id", "text").count() == 0
    forms = {r.id: r.one_form for r in lookalikes.one_form(df.where("id is not null"), "text", table).collect()}
    assert forms["x2"] == "one two" and forms["x5"] is None


def test_pairs_of_other_scripts():
    alike = "ρp αa Ьb օo ոn ᎥI ⅠI ⅤV ‒– −– ʹ' 𝐩p 𝟗9 Ａa".split()
    table = lookalikes.rewriting(counts("".join(alike) * 3, "paboniIV–'9A" * 9))
    rewrite = lookalikes.Rewriter(table)
    assert [x for x in alike if rewrite(x[0]) != rewrite(x[1])] == ["Ａa"]
    # What is seen to differ stays apart.
    assert len({rewrite(x) for x in ("x2", "x²", "½", "1/2", "O", "0", "l", "1", "-", "–", "—")}) == 11


def test_classes_count_what_pairs_write_out(spark):
    rows = [(str(i), "same") for i in range(60)] + [(f"z{i}", "sаme") for i in range(5)] + [("y", "ѕаme"), ("y", "ѕаme"), ("q", "other"), (None, "sаme"), ("n", None)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "id string, text string, links int")
    table = lookalikes.rewriting(lookalikes.code_points(df, ["text"]))
    found = {r.key: (r.texts, r.links) for r in lookalikes.classes(df, table, "id", "text").collect()}
    assert found == {**{str(i): (3, 6) for i in range(60)}, **{f"z{i}": (3, 61) for i in range(5)}, "y": (3, 65)}
    assert 2 * lookalikes.pairs(df, table, "id", "text").count() == sum(n for _, n in found.values())


def test_copies_are_not_paired(spark):
    df = spark.createDataFrame([(str(i), "same") for i in range(300)] + [("z", "sаme")], "id string, text string")
    table = lookalikes.rewriting(lookalikes.code_points(df, ["text"]))
    assert lookalikes.pairs(df, table, "id", "text").count() == 300
