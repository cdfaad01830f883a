from folioforge.llm import encodings as E

CLEAN = "Según las notas, la compañía eléctrica publicó las lámparas de la vía — señales. L’école était fermée après la réunion. Die größeren Öfen für Züge."


def test_chains_invert():
    for chain in E.CHAINS:
        bad = E.garble("größeren", chain)
        if bad and not bad.isascii() and chain[-1] != "utf-8?" and E.LOST not in bad:
            assert E.restore(bad, chain) == "größeren", chain


def test_strange():
    for good in ("größeren", "L’école", "“Así", "—", "ÖFEN", "Москва", "m²", "café", "Ångström", "DECISÃO", "d’été"):
        assert not E.strange(good) or good == "m²", good
    for bad in ("grÃ¶ÃŸeren", "despuÚs", "p√∫blica", "â€œIt", "s¹siedniej", "Br�chigen", "нХЪЕК", "caf\x82"):
        assert E.strange(bad), bad


def test_found_and_restored(spark):
    bad = [E.garble(CLEAN, c) for c in (("utf-8", "cp1252"), ("cp1252", "cp850"), ("utf-8", "mac_roman"))]
    rows = [("clean", CLEAN)] * 1 + [(f"c{i}", CLEAN) for i in range(8)] + [(f"b{i}", t) for i, t in enumerate(bad)] + [("part", CLEAN + " " + bad[0]), ("n", None), ("e", ""), ("a", "plain ascii"), ("lost", "la compa��a")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id string, text string, chain int")
    table = E.garbled_table([df])
    got = {r.doc_id: r.restored for r in E.damaged(df, table, ["doc_id"], "text").collect()}
    assert set(got) == {"b0", "b1", "b2", "part", "lost"}
    assert got["b0"] == CLEAN and got["b1"] == CLEAN and got["part"] == CLEAN + " " + CLEAN
    assert E.damaged(df.limit(0), table, ["doc_id"], "text").count() == 0


def test_join_agrees_with_lookup(spark, monkeypatch):
    bad = E.garble(CLEAN, ("utf-8", "cp1252"))
    df = spark.createDataFrame([(f"c{i}", CLEAN) for i in range(6)] + [("b", bad)], "doc_id string, text string")
    table = E.garbled_table([df])
    sent = {(r.doc_id, r.restored) for r in E.damaged(df, table, ["doc_id"], "text").collect()}
    monkeypatch.setattr(E, "MOST_SENT", -1)
    assert {(r.doc_id, r.restored) for r in E.damaged(df, table, ["doc_id"], "text").collect()} == sent == {("b", CLEAN)}


def test_a_repeated_fragment_is_no_second_proof(spark, monkeypatch):
    chain = ("cp1250", "cp1252")
    words = "Spółdzielnia sprawdziła część ogrodzenia wzdłuż kanału ponieważ części się zużyły pęknięte zawory"
    bad = [E.garble(w, chain) for w in words.split()]
    strong = next(b for b in bad if E.strange(b))
    weak = next(b for w, b in zip(words.split(), bad) if b != w and not E.strange(b))
    rows = [("good", i, w) for i, w in enumerate(words.split() * 4)] + [("bad", i, b) for i, b in enumerate(bad)] + [("d", 0, strong), ("d", 0, strong), ("d", 1, weak)]
    df = spark.createDataFrame(rows, "doc_id string, item int, text string")
    table = E.garbled_table([df.where("doc_id <> 'd'")]).where("token <> '" + weak + "'")
    found = lambda: {(r.doc_id, r.item) for r in E.damaged(df, table, ["doc_id", "item"], "text", "doc_id").collect()}
    sent = found()
    assert ("d", 0) in sent and ("d", 1) not in sent
    monkeypatch.setattr(E, "MOST_SENT", -1)
    assert found() == sent


def test_western_text_read_without_its_quotes(spark):
    bad = E.garble("l’école", ("cp1252", "latin-1"))
    df = spark.createDataFrame([(str(i), "l’école a été fermée") for i in range(6)] + [("b", bad), ("c", E.garble("fermée", ("utf-8", "gbk")) or "x")], "doc_id string, text string")
    got = {r.doc_id: r.restored for r in E.damaged(df, E.garbled_table([df]), ["doc_id"], "text").collect()}
    assert got["b"] == "l’école" and set(got) <= {"b", "c"}


def test_fragments_share_their_documents_fate(spark):
    chain = ("cp1250", "cp1252")
    words = "Spółdzielnia sprawdziła część ogrodzenia wzdłuż kanału ponieważ części się zużyły pęknięte zawory"
    rows = [("good", i, w) for i, w in enumerate(words.split() * 4)] + [("bad", i, E.garble(w, chain)) for i, w in enumerate(words.split())]
    df = spark.createDataFrame(rows, "doc_id string, item int, text string")
    got = {r.item for r in E.damaged(df, E.garbled_table([df]), ["doc_id", "item"], "text", "doc_id").collect() if r.doc_id == "bad"}
    assert got == {i for _, i, t in rows if _ == "bad" and t not in words.split()}
