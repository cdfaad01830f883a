"""Problems 1, 3 and 5 share the pages of web sites."""

import datetime
import itertools
import random

import pytest

from folioforge.llm import boilerplate, prose, residue
from folioforge.llm.boilerplate import furniture, minimum_cut
from folioforge.llm.sites import line_key

TEXT = "The harbour office measured the northern fence on 3 May 1999, so that the market could open again, and the results were kept in a drawer."
PAGE = f"Minetan\n* [Home](/home)\n* [Help](/help)\n\nWe use cookies to measure visits.\n[Accept all](#) [Reject](#)\n\n# Northern fence\n\n{TEXT}\n\n- storage shelves\n- signal lamps\n\nAdvertisement\n\n{TEXT}\n\n- [A source](https://other.example/5)\n\n### Read next\n- A faded map near Dorlia\n- [Reading room](/reading-room)\n© 2019 Minetan — Imprint\n[Sitemap](/sitemap)"


# A language and words that no part of the library knows.
NAV = "Voorpagina Nieuws Agenda Winkel Vacatures Archief Zoeken".split()
SAYS = ["Wij gebruiken koekjes om het bezoek te meten.", "Meld u aan voor onze nieuwsbrief.", "Sommige delen werken alleen met scripts."]
PRESS = ["Alles toestaan", "Weigeren", "Deel dit artikel", "Naar boven", "Volg ons", "Advertentie"]
MORE = ["Lees ook", "Meest gelezen", "Verder over dit onderwerp"]
FOOT = ["Alle rechten voorbehouden", "Colofon", "Over ons", "Contact opnemen"]
NOUNS = [a + b for a in "water turf zee dijk veld hout".split() for b in "sluis brug kaart oven mast gracht ladder toren veer kade".split()]
PLACES = [a + b for a in "Zout Broek Linde Ooster Veen".split() for b in "wijk dam veer hoek meer".split()]


def dutch(r, host):
    """(page, numbers of its furniture lines): text, lists and sources of its own among what its site puts around it."""
    name, out = host.split(".")[-2], []
    thing = lambda: f"{r.choice(NOUNS)} bij {r.choice(PLACES)}"
    sentence = lambda: f"De {r.choice(NOUNS)} werd in {r.randint(1950, 2020)} door de {r.choice(NOUNS)}meester van {r.choice(PLACES)} gemeten, omdat de {r.choice(NOUNS)} te {r.choice(['oud', 'smal', 'zwaar'])} was."
    add = lambda bad, *lines: out.extend((x, bad) for x in lines)
    if r.random() < 0.5:
        add(True, name.capitalize())
    add(True, *(f"* [{n}](/{n.lower()})" for n in NAV)) if r.random() < 0.5 else add(True, " | ".join(f"[{n}](/{n.lower()})" for n in NAV))
    if r.random() < 0.6:
        add(True, r.choice(SAYS), *r.sample(PRESS, 2))
    add(None, "")
    add(False, f"# De {thing()}")
    for _ in range(r.randint(1, 3)):
        add(None, "")
        add(False, " ".join(sentence() for _ in range(r.randint(1, 3))))
        if r.random() < 0.3:
            add(None, "")
            add(True, r.choice(PRESS))
    if r.random() < 0.4:
        add(None, "")
        add(False, *(f"- {thing()}" for _ in range(3)))
        add(None, "")
        add(False, sentence())
    if r.random() < 0.3:
        add(None, "")
        add(False, f"- [{thing()}](https://bron.elders.nl/{r.randint(1, 99)})")
    if r.random() < 0.6:
        add(None, "")
        add(True, r.choice(["### ", "**", ""]) + r.choice(MORE))
        out[-1] = (out[-1][0] + "**" * out[-1][0].startswith("**"), True)
        for _ in range(r.randint(2, 4)):
            t = thing()
            add(True, f"- [{t}](/{t.replace(' ', '-').lower()})")
    add(None, "")
    add(True, f"© {r.randint(2009, 2024)} {name.capitalize()} — {r.choice(FOOT)}", *(f"[{f}](/{f.replace(' ', '-').lower()})" for f in r.sample(FOOT, 2)))
    return "\n".join(x for x, _ in out), {k for k, (_, bad) in enumerate(out) if bad}


def test_a_language_that_nothing_knows(spark):
    r = random.Random(4)
    hosts = [f"www.krant{k}.nl" for k in range(6) for _ in range(25)] + [f"www.klein{k}.nl" for k in range(10)]
    made = {f"d{k}": (h, *dutch(r, h)) for k, h in enumerate(hosts)}
    now = datetime.datetime(2024, 1, 1)
    docs = spark.createDataFrame([(k, text, now) for k, (_, text, _) in made.items()], "doc_id string, markdown string, converted_at timestamp")
    urls = spark.createDataFrame([(k, f"https://{h}/a/{k}", now) for k, (h, _, _) in made.items()], "doc_id string, url string, received_at timestamp")
    got = {(x.doc_id, x.line_no) for x in boilerplate.boilerplate_lines(boilerplate.pages(docs, urls)).collect()}
    for part in ("krant", "klein"):
        true = {(k, n) for k, (h, _, bad) in made.items() for n in bad if part in h}
        mine = {x for x in got if part in made[x[0]][0]}
        assert len(true & mine) >= 0.9 * len(true) and len(true & mine) >= 0.9 * len(mine), (part, len(true), len(mine), len(true & mine))


def test_page():
    """One page among others of its site, whose lines the classifier has seen."""
    r = random.Random(1)
    others = [PAGE.replace("Northern fence", f"Fence {k}").replace(TEXT, f"{TEXT} {k} more were {r.choice(NOUNS)}.").replace("A faded map near Dorlia", f"{r.choice(NOUNS)} near {r.choice(PLACES)}").replace("storage shelves", f"{r.choice(NOUNS)} {'abcdefgh'[k]}").replace("signal lamps", f"{r.choice(NOUNS)} {'ijklmnop'[k]}").replace("A source", f"{r.choice(PLACES)} {'ijklmnop'[k]}") for k in range(8)]
    model = boilerplate.Classifier().fit(boilerplate.labelled(others, boilerplate.site_names("minetan.test")))
    often = frozenset(line_key(x) for k, x in enumerate(PAGE.split("\n")) if k in {0, 1, 2, 4, 5, 14, 20, 22, 23, 24})
    gone = {0, 1, 2, 4, 5, 14, 20, 21, 22, 23, 24}
    assert set(furniture(PAGE, "minetan.test", often, model)) == gone
    # On another site that nothing is known of, the words and shapes still tell.
    found = set(furniture(PAGE.replace("Minetan", "Torvale"), "torvale.test", frozenset(), model))
    assert found <= gone and len(found) >= len(gone) - 2
    assert furniture("", "a.b") == [] and furniture("\n \n", None) == []
    # A page always keeps a main body.
    assert furniture("Access denied\n\nYou do not have permission to view this resource.", "a.b", frozenset(), model) == []


@pytest.mark.parametrize("seed", range(60))
def test_cut_is_least(seed):
    r = random.Random(seed)
    n = r.randint(1, 8)
    keep, drop = ([r.choice([0, r.random() * 5]) for _ in range(n)] for _ in range(2))
    edges = [(a, b, r.random() * 3) for a in range(n) for b in range(a + 1, n) if r.random() < 0.4]
    price = lambda lab: sum(keep[i] if not lab[i] else drop[i] for i in range(n)) + sum(w for a, b, w in edges if lab[a] != lab[b])
    # keep is paid by dropped nodes' complement: cost of keeping a node that is dropped is not paid.
    found = minimum_cut(keep, drop, edges)
    assert price(found) == pytest.approx(min(price(lab) for lab in itertools.product([False, True], repeat=n)))


def frames(spark, texts, url="https://www.minetan.test/a"):
    now = datetime.datetime(2024, 1, 1)
    out = [(k, t, now + datetime.timedelta(days=d), "extra") for k, t in texts.items() for d in range(2)]
    docs = spark.createDataFrame(out, "doc_id string, markdown string, converted_at timestamp, host string")
    urls = spark.createDataFrame([(k, url if not k.startswith("x") else None, now) for k in texts], "doc_id string, url string, received_at timestamp")
    return docs, urls


def test_lines_and_empty_tables(spark):
    docs, urls = frames(spark, {"p": PAGE, "q": PAGE, "n": None, "b": " \n", "x": PAGE})
    pages = boilerplate.pages(docs, urls)
    assert pages.rows.count() == 3
    got = boilerplate.boilerplate_lines(pages.where("web")).collect()
    # One page alone teaches nothing; shapes that all sites share still tell its links.
    assert {r.doc_id for r in got} == {"p", "q"} and len(got) == len(set(got)) and {1, 2} <= {r.line_no for r in got} and not {7, 9, 16} & {r.line_no for r in got}
    assert boilerplate.boilerplate_lines(boilerplate.pages(docs.limit(0), urls)).count() == 0


def test_bodies(spark):
    docs, urls = frames(spark, {f"o{k}": f"[Home](/)\n\n# Fence {'abcdef'[k]}\n\n{TEXT} {k} and {'xyz' * (k + 1)}.\n\n\nAll of us\n\n- {'klmnop'[k] * 4} lamps\n\n[Imprint](/imprint)" for k in range(6)} | {"x": "[Home](/)\n\nA text.", "n": None})
    got = {r.doc_id: r.body for r in boilerplate.bodies(boilerplate.pages(docs, urls)).collect()}
    assert set(got) == {"x"} | {f"o{k}" for k in range(6)} and got["x"] == "[Home](/)\n\nA text."
    assert all(b.startswith("# Fence") and "Home" not in b and "Imprint" not in b and TEXT in b for k, b in got.items() if k != "x")


def test_copies_do_not_recur(spark):
    own = f"# Northern fence\n\n{TEXT}\n\nstorage shelves here\n\nsignal lamps there\n\n{TEXT}"
    other = lambda k: f"# Fence {k}\n\n{TEXT}\n\nRead me now\n\nentry {'abcdefghij'[k]}{'xyz' * (k + 1)}\n\n{TEXT}"
    docs, urls = frames(spark, {f"c{k}": own for k in range(5)} | {f"o{k}": other(k) for k in range(6)})
    docs = docs.unionByName(docs)
    got = {r.doc_id: set(r.recurring or ()) for r in boilerplate.pages(docs, urls).rows.collect()}
    keys = got["c0"]
    assert line_key("Read me now") in keys and not keys & {line_key(x) for x in ("storage shelves here", "signal lamps there", "# Northern fence")}
    lines = {(r.doc_id, r.line_no) for r in boilerplate.boilerplate_lines(boilerplate.pages(docs, urls)).collect()}
    assert {(f"o{k}", 4) for k in range(6)} <= lines and not {n for _, n in lines} & {0}


def test_long_lines_recur_too(spark):
    notice = "Wij en onze partners bewaren kleine bestanden. " * 12
    docs, urls = frames(spark, {f"o{k}": f"# Fence {k}\n\n{TEXT} {k} and {'xyz' * (k + 1)}.\n\n{notice.strip()}" for k in range(6)})
    lines = {(r.doc_id, r.line_no) for r in boilerplate.boilerplate_lines(boilerplate.pages(docs, urls)).collect()}
    assert lines == {(f"o{k}", 4) for k in range(6)}


CASES = {
    "x1": ("placeholder", "Dear {{name}},\n\nWe write about your order.\n\n" + TEXT),
    "x2": ("error", "**Page not found (404)**\n\nTry again in a few minutes."),
    "x3": ("demand", "You need to enable JavaScript to run this app."),
    "x4": ("prompt", "# TITLE_PLACEHOLDER\n\nClick to add title"),
    "x5": ("filler", "# Ledgers\n\nLorem ipsum dolor sit amet, sed magna nulla velit quis. Tempor porta nibh massa elit urna."),
    "x6": ("filler", "Sample text. " * 20),
    "xc": ("error", "## Accès refusé\n\nVérifiez l’adresse ou revenez plus tard."),
    "xd": ("error", "Wenden Sie sich an die Verwaltung, falls der Fehler bleibt."),
    "xe": ("filler", "# Spare turbines with help from Pelley\n\nLorem lectus amet nibh urna. Ipsum tempor dolor amet nibh."),
    "x7": (None, "# Templates\n\n" + TEXT + "\n\n```\nHello ${name}, your total is {{sum}}\n```\n\nA template engine swaps the marked fields."),
    "x8": (None, TEXT + " The page said: error 404, page not found.\n\n" + TEXT),
    "x9": (None, "- heating plan\n- signal lamps\n- heating plan\n- signal lamps"),
    "xa": (None, TEXT + " A word [sic] stands here [6], as in {x} and <b>bold</b>."),
}


def test_evidence(spark):
    docs, urls = frames(spark, {k: t for k, (_, t) in CASES.items()} | {"xn": None, "xb": ""})
    got = {r.doc_id: r.evidence for r in residue.judged(boilerplate.pages(docs, urls)).collect()}
    assert got == {k: e for k, (e, _) in CASES.items()}
    web = residue.evidence(*residue.residual("[Home](/)\n[Help](/help)\n\nAccess denied\n\n[Imprint](/imprint)", "minetan.test", True))
    assert web == "error"


@pytest.mark.parametrize(
    "kind, text",
    [
        ("error", "# Error 404\n\nPage not found\n\n" + "\n".join(f"- [entry {k}](/e{k})" for k in range(12))),
        ("error", "HTTP 502"),
        ("error", "404 Not Found\n\nnginx/1.18.0"),
        ("error", "Something went wrong. " + "Try again in a few minutes, or tell the administrator what you did before. " * 4),
        ("error", "This page could not be loaded. Please reload."),
        ("demand", "Your browser does not support JavaScript."),
        ("placeholder", f"Dear [customer],\n\n{TEXT}"),
        ("placeholder", f"Dear <customer name>,\n\n{TEXT}"),
        (None, f"{TEXT} It said: page not found. {TEXT} {TEXT}"),
        (None, f"Chapter [three]\n\n{TEXT}"),
    ],
)
def test_evidence_of_any_length(kind, text):
    assert residue.evidence(text.split("\n")) == kind


def test_messages_of_unknown_wording(spark):
    now = datetime.datetime(2024, 1, 1)
    rows = {f"m{k}": (f"www.site{k % 4}.nl", f"# Pagina {'abcdef'[k]}\n\nDeze bladzijde is nergens te bekennen.") for k in range(6)}
    rows |= {f"t{k}": (f"www.site{k % 4}.nl", f"# Over {k}\n\n{TEXT} {'xyz' * (k + 1)}.") for k in range(6)} | {"one": ("www.site1.nl", "# Alleen\n\nEen kort bericht.")}
    docs = spark.createDataFrame([(k, t, now) for k, (_, t) in rows.items()], "doc_id string, markdown string, converted_at timestamp")
    urls = spark.createDataFrame([(k, f"https://{h}/{k}", now) for k, (h, _) in rows.items()], "doc_id string, url string, received_at timestamp")
    got = {r.doc_id for r in residue.judged(boilerplate.pages(docs, urls)).where("evidence is not null").collect()}
    assert got == {f"m{k}" for k in range(6)}


def test_long_records_are_judged_alike_in_3_and_5(spark):
    texts = {
        "xdeck": "\n\n".join(["Click to add title", "Click to add text"] * 80),
        "xtalk": "\n\n".join(["Click to add title", "Click to add text"] * 80 + [TEXT]),
        "xcode": "Lorem ipsum dolor sit amet, sed magna nulla velit quis. " * 8 + "\n\n```\n" + "total = total + price\n" * 200 + "```",
        "xtext": (TEXT + "\n\n") * 30,
    }
    docs, urls = frames(spark, texts)
    pages = boilerplate.pages(docs, urls)
    common = spark.createDataFrame([("en", w, i) for i, w in enumerate("the a an and of to in on so that were".split())], "lang string, word string, word_rank int")
    want = {"xdeck": "prompt", "xtalk": None, "xcode": "filler", "xtext": None}
    assert {r.doc_id: r.evidence for r in residue.judged(pages).collect()} == want
    assert {r.doc_id: r.evidence for r in prose.quality(pages, common).collect()} == want


def test_quality(spark):
    table = "| a | b |\n| --- | --- |\n" + "| 12 | n/a |\n" * 20
    bodies = {
        "prose": (TEXT + "\n\n") * 4,
        "hard": "\n".join(TEXT[i : i + 30].strip() for i in range(0, len(TEXT), 30)) * 3,
        "dialogue": "\n\n".join("— " + TEXT for _ in range(4)),
        "short list": (TEXT + "\n\n") * 4 + "- one\n- two\n- three",
        "list": "# Things\n\n" + "- signal lamps\n- storage shelves\n" * 8,
        "table": table,
        "csv": "Pelska, 12, 34\nHalvin, 3, 99\n" * 10,
        "log": "12:30:01 INFO [ab] job=3 took=9ms\n" * 10,
        "code": "var a1=function(x){return x*6+'d106'};var b2=function(y){return y*91};" * 5,
        "symbols": "=_-*.***#*=>_#^#<_*-*.| *- > -<^__#>##~\n" * 8,
        "words": "lamps / plan / fence / room / valves / map / " * 12,
        "error": "Access denied\n\nTry again in a few minutes.",
        "none": " ",
    }
    docs, urls = frames(spark, {"x" + k: t for k, t in bodies.items()})
    common = spark.createDataFrame([("en", w, i) for i, w in enumerate("the a an and of to in on so that were".split())] + [(None, "x", 1)], "lang string, word string, word_rank int")
    got = {r.doc_id[1:]: r for r in prose.quality(boilerplate.pages(docs, urls), common).collect()}
    assert {k: r.prose for k, r in got.items()} == {k: True if k in ("prose", "hard", "dialogue", "short list") else None if k == "error" else False for k in bodies if k != "none"}
    assert got["prose"].words == 4 * 24 and 0.3 < got["prose"].common_words < 0.6 and got["prose"].ended_lines == 1.0
    assert prose.quality(boilerplate.pages(docs.limit(0), urls), common.limit(0)).count() == 0


def test_divergence():
    import numpy as np

    p, q = np.array([1.0, 0, 0]), np.array([[1.0, 0, 0], [0, 1, 0], [0.5, 0.5, 0]])
    d = prose.divergence(p, q)
    assert d[0] == pytest.approx(0) and d[1] == pytest.approx(1) and 0 < d[2] < 1
