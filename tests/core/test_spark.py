import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from folioforge import __main__ as cli
from folioforge import api
from folioforge.formats import registry
from folioforge.functions import text as T
from folioforge.functions import urls as U
from folioforge.operators import convert, evaluation, layout, routing
from folioforge.sources import fetch, files
from folioforge.streaming import ingest

DOC = "doc_id string, content binary, extension string, mimetype string, url string"


def test_routing_agrees_with_the_registry(spark):
    infos = [(e, m, u) for e in (None, ".pdf", ".PDF", ".svg", ".xml", ".yaml", ".tsv", ".py", ".none", ".zip") for m in (None, "text/html; charset=utf-8", "application/xhtml+xml", "video/mp4", "video/mp4a", "image/x", "application/xml", "application/epub+zip") for u in (None, "https://en.wikipedia.org/wiki/X", "https://github.com/a/b", "https://notgithub.com/a/b", "https://www.wikipedia.org/x")]
    rows = [(str(k), None, *i) for k, i in enumerate(infos)]
    got = {r.doc_id: r.candidates for r in routing.routed(spark.createDataFrame(rows, DOC)).collect()}
    for k, (e, m, u) in enumerate(infos):
        assert got[str(k)] == [r.name for r in registry.RULES if r.accepts({"extension": e, "mimetype": m, "url": u})], (e, m, u)


def test_native_lane_equals_python(spark):
    rows = [("a", b"hello\xff", ".txt", None, None), ("b", b"a: 1", ".yaml", None, None), ("c", b"x=1", ".py", None, None), ("d", b"", None, None, None), ("e", None, ".txt", None, None), ("f", b"# m", ".md", None, None), ("g", b"%PDF-1.4", None, None, None), ("h", b"t", None, "text/x-y", None), ("a", b"hello\xff", ".txt", None, None)]
    df = spark.createDataFrame(rows, DOC)
    got = sorted((r.doc_id, str(r.converter), str(r.markdown), len(r.errors)) for r in convert.convert(df).collect())
    one = lambda c, e, m: registry.convert(c, {"extension": e, "mimetype": m})
    assert got == sorted((i, str(f["converter"]), str(f["markdown"]), len(f["errors"])) for i, c, e, m, _ in rows for f in [one(c, e, m)])
    assert convert.convert(df.limit(0)).count() == 0
    assert convert.convert_with(df.where("doc_id = 'a'"), "csv").first().markdown == "| hello� |\n| --- |"
    with pytest.raises(ValueError):
        convert.convert_with(df, "nothing")


def test_partitions_do_not_matter(spark):
    df = spark.createDataFrame([(str(k), f"<h{k % 6 + 1}>t{k}</h{k % 6 + 1}>".encode(), ".html", None, None) for k in range(40)], DOC)
    one, many = (sorted((r.doc_id, r.markdown) for r in convert.convert(df.repartition(n)).collect()) for n in (1, 8))
    assert one == many


def test_user_converter(spark):
    def shout(data, info):
        return data.decode().upper(), "T"

    api.add_converter("shout", shout, (".shout",))
    try:
        found = api.convert(spark.createDataFrame([("a", b"hey", ".shout", None, None)], DOC)).first()
        assert (found.converter, found.markdown, found.title) == ("shout", "HEY", "T")
    finally:
        registry.EXTRA.clear()


def test_files_archives_and_streams(spark, tmp_path):
    data = tmp_path / "in"
    data.mkdir()
    (data / "a.HTML").write_text("<h1>A</h1>")
    (data / "env").write_text("K=1")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("x.csv", "a,b")
        z.writestr("y.bin", b"\0")
    (data / "z.zip").write_bytes(out.getvalue())
    (data / "bad.zip").write_bytes(b"no")
    docs = files.read_files(spark, str(data))
    assert {r.filename: r.extension for r in docs.collect()} == {"a.HTML": ".html", "env": None, "z.zip": ".zip", "bad.zip": ".zip"}
    whole = {r.doc_id.rpartition("/")[2]: r.markdown for r in api.convert_files(spark, str(data)).collect()}
    assert whole["a.HTML"] == "# A" and whole["env"] == "K=1" and whole["bad.zip"] is None
    parts = files.zip_markdown(docs.where("extension = '.zip'")).collect()
    assert [r.markdown for r in parts] == [whole["z.zip"]]
    assert files.unzipped(docs.where("filename = 'bad.zip'")).first().error
    for _ in range(2):
        ingest.write(ingest.converted_stream(spark, str(data)), str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    assert cli.main(["convert", str(data / "a.HTML"), "-o", str(tmp_path / "o.md"), "--json"]) == 0
    assert (tmp_path / "o.md").read_text() == "# A"


def answers(table):
    def get(method, url, headers):
        found = table.get((method, url)) or table.get(url)
        return fetch.Response(404) if found is None else fetch.Response(200, *found)

    return get


def test_addresses(spark):
    site = answers(
        {
            "https://a.example/llms.txt": ("text/plain", b"# All"),
            "https://b.example/p": ("text/html; charset=utf-8", b'<link rel="alternate" type="text/markdown" href="./p.md"><p>html</p>'),
            "https://b.example/p.md": ("text/markdown", b"# Source"),
            "https://c.example/x.csv": ("text/csv", b"a,b"),
            "https://d.example/m": ("text/markdown", b"*m*"),
            "https://raw.githubusercontent.com/o/r/HEAD/README.md": ("text/plain", b"# Readme\n"),
            "https://raw.githubusercontent.com/o/r/main/s/f.py": ("text/plain", b"x=1"),
            "https://api.github.com/repos/o/r/issues/5": ("application/json", json.dumps({"title": "T", "user": {"login": "u"}, "state": "open", "labels": [{"name": "l"}], "body": " b "}).encode()),
            "https://gist.githubusercontent.com/o/1/raw": ("text/plain", b"g"),
        }
    )
    urls = ["https://a.example/", "https://b.example/p", "https://c.example/x.csv", "https://d.example/m", "https://github.com/o/r", "https://github.com/o/r/blob/main/s/f.py", "https://github.com/o/r/pull/5", "https://gist.github.com/o/1", "https://e.example/none", None, "https://a.example/"]
    # The fetcher travels to the workers by value.
    got = {r.doc_id: (r.converter, r.markdown, r.title) for r in fetch.convert_urls(spark.createDataFrame([(u,) for u in urls], "url string"), site).collect()}
    assert got == {
        urls[0]: ("plain-text", "# All", None),
        urls[1]: ("plain-text", "# Source", None),
        urls[2]: ("csv", "| a | b |\n| --- | --- |", None),
        urls[3]: ("plain-text", "*m*", None),
        urls[4]: ("github", "# Readme", "Readme"),
        urls[5]: ("github", "# f.py\n\n```py\nx=1\n```", "f.py"),
        urls[6]: ("github", "# T\n\n@u · open · l\n\nb", "T"),
        urls[7]: ("github", "g", "gist:1"),
        urls[8]: (None, None, None),
    }


def test_address_columns_agree_with_python(spark):
    cases = [("https://x.example/docs/page", h) for h in ("https://y/z", "//c/d", "/e", "./f.md", "g/h.md")] + [("http://x.example", "a.md"), ("https://x.example/a?b=/c", "d.md")]
    df = spark.createDataFrame(cases, "url string, href string")
    for r in df.select("url", "href", U.resolved(F.col("href"), F.col("url")).alias("r"), U.path(F.col("url")).alias("p"), U.extension(F.col("url")).alias("e")).collect():
        assert r.r == fetch.resolve(r.href, r.url) and r.p == fetch.url_path(r.url) and r.e == fetch.suffix(r.p)


def test_text_columns(spark):
    df = spark.createDataFrame([("Ａ１ ﬁn|x\ny", 16.0, True), (None, None, None), ("", 11.0, False)], "t string, s double, b boolean")
    t = F.col("t")
    rows = df.select(T.half_width(t).alias("h"), T.without_ligatures(t).alias("l"), T.cell(t).alias("c"), T.utf16_units(F.lit("a😀")).alias("u"), T.heading_mark(F.col("s"), F.col("b"), F.lit(11.0)).alias("m"), T.dehyphenated(F.lit("foo-\n\nbar")).alias("d"), T.escaped(F.lit("a*b [1, 2] [x]")).alias("e")).collect()
    assert rows[0].h == "A1 ﬁn|x\ny" and rows[0].l == "Ａ１ fin|x\ny" and rows[0].c == "A1 ﬁn\\|x<br>y" and rows[0].u == 3
    assert rows[0].m == "## " and rows[0].d == "foobar" and rows[0].e == "a\\*b [1, 2] \\[x\\]" and rows[1].h is None


BOX = "doc_id string, page_number int, seq int, id string, text string, x_left double, x_right double, y_top double, y_bottom double, font_size double, is_bold boolean"


def boxes(spark, pages=6):
    rows = []
    for p in range(1, pages + 1):
        rows += [("d", p, 0, f"{p}-0", "Running head", 72.0, 160.0, 780.0, 770.0, 10.0, False), ("d", p, 1, f"{p}-1", f"Body {p}", 72.0, 110.0, 700.0, 690.0, 10.0, False), ("d", p, 2, f"{p}-2", "right", 200.0, 230.0, 701.0, 691.0, 10.0, False), ("d", p, 3, f"{p}-3", f"{p}", 300.0, 306.0, 40.0, 30.0, 10.0, False)]
    return spark.createDataFrame(rows + rows[:2], BOX), spark.createDataFrame([("d", p, 600.0, 800.0) for p in range(1, pages + 1)] * 2, "doc_id string, page_number int, page_width double, page_height double")


def test_layout(spark):
    b, g = boxes(spark)
    heads = layout.running_heads(b, g).collect()
    assert [(r.text, r.pages, r.longest) for r in heads] == [("Running head", 6, 6)]
    assert layout.running_heads(*boxes(spark, 4)).count() == 0
    assert layout.without_heads(b, g).count() == 18
    assert layout.modal_size(b).first().body == 10.0 and layout.median_size(b).first().median == 10.0
    first = layout.lines(b).where("page_number = 1").orderBy("line").collect()
    assert [r.text for r in first] == ["Running head", "Body 1 right", "1"]
    assert layout.foot_numbers(b).count() == 6
    for empty in (layout.running_heads(b.limit(0), g), layout.lines(b.limit(0)), layout.modal_size(b.limit(0)), layout.nearest(spark.createDataFrame([], "doc_id string, page_number int, item_no int, text string, x double, y double"), b)):
        assert empty.count() == 0


def test_words_and_islands(spark):
    rows = [("d", 1, k, t, x, 100.0, w, 10.0) for k, (t, x, w) in enumerate([("Hel", 0.0, 10.0), ("lo", 10.5, 8.0), ("you", 22.0, 10.0), ("far", 60.0, None)])]
    items = spark.createDataFrame(rows, "doc_id string, page_number int, item_no int, text string, x double, y double, width double, font_size double")
    assert [r.text for r in layout.words(items).orderBy("word").collect()] == ["Hello you", "far"]
    spans = spark.createDataFrame([("a", 0.0, 5.0), ("a", 3.0, 9.0), ("a", 15.0, 16.0), ("a", 40.0, 41.0), ("b", 1.0, 2.0)], "k string, lo double, hi double")
    assert sorted((r.k, r.low, r.high) for r in layout.islands(spans, ["k"], "lo", "hi").collect()) == [("a", 0.0, 16.0), ("a", 40.0, 41.0), ("b", 1.0, 2.0)]


def test_evaluation(spark):
    text = "# H\n\n- a\n1. b\n\n| x | y |\n| --- | --- |\n[l](u) [^1]"
    r = evaluation.structure(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert (r.headings, r.table_rows, r.list_items, r.links, r.footnotes) == (1, 2, 2, 1, 1)
    pair = spark.createDataFrame([("a b c d", "b c d e"), ("a", "b"), (None, "a b c")], "l string, r string")
    assert [(x.a_in_b, x.b_in_a) for x in evaluation.containment(pair, "l", "r").collect()][:2] == [(0.5, 0.5), (None, None)]
    checks = spark.createDataFrame([("d", "contains", "Some  TEXT"), ("d", "min_chars", "5"), ("d", "contains_words", "text here"), ("d", "not_contains", "zzz"), ("d", "regex", "^some"), ("e", "contains", "x")], "doc_id string, type string, value string")
    out = spark.createDataFrame([("t", "d", "Some text, here"), ("u", "e", "x")], "tool string, doc_id string, text string")
    assert sorted((x.tool, x.passed, x.total, x.complete) for x in evaluation.scored(checks, out).collect()) == [("t", 5, 6, 1), ("u", 2, 6, 1)]
    with pytest.raises(Exception, match="unknown check"):
        checks.select(evaluation.passes(F.lit("odd"), F.col("value"), F.col("value"))).collect()
    a = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "z")], "doc_id string, digest string")
    b = spark.createDataFrame([("2", "y"), ("3", "w"), ("4", "v")], "doc_id string, digest string")
    assert sorted((x.doc_id, x.state) for x in evaluation.manifest_difference(a, b).collect()) == [("1", "missing"), ("3", "changed"), ("4", "extra")]
    said = spark.createDataFrame([('{"winner":"A","a":{"x":5},"b":{"x":1}}',), ('{"winner":"C","a":{"x":5},"b":{"x":1}}',), ("no",), ('{"winner":"B","a":{"x":9},"b":{}}',)], "v0 string")
    assert [x.valid for x in evaluation.verdicts(said, "v0").collect()] == [True, False, False, False]
    sizes = spark.createDataFrame([("d", 10), ("e", 1)], "doc_id string, pages int")
    assert [x.page for x in evaluation.quantile_pages(sizes, "doc_id", "pages").where("doc_id = 'd'").collect()] == [1, 2, 5, 8, 10]


def test_without_the_optional_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['folioforge.llm'] = None; import importlib.util as u; f = u.find_spec; u.find_spec = lambda n, *a: None if n.startswith('folioforge.llm') else f(n, *a); import __spark_entry__ as e; assert not [q for q in e.queries() if q[0] == 'p' and q[1].isdigit()]; assert set(e.oracle_sql()) <= set(e.queries())"
    from folioforge.runtime import ROOT

    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True).stderr == ""


CHROME = (
    "||WWW.EXAMPLE.COM", "- 8 -", "https://a.example/x", "see doi.org/10.1/x", "Please cite this article as", "© 2019 The Authors", "Page 3 of 9", "xvii", "Vol. 24, 2001", "v. 19, n. 1",
    "Tao et al.", "Journal of Locks 2003, 112-118", "The Harbour Journal 2015, 811:51 (9pp)", "(1974). 7, 222", "26 mai 1978", "March 8, 2003",
)
TEXTS = ("i", "copyright", "volume of trade", "12345", "mix of things", "2019-05-12 report", "In 1999 we met", "The lock was mended.", "", " ", "iiii", "12 3")


def test_wording_of_furniture(spark):
    from folioforge.formats import layout as plain
    from folioforge.functions import text as T

    rows = spark.createDataFrame([(t,) for t in (*CHROME, *TEXTS)] + [(None,)], "t string")
    found = {r.t for r in rows.where(T.is_chrome(F.col("t"))).collect()}
    assert found == set(CHROME) == {t for t in (*CHROME, *TEXTS) if plain.chrome_line(t)}


def test_furniture_of_single_pages(spark):
    """The relation agrees with the walk over each page's boxes, box by box."""
    import random

    from folioforge.formats import layout as plain

    r, pages, rows = random.Random(6), [], []
    words = [*CHROME, "Night crew", "The seed library counted the shelves", "7", "iv", "x" * 210]
    for d in range(8):
        for n in range(1, 5):
            height = r.choice([800.0, 800.0, 800.0, 0.0])
            pages.append((f"d{d}", n, 600.0, height))
            for seq in range(r.choice([0, 1, 2, 3, 12, 20])):
                top = r.choice([r.uniform(0, 130), r.uniform(670, 800), r.uniform(0, 800)])
                rows.append((f"d{d}", n, seq, f"d{d}-{n}-{seq}", r.choice(words), r.uniform(0, 300), 400.0, top, top - r.choice([8.0, 12.0]), r.choice([8.0, 10.0, 0.0]), False))
    kinds = "doc_id string, page_number int, seq int, id string, text string, x_left double, x_right double, y_top double, y_bottom double, font_size double, is_bold boolean"
    b = spark.createDataFrame(rows + rows[:5], kinds)
    g = spark.createDataFrame(pages, "doc_id string, page_number int, page_width double, page_height double")
    want = set()
    for d, n, _, height in pages:
        mine = [x for x in rows if x[:2] == (d, n)]
        boxes_ = [{"text": x[4], "left": x[5], "top": x[7], "bottom": x[8], "font": x[9]} for x in mine]
        want |= {(d, n, mine[k][2]) for k in plain.page_furniture(boxes_, height)}
    assert {(x.doc_id, x.page_number, x.seq) for x in layout.page_chrome(b, g).collect()} == want and len(want) > 10
    assert layout.page_chrome(b.limit(0), g).count() == 0


def test_tiny_type_and_compounds(spark):
    from folioforge.functions import text as T

    kinds = "doc_id string, page_number int, seq int, id string, text string, x_left double, x_right double, y_top double, y_bottom double, font_size double, is_bold boolean"
    b = spark.createDataFrame([("t", 1, k, f"t{k}", f"line {k}", 10.0, 90.0, 700.0 - 8 * k, 694.0 - 8 * k, 5.0 if k else 11.0, False) for k in range(6)] + [("u", 1, k, f"u{k}", "line", 10.0, 90.0, 700.0 - 8 * k, 694.0 - 8 * k, 5.5, True) for k in range(3)], kinds)
    body = {r.doc_id: r.body for r in layout.modal_size(b).collect()}
    assert body == {"t": 11.0, "u": 5.5}
    assert layout.headings(layout.lines(b), layout.modal_size(b)).count() == 9
    texts = {"knowledge-based tech-\n\nniques": "knowledge-based techniques", "state-of-the-\n\nart": "state-of-the-art", "a dash-\n\nNew": "a dash-\n\nNew", "list:\n\n- item": "list:\n\n- item", "Spół-\n\ndzielnia": "Spółdzielnia", "": ""}
    got = {r.t: r.d for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.dehyphenated(F.col("t")).alias("d")).collect()}
    assert got == texts


def test_rules_and_tables(spark):
    from folioforge.operators import tables

    kinds = "doc_id string, page_number int, seq int, id string, text string, x_left double, x_right double, y_top double, y_bottom double, font_size double, is_bold boolean"
    cells = [("Name", 80.0, 120.0, 700.0), ("Age", 200.0, 230.0, 700.0), ("Ann", 80.0, 110.0, 680.0), ("31", 200.0, 215.0, 678.0), ("below", 80.0, 118.0, 655.0), ("far", 80.0, 100.0, 500.0)]
    b = spark.createDataFrame([("t", 1, k, f"t{k}", t, x, r, y, y - 10, 10.0, False) for k, (t, x, r, y) in enumerate(cells)] * 2, kinds)
    frames = spark.createDataFrame([("t", 1, 7, 70.0, 240.0, 665.0, 710.0)], "doc_id string, page_number int, frame int, x_min double, x_max double, y_min double, y_max double")
    got = {(r.row, r.column): r.text for r in tables.level_tables(frames, b).collect()}
    assert got == {(0, 0): "Name", (0, 1): "Age", (1, 0): "Ann", (1, 1): "31", (2, 0): "below"}
    assert tables.level_tables(frames.limit(0), b).count() == 0
    lines = [(70.0, y, 240.0, y) for y in (710.0, 690.0, 670.0, 600.0)]
    walls = [(x, a, x, z) for x in (70.0, 150.0, 200.0, 240.0) for a, z in ((691.0, 710.0), (669.0, 690.0))]
    rules = spark.createDataFrame([("t", 1, *r) for r in lines + walls[:-1] + walls[:1]], "doc_id string, page_number int, x1 double, y1 double, x2 double, y2 double")
    levels = rules.where("y1 = y2").select("doc_id", "page_number", F.col("y1").alias("y"))
    found = {(r.upper, r.lower): (r.columns, r.outer) for r in tables.bridges(levels, rules).collect()}
    assert found == {(710.0, 690.0): (4, False), (690.0, 670.0): (3, False), (670.0, 600.0): (0, True)}
    groups = sorted((r.group, r.y) for r in tables.line_groups(levels, rules).collect())
    assert groups == [(0, 670.0), (0, 690.0), (0, 710.0), (1, 600.0)]
    # Where only few walls go on inside, the line belongs to both groups.
    fewer = rules.where("not (y1 = 669 and x1 <> 150)")
    assert sorted((r.group, r.y) for r in tables.line_groups(levels, fewer).collect()) == [(0, 690.0), (0, 710.0), (1, 670.0), (1, 690.0), (2, 600.0)]
    rays = {r.seq: (r.up, r.down, r.left, r.right) for r in tables.rays(b, rules).collect()}
    assert rays[0] == (True, True, True, True) and rays[5] == (True, False, False, False)
    assert tables.rays(b, rules.limit(0)).count() == 0 and tables.bridges(levels.limit(0), rules).count() == 0


def test_versions_and_journals(spark):
    rows = spark.createDataFrame([(1, "d", "a b c d"), (2, "d", "a b c x"), (3, "d", "a b"), (4, "e", "a b c d"), (5, "d", None), (1, "d", "a b c d")], "k int, docket string, text string")
    got = {(r.a, r.b): (r.a_in_b, r.b_in_a) for r in evaluation.contained_versions(rows, ["docket"], "k", "text").collect()}
    assert got[1, 2] == (0.5, 0.5) and got[1, 3] == (0.0, None) and len(got) == 6
    assert evaluation.first_documents(rows, 0, "k").count() == 6 and {r.k for r in evaluation.first_documents(rows, 2, "k").collect()} == {1, 2}
    assert {r.k for r in evaluation.recorded(rows, rows.where("k = 3"), ["k"]).collect()} == {3}


def test_pictures_and_addresses_of_files(spark, tmp_path, capsys):
    from tests.core.test_formats import PAGE, document

    raw = bytes([255, 0, 0, 0, 255, 0])
    image = b"<< /Type /XObject /Subtype /Image /Width 2 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceRGB /Length 6 >>\nstream\n" + raw + b"\nendstream"
    data = document(PAGE).replace(b"/F2 6 0 R >> >> >>", b"/F2 6 0 R >> /XObject << /I 7 0 R >> >> >>") + b"\n7 0 obj\n" + image + b"\nendobj\n"
    docs = spark.createDataFrame([("a", data, "x"), ("b", b"no pdf", "x"), ("n", None, "x")], "doc_id string, content binary, name string")
    rows = {r.doc_id: r for r in convert.pdf_pictures(docs).collect()}
    assert rows["a"].name == "a-p1-0.png" and rows["a"].error is None and rows["b"].error and set(rows) == {"a", "b"}
    files.write_images(convert.pdf_pictures(docs), str(tmp_path / "pictures"))
    assert [p.name for p in (tmp_path / "pictures").iterdir()] == ["a-p1-0.png"]
    files.write_images(convert.pdf_pictures(docs), f"file://{tmp_path}/table")
    assert spark.read.parquet(f"{tmp_path}/table").count() == 1
    (tmp_path / "a b.pdf").write_bytes(data)
    assert cli.main(["c", str(tmp_path / "a b.pdf"), "--image-dir", str(tmp_path / "out")]) == 0 and (tmp_path / "out" / "a b-p1-0.png").exists()
    (tmp_path / "t.csv").write_text("a,b\n1,2")
    found = fetch.convert_address(f"file://{tmp_path}/t.csv")
    assert found["converter"] == "csv" and fetch.convert_address(f"file://{tmp_path}/t.csv", only="plain-text")["markdown"].startswith("```csv")
    assert fetch.convert_address(f"file://{tmp_path}/a%20b.pdf")["converter"] == "pdf" and fetch.convert_address(f"file://{tmp_path}/none")["errors"]
    capsys.readouterr()


def test_regions_of_some_size(spark):
    rows = spark.createDataFrame([("a", 1, 3, 10.9, 60.0), ("a", 1, 1, 100.0, 5.9), ("a", 1, 2, None, 99.0), ("a", 2, 1, 20.0, 24.9), ("a", 2, 2, 20.0, 25.0)], "doc_id string, page_number int, k int, width double, height double")
    found = {(r.page_number, r.k): r.id for r in layout.sized_regions(rows, F.col("width"), F.col("height"), "k", 500).collect()}
    assert found == {(1, 1): "p1-i0", (1, 3): "p1-i1", (2, 2): "p2-i0"}
    assert layout.sized_regions(rows.limit(0), F.col("width"), F.col("height"), "k").count() == 0
