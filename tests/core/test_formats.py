import io
import struct
import wave
import zipfile
import zlib

import pytest

from folioforge.formats import media, office, pdf, text
from folioforge.formats.markdown import html_to_markdown, normalized_tables, strip_blocks, table, title_of
from folioforge.formats.registry import FORMATS, RULES, convert, extension, failure


def packed(parts: dict) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
KIND = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


@pytest.mark.parametrize(
    ("html", "markdown"),
    [
        ("<h2>A <em>b</em></h2>", "## A _b_"),
        ("<p>a <b>bold </b>word<br>next</p>", "a **bold** word  \nnext"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"),
        ("<ol start=3><li>x</li><li>y</li></ol>", "3. x\n4. y"),
        ('<pre><code class="language-py">x=1\n</code></pre>', "```py\nx=1\n```"),
        ("<pre><code>a\n```\nb</code></pre>", "````\na\n```\nb\n````"),
        ("<p>1. not *list* [x]_</p>", "1\\. not \\*list\\* \\[x\\]\\_"),
        ("<blockquote><p>a</p><p>b</p></blockquote>", "> a\n> \n> b"),
        ('<a href="/x(1)" title="t">l</a> <img src="a.png" alt="z"><img alt="n">', '[l](/x\\(1\\) "t") ![z](a.png)'),
        ("<p><b>1<p>2</b>3</p>", "**1**\n\n**2**3"),
        ("<p>one<b>two<p>three</p></b>four", "one**two**\n\n**three**\n\nfour"),
        ("<p>use <code>a`b</code> now</p>", "use ``a`b`` now"),
        ("<del>x</del><hr>y &amp; z&nbsp;w", "~~x~~\n\n* * *\n\ny & z\xa0w"),
        ("<noscript>kept</noscript><script>x</script><style>y</style>", "kept"),
        ("<p>  many   spaces \n here </p>", "many spaces here"),
        ("<b> </b><p></p>text<i>!</i>", "text_!_"),
        ("", ""),
        ("a < b &copy; &middot;", "a < b © ·"),
    ],
)
def test_html(html, markdown):
    assert html_to_markdown(html) == markdown


def test_depth_and_length():
    import time

    assert html_to_markdown("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert html_to_markdown("<b>" * 3000 + "x" + "</b>" * 3000).strip("*") == "x"
    began = time.perf_counter()
    items = html_to_markdown("<ol>" + "<li>x</li>" * 40_000 + "</ol>").split("\n")
    assert items[-1] == "40000. x" and len(items) == 40_000 and time.perf_counter() - began < 20
    # Parts of tables outside of one are no tables.
    assert html_to_markdown("<tr>a<td>b</td></tr>") == "ab"


def test_tables():
    html = "<table><tr><td>a</td><td><p>b</p><p>c</p></td></tr><tr><td>1<td>2</table>"
    assert html_to_markdown(normalized_tables(html)) == "| a | b c |\n| --- | --- |\n| 1 | 2 |"
    assert html_to_markdown("<table><tr><td>a</td></tr></table>") == "<table><tbody><tr><td>a</td></tr></tbody></table>"
    assert "| :-- | --: |" in html_to_markdown('<table><tr><th align="left">a</th><th align="right">b</th></tr></table>')
    assert table([["a", "b"], ["1"]]) == "| a | b |\n| --- | --- |\n| 1 |  |"


def test_page():
    html = "<html><head><title> T </title><style>p{}</style></head><body><script>var a='</p>';</script><p>x</p></body></html>"
    assert title_of(html) == "T"
    assert convert(html.encode(), {"extension": ".html"})["markdown"] == "T\n\nx"
    assert "script" not in strip_blocks(html)


def test_csv():
    assert text.csv(b'h,"a,b"\n1\n\n"x""y", 2 ,3\r\n', {"extension": ".csv"})[0] == '| h | a,b |\n| --- | --- |\n| 1 |  |\n| x"y | 2 | 3 |'
    assert text.csv(b"a\tb\n1\t2", {"extension": ".tsv"})[0].endswith("| 1 | 2 |")
    assert text.csv(b"a\tb", {"mimetype": "text/tab-separated-values"})[0].startswith("| a\tb |")
    assert text.csv(b"", {})[0] == ""


def test_plain_formats():
    assert convert(b'{"b":1,"a":[1.50]}', {"extension": ".json"})["markdown"] == '```json\n{\n  "b": 1,\n  "a": [\n    1.5\n  ]\n}\n```'
    assert convert(b"a: 1", {"mimetype": "text/yaml"})["markdown"] == "```yaml\na: 1\n```"
    assert convert(b"<a/>", {"extension": ".xml"}) == {"converter": "xml", "markdown": "```xml\n<a/>\n```", "title": None, "errors": [{"converter": "rss", "message": "Not an RSS or Atom feed"}]}
    assert convert(b"x", {"extension": ".svg", "filename": "p.svg"})["markdown"] == "*[image: p.svg]*"
    assert convert(b"\xff", {})["markdown"] == "�"
    assert convert(b"x=1", {"extension": ".py"})["markdown"] == "```py\nx=1\n```"


def test_failures():
    bad = convert(b"x", {"extension": ".PDF"})
    assert failure(bad["errors"]) == "Unsupported format: .PDF"
    bad = convert(b"no zip", {"extension": ".docx"})
    assert failure(bad["errors"]).startswith("Conversion failed:\n  docx: ")
    assert convert(None, {"extension": ".txt"})["markdown"] is None


def test_notebook():
    book = '{"metadata":{"kernelspec":{"language":"r"}},"cells":[{"cell_type":"markdown","source":["# T\\n","x"]},{"cell_type":"code","source":"a","outputs":[{"output_type":"stream","text":["o\\n"]},{"output_type":"error","ename":"E","evalue":"v","traceback":["t"]},{"output_type":"execute_result","data":{"text/plain":"2"}}]},{"cell_type":"raw","source":"r"}]}'
    assert text.ipynb(book.encode(), {}) == ("# T\nx\n\n```r\na\n```\n\n```\no\nError: E: v\n2\n```\n\n```\nr\n```", "T")


def test_feeds():
    rss = b"<rss><channel><title>T</title><description>D &lt;b&gt;x&lt;/b&gt;</description><item><title><![CDATA[A]]></title><pubDate>p</pubDate><link>http://x</link><description><![CDATA[<p>hi</p>]]></description></item></channel></rss>"
    assert text.feed(rss, {}) == ("# T\n\nD **x**\n\n## A\nPublished: p\n[Link](http://x)\nhi", "T")
    atom = b"<feed><title>F</title><subtitle>s</subtitle><entry><title>E</title><updated>u</updated><summary>m</summary></entry></feed>"
    assert text.feed(atom, {}) == ("# F\n\ns\n\n## E\nUpdated: u\nm", "F")


def test_feeds_with_faults():
    # An element without an end, an empty one, a namespace, upper case, and a feed without a channel.
    rss = b"<RSS><CHANNEL><TITLE>T</TITLE><item><title>A<link>http://x</link></item><item/><item><title>B &amp; C</title><content:encoded><![CDATA[<b>x</b>]]></content:encoded><description>no</description></item></CHANNEL></RSS>"
    body, title = text.feed(rss, {})
    assert title == "T" and "[Link](http://x)" in body and body.endswith("## B &amp; C\n**x**")
    assert text.feed(b"<rss><item><title>only</title></item></rss>", {})[0] == "## only" or text.feed(b"<rss><item><title>only</title></item></rss>", {})[1] == "only"
    with pytest.raises(ValueError):
        text.feed(b"<html></html>", {})


def test_encyclopedia():
    html = '<title>Fence - Wikipedia</title><div id="mw-content-text"><p>A<sup class="reference">[1]</sup> fence.</p></div></div>'
    assert text.wikipedia(html.encode(), {}) == ("# Fence\n\nA fence.", "Fence")


def test_word():
    body = f"""<w:document {W}><w:body>
    <w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p>
    <w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:r><w:t xml:space="preserve"> &amp; </w:t></w:r><w:hyperlink r:id="h"><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p>
    <w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>one</w:t></w:r></w:p>
    <w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>two</w:t></w:r></w:p>
    <w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>2</w:t></w:r></w:p></w:tc></w:tr></w:tbl>
    <w:p><w:r><w:drawing><x:blip xmlns:x="x" r:embed="i"/></w:drawing></w:r></w:p></w:body></w:document>"""
    numbering = f'<w:numbering {W}><w:abstractNum w:abstractNumId="7"><w:lvl><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num></w:numbering>'
    rels = RELS.format(f'<Relationship Id="h" Type="{KIND}hyperlink" Target="http://x/" TargetMode="External"/><Relationship Id="n" Type="{KIND}numbering" Target="numbering.xml"/><Relationship Id="i" Type="{KIND}image" Target="media/a.png"/>')
    main = RELS.format(f'<Relationship Id="r" Type="{KIND}officeDocument" Target="other/doc.xml"/>')
    data = packed({"_rels/.rels": main, "other/doc.xml": body, "other/_rels/doc.xml.rels": rels, "other/numbering.xml": numbering, "other/media/a.png": b"x"})
    assert office.docx(data, {})[0] == "# Title\n\n**bold** & [link](http://x/)\n\n1. one\n2. two\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n<!-- image: image_1 -->"


def test_slides():
    ns = 'xmlns:a="a" xmlns:p="p" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    shape = "<p:sp><p:txBody><a:p><a:r><a:t>{}</a:t></a:r></a:p></p:txBody></p:sp>"
    grid = "<p:graphicFrame><a:graphic><a:graphicData><a:tbl><a:tr><a:tc><p:txBody><a:p><a:r><a:t>x</a:t></a:r></a:p></p:txBody></a:tc></a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>"
    slide = f"<p:sld {ns}><p:cSld><p:spTree>{grid}{shape.format('Head')}{shape.format('Body')}</p:spTree></p:cSld></p:sld>"
    notes = f"<p:notes {ns}><p:cSld><p:spTree>{shape.format('Said')}</p:spTree></p:cSld></p:notes>"
    deck = f'<p:presentation {ns}><p:sldIdLst><p:sldId id="256" r:id="r2"/><p:sldId id="257" r:id="r1"/></p:sldIdLst></p:presentation>'
    rels = RELS.format("".join(f'<Relationship Id="r{k}" Type="{KIND}slide" Target="slides/slide{k}.xml"/>' for k in (1, 2)))
    own = RELS.format(f'<Relationship Id="n" Type="{KIND}notesSlide" Target="../notes.xml"/>')
    parts = {"ppt/presentation.xml": deck, "ppt/_rels/presentation.xml.rels": rels, "ppt/slides/slide1.xml": slide.replace("Head", "Last"), "ppt/slides/slide2.xml": slide, "ppt/slides/_rels/slide2.xml.rels": own, "ppt/notes.xml": notes}
    assert office.pptx(packed(parts), {})[0] == "<!-- Slide 1 -->\n# Head\nBody\n| x |\n| --- |\n\n### Notes:\nSaid\n\n<!-- Slide 2 -->\n# Last\nBody\n| x |\n| --- |"


def test_sheets():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    parts = {
        "xl/workbook.xml": f'<workbook {ns}><sheets><sheet name="S" sheetId="1" r:id="a"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": RELS.format(f'<Relationship Id="a" Type="{KIND}worksheet" Target="/xl/worksheets/s.xml"/>'),
        "xl/sharedStrings.xml": f"<sst {ns}><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>",
        "xl/worksheets/s.xml": f'<worksheet {ns}><sheetData><row><c t="s"><v>0</v></c><c><v>1.5</v></c></row><row><c t="b"><v>1</v></c><c t="inlineStr"><is><t>i</t></is></c><c t="s"><v>9</v></c></row></sheetData></worksheet>',
    }
    assert office.xlsx(packed(parts), {})[0] == "## S\n\n| rich | 1.5 |  |\n| --- | --- | --- |\n| TRUE | i |  |"


def test_book():
    opf = '<package xmlns:dc="d"><metadata><dc:title>B</dc:title><dc:creator>X</dc:creator><dc:creator>Y</dc:creator></metadata><manifest><item id="c" href="c.xhtml"/></manifest><spine><itemref idref="c"/><itemref idref="gone"/></spine></package>'
    data = packed({"META-INF/container.xml": '<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>', "O/p.opf": opf, "O/c.xhtml": "<html><body><h1>One</h1></body></html>"})
    assert office.epub(data, {}) == ("**Title:** B\n**Authors:** X, Y\n\n# One", "B")


def test_iwork():
    sf = 'xmlns:sf="http://developer.apple.com/namespaces/sf" xmlns:sfa="http://developer.apple.com/namespaces/sfa"'
    pages = packed({"index.xml": f'<d {sf}><sf:p sf:style="Heading-1">H</sf:p><sf:p>t</sf:p></d>', "i.png": b"x", "QuickLook/t.png": b"x"})
    assert office.iwork(pages, {"extension": ".pages"}) == ("## H\n\nt\n\n<!-- image: i.png -->", "H")
    grid = f'<d {sf}><sf:grid sf:numcols="2"><sf:datasource><sf:t><sf:ct sfa:s="a"/></sf:t><sf:n sf:v="1"/><sf:b sf:v="1"/><sf:e/></sf:datasource></sf:grid></d>'
    assert office.iwork(packed({"index.xml": grid}), {"extension": ".numbers"})[0] == "| a | 1 |\n| --- | --- |\n| TRUE |  |"


def test_archive():
    data = packed({"a.csv": "x,y", "b.txt": "plain", "d/c.html": "<p>hi</p>", "e.bin": b"\0"})
    assert convert(data, {"extension": ".zip", "filename": "z.zip"})["markdown"] == "Content from `z.zip`:\n\n## File: a.csv\n\n| x | y |\n| --- | --- |\n\n## File: b.txt\n\n*[binary file]*\n\n## File: d/c.html\n\nhi\n\n## File: e.bin\n\n*[binary file]*"


def test_recording():
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(bytes(8000 * 4 * 65))
    assert media.audio(out.getvalue(), {})[0] == "## Metadata\n\nDuration: 1:05\nFormat: PCM\nSampleRate: 8000 Hz\nChannels: 2\nBitrate: 256 kbps"
    assert media.audio(b"?", {"filename": "a.mp3"})[0] == "*[audio: a.mp3]*"
    frame = lambda k, v: k + struct.pack(">I", len(v) + 1) + b"\0\0\0" + v
    tags = frame(b"TIT2", b"T") + frame(b"TRCK", b"3/9")
    head = b"ID3\3\0\0" + bytes([0, 0, len(tags) >> 7, len(tags) & 127])
    assert media.audio(head + tags + b"\xff\xfb\x90\x00" + bytes(16000), {})[0].startswith("## Metadata\n\nTitle: T\nTrack: 3 of 9\nDuration: 0:01\nFormat: MPEG 1 Layer 3")
    assert media.duration(3661) == "1:01:01"


def test_picture():
    entries = [(0x010F, 2, b"Make\0"), (0x0110, 2, b"Mod\0"), (0x0100, 3, struct.pack("<H", 9)), (0x0101, 3, struct.pack("<H", 8)), (0x829A, 5, struct.pack("<II", 1, 250)), (0x829D, 5, struct.pack("<II", 28, 10))]
    table_, heap, at = b"", b"", 8 + 2 + 12 * len(entries) + 4
    for tag, kind, raw in sorted(entries):
        count = len(raw) // {2: 1, 3: 2, 5: 8}[kind]
        value = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", at + len(heap))
        heap += raw if len(raw) > 4 else b""
        table_ += struct.pack("<HHI", tag, kind, count) + value
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(entries)) + table_ + bytes(4) + heap
    assert media.image(tiff, {})[0] == "## Metadata\n\nImageSize: 9x8\nCamera: Make Mod\nExposureTime: 1/250s\nFNumber: f/2.8"
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + b"\xff\xd9"
    assert "Make Mod" in media.image(jpeg, {})[0]


def document(content: bytes, compress: bool = False) -> bytes:
    extra = b""
    if compress:
        content, extra = zlib.compress(content), b"/Filter /FlateDecode "
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 612 792] >>",
        b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R /F2 6 0 R >> >> >>",
        b"<< " + extra + b"/Length %d >>\nstream\n" % len(content) + content + b"\nendstream",
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold >>",
    ]
    out, places = b"%PDF-1.4\n", []
    for i, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % i + o + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, start)


PAGE = b"BT /F2 24 Tf 72 700 Td (A title) Tj ET BT /F1 11 Tf 72 660 Td (The office measured the nor-) Tj 0 -13 Td (thern fence, so that it \\(opened\\) again.) Tj ET"


@pytest.mark.parametrize("compress", [False, True])
def test_pdf(compress):
    assert convert(document(PAGE, compress), {})["markdown"] == "# A title\n\nThe office measured the northern fence, so that it (opened) again."


def test_damaged_pdf():
    whole = document(PAGE)
    assert "northern" in convert(whole[:-70], {"extension": ".pdf"})["markdown"]
    assert convert(b"%PDF-1.4 nothing", {})["errors"][0]["converter"] == "pdf"
    import random

    rng = random.Random(1)
    for _ in range(150):
        data = bytearray(whole)
        for _ in range(6):
            data[rng.randrange(len(data))] = rng.randrange(256)
        found = convert(bytes(data), {"extension": ".pdf"})
        assert found["markdown"] is not None or found["errors"]


def test_pdf_table():
    rules = b"0.5 w 72 500 200 60 re S 72 530 m 272 530 l S 172 500 m 172 560 l S BT /F1 10 Tf 80 540 Td (Name) Tj 100 0 Td (Value) Tj ET BT /F1 10 Tf 80 510 Td (fence) Tj 100 0 Td (12) Tj ET"
    assert convert(document(rules), {"extension": ".pdf"})["markdown"] == "| Name | Value |\n| --- | --- |\n| fence | 12 |"


def test_level_rules_and_wide_boxes():
    from folioforge.formats import layout

    box = lambda t, x, y, w: {"text": t, "left": x, "right": x + w, "top": y + 5, "bottom": y - 5, "font": 10.0, "bold": False}
    cells = [box("Name", 80, 600, 40), box("Age", 200, 600, 30), box("Ann", 80, 580, 30), box("31", 200, 578, 15), box("last", 80, 555, 30), box("away", 80, 400, 30)]
    rules = [(70.0, 610.0, 240.0, 610.0), (70.0, 565.0, 240.0, 565.0)]
    found, rest = layout.ruled_tables(cells, rules)
    assert [r for _, r in found] == [[["Name", "Age"], ["Ann", "31"], ["last", ""]]] and [b["text"] for b in rest] == ["away"]
    # One column of sentences between two rules is no table.
    prose = [box("The office measured the northern fence again", 80 + 60 * (k % 2), 600 - 12 * k, 300) for k in range(12)]
    assert layout.ruled_tables(prose, [(70.0, 610.0, 500.0, 610.0), (70.0, 450.0, 500.0, 450.0)])[0] == []
    assert layout.apportioned("one two three", [10.0, 10.0]) == ["one two", "three"] and layout.apportioned("one two", [1.0, 50.0]) == ["one", "two"]
    walls = [(x, 560.0, x, 610.0) for x in (70.0, 150.0, 240.0)]
    framed = [(70.0, y, 240.0, y) for y in (560.0, 585.0, 610.0)]
    wide = [box("Key Name", 80, 597, 150), box("a", 80, 578, 10), box("b", 80, 567, 10), box("two words", 160, 572, 60)]
    assert layout.ruled_tables(wide, framed + walls)[0][0][1] == [["Key", "Name"], ["a<br>b", "two words"]]
    # Columns below many bands are still parted.
    page = [box("A heading over all of the page's width here", 70, 780 - 60 * k, 460) for k in range(9)] + [box(f"{side} text of three words", x, 200 - 12 * k, 180) for side, x in (("left", 70), ("right", 320)) for k in range(5)]
    groups = layout.columns(page)
    assert [g for g in groups if any("left" in b["text"] for b in g)] and not any({"left", "right"} <= {b["text"].split()[0] for b in g} for g in groups)


def test_ciphers_and_filters():
    key, start = bytes.fromhex("2b7e151628aed2a6abf7158809cf4f3c"), bytes(range(16))
    plain, secret = bytes.fromhex("6bc1bee22e409f96e93d7e117393172a"), bytes.fromhex("7649abac8119b246cee98e9b12e9197d")
    assert pdf.aes_encrypt(key, start, plain) == secret and pdf.aes_cbc(key, start, secret) == plain
    assert pdf.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    assert pdf._ascii85(b"87cURD]i,\"Ebo80~>") == b"Hello World!"
    assert pdf._run_length(b"\x02abc\xfex\x80") == b"abcxxx"
    assert pdf._lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == b"-----A---B"
    assert pdf.glyph_text("eacute") == "é" and pdf.glyph_text("uni00410042") == "AB" and pdf.glyph_text("f_i") == "fi"


def test_registry():
    assert [r.name for r in RULES][:3] == ["pdf", "docx", "pptx"] and RULES[-1].name == "plain-text" and len(RULES) == 19 and len(FORMATS) == 23
    assert extension("a/b.TAR.GZ") == ".gz" and extension(".env") is None and extension("x") is None


def test_layout_text():
    from folioforge.formats import layout

    assert layout.clean("caf´e ﬁn Ａ") == "café fin A"
    assert layout.right_to_left("ﺔﻴﺑﺮﻌﻟﺍ 12") == "12 العربية"
    assert layout.with_formulas("so x2 ≤ y and more") == "so $x^{2} \\leq y$ and more"
    assert layout.with_formulas("word1 next") == "word1 next"
    assert layout.escaped("a_b $x_{1}$ c*d") == "a\\_b $x_{1}$ c\\*d"
    assert layout.pruned([["", "a"], ["", ""], ["", "b"]]) == [["a"], ["b"]]
    assert layout.html_table([[("a&", 2, 1), ("b", 1, 1)]]) == '<table>\n<tr><td rowspan="2">a&amp;</td><td>b</td></tr>\n</table>'
    assert not layout.is_prose([["a", "b"]] * 3, 3)


def test_running_heads_leave():
    from folioforge.formats import layout

    item = lambda t, y: {"text": t, "x": 72.0, "y": y, "width": 6.0 * len(t), "size": 11.0, "bold": False}
    pages = [{"page_number": n, "page_width": 600.0, "page_height": 800.0, "items": [item("Annual report", 780), item(f"Text of page {n} stands here.", 600), item(str(n), 30)], "rules": [], "images": [(0, 0, 100, 100), (0, 0, 9, 9)]} for n in range(1, 7)]
    text = layout.render_pages(pages)
    assert "Annual" not in text and "Text of page 3" in text and "\n\n3\n" not in text
    assert text.count("<!-- image") == 6


def test_pictures():
    raw = bytes([255, 0, 0, 0, 255, 0])
    image = b"<< /Type /XObject /Subtype /Image /Width 2 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceRGB /Length 6 >>\nstream\n" + raw + b"\nendstream"
    data = document(PAGE).replace(b"/F2 6 0 R >> >> >>", b"/F2 6 0 R >> /XObject << /I 7 0 R >> >> >>") + b"\n7 0 obj\n" + image + b"\nendobj\n"
    found = pdf.pictures(data)
    assert [(p, e) for p, e, _ in found] == [(1, "png")] and found[0][2] == pdf.png(2, 1, 8, 2, raw)
