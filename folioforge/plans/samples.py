"""Files of every format, made from rows, for the queries that convert them: each function gives the bytes of one file."""

from __future__ import annotations

import io
import wave
import zipfile
from xml.sax.saxutils import escape

# Names of parts and kinds that the formats prescribe.
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
WORDS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
SHEETS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"

Rows = list[tuple[int, str]]


def packed(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def relations(*links: tuple[str, str, str]) -> str:
    inside = "".join(f'<Relationship Id="{i}" Type="{RELATIONS}/{kind}" Target="{target}"/>' for i, kind, target in links)
    return f'<Relationships xmlns="{PACKAGE}">{inside}</Relationships>'


def word(name: str, rows: Rows) -> bytes:
    """A heading, a paragraph with bold text, a numbered list of the rows' names, and a table of the rows."""
    run = lambda t, bold=False: f'<w:r>{"<w:rPr><w:b/></w:rPr>" if bold else ""}<w:t xml:space="preserve">{escape(t)}</w:t></w:r>'
    cell = lambda t: f"<w:tc><w:p>{run(t)}</w:p></w:tc>"
    listed = "".join(f'<w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr>{run(t)}</w:p>' for _, t in rows)
    grid = "".join(f"<w:tr>{cell(a)}{cell(b)}</w:tr>" for a, b in [("Key", "Name"), *((str(k), t) for k, t in rows)])
    body = f'<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr>{run(name)}</w:p><w:p>{run("Suppliers", True)}{run(" by number")}</w:p>{listed}<w:tbl>{grid}</w:tbl>'
    numbering = '<w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num>'
    return packed(
        {
            "_rels/.rels": relations(("r1", "officeDocument", "word/document.xml")),
            "word/document.xml": f'<w:document xmlns:w="{WORDS}"><w:body>{body}</w:body></w:document>',
            "word/_rels/document.xml.rels": relations(("r1", "numbering", "numbering.xml")),
            "word/numbering.xml": f'<w:numbering xmlns:w="{WORDS}">{numbering}</w:numbering>',
        }
    )


def slides(name: str, rows: Rows) -> bytes:
    """A slide for each row; the order of the deck runs against that of the parts' names."""
    ns = f'xmlns:a="a" xmlns:p="p" xmlns:r="{RELATIONS}"'
    shape = lambda t: f"<p:sp><p:txBody><a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p></p:txBody></p:sp>"
    n = len(rows)
    parts = {f"ppt/slides/slide{n - i}.xml": f"<p:sld {ns}><p:cSld><p:spTree>{shape(t)}{shape(f'Key {k} of {name}')}</p:spTree></p:cSld></p:sld>" for i, (k, t) in enumerate(rows)}
    ids = "".join(f'<p:sldId id="{256 + i}" r:id="r{n - i}"/>' for i in range(n))
    deck = f"<p:presentation {ns}><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>"
    return packed({"ppt/presentation.xml": deck, "ppt/_rels/presentation.xml.rels": relations(*((f"r{i}", "slide", f"slides/slide{i}.xml") for i in range(1, n + 1))), **parts})


def workbook(name: str, rows: Rows) -> bytes:
    """One sheet with a head, numbers and shared strings."""
    strings = ["Key", "Name", *(t for _, t in rows)]
    lines = ['<row><c t="s"><v>0</v></c><c t="s"><v>1</v></c></row>', *(f'<row><c><v>{k}</v></c><c t="s"><v>{i}</v></c></row>' for i, (k, _) in enumerate(rows, 2))]
    return packed(
        {
            "xl/workbook.xml": f'<workbook xmlns="{SHEETS}" xmlns:r="{RELATIONS}"><sheets><sheet name="{escape(name)}" sheetId="1" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": relations(("r1", "worksheet", "worksheets/sheet1.xml")),
            "xl/sharedStrings.xml": f'<sst xmlns="{SHEETS}">{"".join(f"<si><t>{escape(t)}</t></si>" for t in strings)}</sst>',
            "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{SHEETS}"><sheetData>{"".join(lines)}</sheetData></worksheet>',
        }
    )


def book(name: str, rows: Rows) -> bytes:
    """A chapter for each row, in the order of the spine."""
    items = "".join(f'<item id="c{k}" href="c{k}.xhtml"/>' for k, _ in reversed(rows))
    spine = "".join(f'<itemref idref="c{k}"/>' for k, _ in rows)
    opf = f'<package xmlns:dc="d"><metadata><dc:title>{escape(name)}</dc:title><dc:creator>First Author</dc:creator><dc:creator>Second Author</dc:creator></metadata><manifest>{items}</manifest><spine>{spine}</spine></package>'
    chapters = {f"book/c{k}.xhtml": f"<html><body><h1>{escape(t)}</h1><p>Key {k}</p></body></html>" for k, t in rows}
    return packed({"META-INF/container.xml": '<container><rootfiles><rootfile full-path="book/book.opf"/></rootfiles></container>', "book/book.opf": opf, **chapters})


def pages(name: str, rows: Rows) -> bytes:
    """A text with a styled heading and a paragraph for each row."""
    sf = 'xmlns:sf="http://developer.apple.com/namespaces/sf"'
    return packed({"index.xml": f'<d {sf}><sf:p sf:style="Heading-2">{escape(name)}</sf:p>{"".join(f"<sf:p>{escape(t)}</sf:p>" for _, t in rows)}</d>'})


def archive(name: str, rows: Rows) -> bytes:
    """A table, a page, a text and an archive in an archive."""
    table = "key,name\n" + "".join(f"{k},{t}\n" for k, t in rows)
    return packed({"rows.csv": table, "page.html": f"<h2>{escape(name)}</h2>", "note.txt": "plain", "inner.zip": packed({"x.csv": "a"})})


def recording(name: str, rows: Rows) -> bytes:
    """Seven seconds of silence for each row."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(1000)
        w.writeframes(bytes(2000 * 7 * len(rows)))
    return out.getvalue()


def pdf(contents: list[bytes]) -> bytes:
    """A document of pages with these contents, in two fonts."""
    n = len(contents)
    kids = " ".join(f"{5 + 2 * i} 0 R" for i in range(n))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {n} /MediaBox [0 0 612 792] >>".encode(), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold >>"]
    for i, content in enumerate(contents):
        objects.append(f"<< /Type /Page /Parent 2 0 R /Contents {6 + 2 * i} 0 R /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>".encode())
        objects.append(b"<< /Length %d >>\nstream\n" % len(content) + content + b"\nendstream")
    out, at = b"%PDF-1.4\n", []
    for i, o in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n" % i + o + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in at)
    return out + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, start)


def shown(font: str, size: int, x: float, y: float, text: str) -> str:
    safe = text.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")
    return f"BT /{font} {size} Tf {x} {y} Td ({safe}) Tj ET\n"


def printed(name: str, rows: Rows, page: int = 15) -> bytes:
    """A title on the first page, and a paragraph of two lines for each row, the second broken at a hyphen."""
    contents = []
    for first in range(0, max(len(rows), 1), page):
        text = shown("F2", 24, 72, 720, name) if not first else ""
        for i, (k, t) in enumerate(rows[first : first + page]):
            text += shown("F1", 11, 72, 660 - 40 * i, f"The register names {t} as the sup-") + shown("F1", 11, 72, 647 - 40 * i, f"plier of number {k} here.")
        contents.append(text.encode())
    return pdf(contents)


def ruled(name: str, rows: Rows, page: int = 19) -> bytes:
    """The rows as tables framed by ruling lines, each page's under its own head, clear of the margins where lone numbers are page numbers."""
    contents = []
    for first in range(0, max(len(rows), 1), page):
        lines = [("Key", "Name"), *((str(k), t) for k, t in rows[first : first + page])]
        top, low = 640, 640 - 24 * len(lines)
        rules = "".join(f"72 {top - 24 * i} m 372 {top - 24 * i} l S " for i in range(len(lines) + 1)) + "".join(f"{x} {low} m {x} {top} l S " for x in (72, 172, 372))
        text = "".join(shown("F1", 10, 80, top - 24 * i - 16, a) + shown("F1", 10, 180, top - 24 * i - 16, b) for i, (a, b) in enumerate(lines))
        contents.append(f"0.5 w {rules}\n{text}".encode())
    return pdf(contents)
