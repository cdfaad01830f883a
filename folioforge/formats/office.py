"""Word, PowerPoint, Excel, EPUB and the 2009 iWork packages."""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET

from folioforge.formats.markdown import html_to_markdown, normalized_tables, strip_blocks, table
from folioforge.formats.package import Package, attribute, below, kid, kids, local

# ---------------------------------------------------------------- Word


class Word:
    """Turns the body of a document into HTML, which Markdown is made from."""

    HEADINGS = {"Title": 1, **{f"Heading{s}{n}": n for n in range(1, 7) for s in ("", " ")}}

    def __init__(self, data: bytes):
        self.package = Package(data)
        self.part = self.package.main_part("word/document.xml")
        self.root = self.package.xml(self.part)
        if self.root is None:
            raise ValueError(f"no main part {self.part}")
        self.rels = self.package.relations(self.part)
        self.ordered = self.numbering()
        self.images = 0

    def numbering(self) -> dict[str, bool]:
        """numId -> whether its list is ordered: any format but bullets and none, by its first level."""
        parts = sorted((i, t) for i, (kind, t) in self.rels.items() if kind.endswith("/numbering"))
        root = self.package.xml(parts[0][1]) if parts else None
        kinds = {}
        for a in kids(root, "abstractNum"):
            first = next(iter(below(a, "numFmt")), None)
            kinds[attribute(a, "abstractNumId")] = first is not None and attribute(first, "val") not in ("bullet", "none")
        return {attribute(n, "numId"): kinds.get(attribute(kid(n, "abstractNumId"), "val"), False) for n in kids(root, "num") if kid(n, "abstractNumId") is not None}

    def convert(self) -> str:
        blocks, lists = [], []

        def close(to: int = 0) -> None:
            while len(lists) > to:
                blocks.append(f"</{lists.pop()[2]}>")

        for node in kid(self.root, "body") if kid(self.root, "body") is not None else ():
            kind = local(node.tag)
            if kind == "tbl":
                close()
                blocks.append(self.table(node))
            elif kind == "p":
                inner = self.inline(node)
                number = attribute(kid(node, "pPr", "numPr", "numId"), "val") if kid(node, "pPr", "numPr", "numId") is not None else None
                if number and number != "0":
                    level = kid(node, "pPr", "numPr", "ilvl")
                    depth = int(attribute(level, "val") or 0) if level is not None else 0
                    # A list stays open for its own items of this depth or more.
                    while lists and (lists[-1][0] != number or lists[-1][1] > depth):
                        close(len(lists) - 1)
                    if not lists or lists[-1][1] < depth:
                        tag = "ol" if self.ordered.get(number) else "ul"
                        lists.append((number, depth, tag))
                        blocks.append(f"<{tag}>")
                    blocks.append(f"<li>{inner}</li>")
                    continue
                close()
                style = kid(node, "pPr", "pStyle")
                level = self.HEADINGS.get(attribute(style, "val") or "") if style is not None else None
                if level or inner.strip():
                    tag = f"h{level}" if level else "p"
                    blocks.append(f"<{tag}>{inner}</{tag}>")
        close()
        return html_to_markdown(normalized_tables("\n".join(blocks)))

    def table(self, node: ET.Element) -> str:
        rows = []
        for tr in kids(node, "tr"):
            cells = ["<br>".join(x for x in map(self.inline, kids(tc, "p")) if x.strip()) for tc in kids(tr, "tc")]
            rows.append("<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>")
        return "<table>" + "".join(rows) + "</table>"

    def inline(self, node: ET.Element) -> str:
        out = []
        for child in node:
            kind = local(child.tag)
            if kind == "r":
                out.append(self.run(child))
            elif kind == "hyperlink":
                inner = "".join(self.run(r) for r in kids(child, "r"))
                rel = self.rels.get(attribute(child, "id") or "")
                out.append(f'<a href="{html.escape(rel[1])}">{inner}</a>' if rel and rel[0].endswith("/hyperlink") else inner)
        return "".join(out)

    def run(self, node: ET.Element) -> str:
        text, marks = [], {local(p.tag) for p in kid(node, "rPr")} if kid(node, "rPr") is not None else set()
        for child in node:
            kind = local(child.tag)
            if kind == "t":
                text.append(html.escape(child.text or ""))
            elif kind == "tab":
                text.append("\t")
            elif kind == "br":
                text.append("<br>")
            elif kind in ("drawing", "pict"):
                for blip in below(child, "blip") + below(child, "imagedata"):
                    rel = self.rels.get(attribute(blip, "embed") or attribute(blip, "id") or "")
                    if rel and "image" in rel[0] and rel[1] in self.package.infos:
                        self.images += 1
                        text.append(f"IMAGE{self.images}TOKEN")
        inner = "".join(text)
        for mark, tag in (("strike", "del"), ("i", "em"), ("b", "strong")):
            if inner and mark in marks:
                inner = f"<{tag}>{inner}</{tag}>"
        return inner


def docx(data: bytes, info: dict) -> tuple[str, str | None]:
    text = Word(data).convert()
    return re.sub(r"IMAGE(\d+)TOKEN", r"<!-- image: image_\1 -->", text), None


# ---------------------------------------------------------------- PowerPoint


def _paragraphs(shape: ET.Element | None) -> str:
    lines = ["".join(t.text or "" for t in below(p, "t")) for p in kids(kid(shape, "txBody"), "p")]
    return "\n".join(lines).strip()


def pptx(data: bytes, info: dict) -> tuple[str, str | None]:
    package = Package(data)
    main = package.main_part("ppt/presentation.xml")
    root = package.xml(main)
    if root is None:
        raise ValueError(f"no main part {main}")
    rels = package.relations(main)
    order = [rels.get(attribute(s, "id") or s.get("id", "")) for s in kids(kid(root, "sldIdLst"), "sldId") for s in [_relation(s)]]
    slides = [t for r in order if r for kind, t in [r] if kind.endswith("/slide")]
    if not slides:
        slides = sorted((n for n in package.names() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml$", n).group(1)))
    sections, images = [], 0
    for number, part in enumerate(slides, 1):
        try:
            slide = package.xml(part)
        except ET.ParseError:
            continue
        if slide is None:
            continue
        own, tree = package.relations(part), kid(slide, "cSld", "spTree")
        lines, texts = [f"<!-- Slide {number} -->"], [t for t in map(_paragraphs, kids(tree, "sp")) if t]
        lines += [("# " + t) if k == 0 else t for k, t in enumerate(texts)]
        for picture in kids(tree, "pic"):
            blip = kid(picture, "blipFill", "blip")
            rel = own.get(attribute(blip, "embed") or "") if blip is not None else None
            if rel and rel[0].endswith("/image") and rel[1] in package.infos:
                images += 1
                label = kid(picture, "nvPicPr", "cNvPr")
                name = label.get("name") if label is not None else None
                lines.append(f"<!-- image: {name or f'image_{images}'} (slide {number}) -->")
        for frame in kids(tree, "graphicFrame"):
            grid = kid(frame, "graphic", "graphicData", "tbl")
            rows = [[" ".join("".join(t.text or "" for t in below(p, "t")) for p in kids(kid(c, "txBody"), "p")).strip() for c in kids(r, "tc")] for r in kids(grid, "tr")]
            if rows:
                lines.append(table(rows))
        notes = min(((i, t) for i, (kind, t) in own.items() if kind.endswith("/notesSlide")), default=None)
        page = package.xml(notes[1]) if notes else None
        said = []
        for shape in kids(kid(page, "cSld", "spTree"), "sp"):
            holder = kid(shape, "nvSpPr", "nvPr", "ph")
            if (holder is None or holder.get("type") != "sldImg") and (text := _paragraphs(shape)):
                said.append(text)
        if said:
            lines += ["\n### Notes:", "\n".join(said)]
        sections.append("\n".join(lines))
    return "\n\n".join(sections).strip(), None


def _relation(node: ET.Element) -> ET.Element:
    """``node`` with only its relationship id: slides have a plain id beside it."""
    out = ET.Element("x")
    for k, v in node.attrib.items():
        if k.startswith("{") and local(k) == "id":
            out.set("id", v)
    return out


# ---------------------------------------------------------------- Excel


def xlsx(data: bytes, info: dict) -> tuple[str, str | None]:
    package = Package(data)
    book = package.xml("xl/workbook.xml")
    if book is None:
        raise ValueError("no workbook")
    rels = package.relations("xl/workbook.xml")
    strings = ["".join(t.text or "" for t in below(s, "t")) for s in kids(package.xml("xl/sharedStrings.xml"), "si")]
    sections = []
    for sheet in kids(kid(book, "sheets"), "sheet"):
        rel = rels.get(_relation(sheet).get("id", ""))
        page = package.xml(rel[1]) if rel else None
        rows = [[_cell(c, strings) for c in kids(r, "c")] for r in kids(kid(page, "sheetData"), "row")]
        rows = [r for r in rows if r]
        if rows:
            sections.append(f"## {sheet.get('name', '')}\n\n{table(rows)}")
    return "\n\n".join(sections).strip(), None


def _cell(cell: ET.Element, strings: list[str]) -> str:
    kind, value = cell.get("t"), kid(cell, "v")
    text = (value.text or "") if value is not None else ""
    if kind == "s":
        return strings[int(text)] if text.isdigit() and int(text) < len(strings) else ""
    if kind == "inlineStr":
        return "".join(t.text or "" for t in below(kid(cell, "is"), "t"))
    if kind == "b":
        return "TRUE" if text == "1" else "FALSE"
    return text


# ---------------------------------------------------------------- EPUB


def epub(data: bytes, info: dict) -> tuple[str, str | None]:
    package = Package(data)
    found = [n.get("full-path") for n in below(package.xml("META-INF/container.xml"), "rootfile")]
    if not found or found[0] is None:
        raise ValueError("no package document")
    root = package.xml(found[0])
    if root is None:
        raise ValueError(f"no package document {found[0]}")
    folder = found[0].rpartition("/")[0]
    said = lambda name: [t for n in below(kid(root, "metadata"), name) if (t := "".join(n.itertext()).strip())]
    title = next(iter(said("title")), None)
    facts = [("Title", title), ("Authors", ", ".join(said("creator")) or None), *((k.capitalize(), next(iter(said(k)), None)) for k in ("language", "publisher", "date", "description"))]
    sections = ["\n".join(f"**{k}:** {v}" for k, v in facts if v)] if any(v for _, v in facts) else []
    manifest = {i.get("id"): i.get("href") for i in kids(kid(root, "manifest"), "item")}
    for ref in kids(kid(root, "spine"), "itemref"):
        href = manifest.get(ref.get("idref"))
        page = package.read(f"{folder}/{href}".lstrip("/")) if href else None
        if page is not None:
            text = html_to_markdown(normalized_tables(strip_blocks(page.decode("utf-8"))))
            if text:
                sections.append(text)
    return "\n\n".join(sections).strip(), title


# ---------------------------------------------------------------- iWork

def style_mark(style: str) -> str:
    """The Markdown mark of a paragraph's style: a title's is one sign, a heading's one more than its number, up to four."""
    if "title" in style:
        return "# "
    heading = re.search(r"heading[- ]([1-4])", style)
    return "#" * (int(heading[1]) + 1) + " " if heading else "*" if "caption" in style else ""


PICTURES = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".tiff", ".bmp")


def iwork(data: bytes, info: dict) -> tuple[str, str | None]:
    package, kind = Package(data), info.get("extension") or ""
    part = {".pages": "index.xml", ".key": "index.apxl", ".numbers": "index.xml"}.get(kind)
    if part is None:
        raise ValueError(f"Unsupported iWork format: {kind}")
    root = package.xml(part)
    if root is None:
        raise ValueError(f"Invalid iWork file: missing {part}")
    if kind == ".numbers":
        return _numbers(root), None
    pictures = [n for n in package.names() if n.lower().endswith(PICTURES) and not n.startswith("QuickLook/")]
    shown = [f"<!-- image: {n.rpartition('/')[2] or f'image_{k}'} -->" for k, n in enumerate(pictures, 1)]
    if kind == ".pages":
        lines, title = [], None
        for p in below(root, "p"):
            text = "".join(p.itertext()).strip()
            if text:
                style = (attribute(p, "style") or "").lower()
                lines.append(style_mark(style) + text)
                title = title or text
        return "\n\n".join(lines + shown).strip(), title
    sections, title = [], None
    for number, slide in enumerate(below(root, "slide"), 1):
        texts = [t for p in below(slide, "p") if (t := "".join(p.itertext()).strip())]
        title = title or next(iter(texts), None)
        sections.append("\n".join([f"<!-- Slide {number} -->", *(("# " + t) if k == 0 else t for k, t in enumerate(texts))]))
    return "\n\n".join(sections + shown).strip(), title


def _numbers(root: ET.Element) -> str:
    sections = []
    for sheet in below(root, "grid"):
        rows = _grid(sheet)
        if rows:
            sections.append(table(rows))
    if sections:
        return "\n\n".join(sections)
    values = [attribute(kid(n, "ct"), "s") if local(n.tag) == "t" and kid(n, "ct") is not None else attribute(n, "v") if local(n.tag) == "n" else None for n in root.iter()]
    return "\n".join(v for v in values if v)


def _grid(grid: ET.Element) -> list[list[str]]:
    """Cells in rows of the grid's width; fewer cells than one row are laid out in pairs."""
    values = []
    for cell in kid(grid, "datasource") if kid(grid, "datasource") is not None else ():
        kind, v = local(cell.tag), attribute(cell, "v")
        if kind == "t":
            ct = kid(cell, "ct")
            values.append((attribute(ct, "s") or "") if ct is not None else "".join(cell.itertext()).strip())
        elif kind in ("n", "d", "du"):
            values.append(v or "")
        elif kind == "b":
            values.append("TRUE" if v == "1" else "FALSE")
        elif kind == "e":
            values.append("")
    width = int(attribute(grid, "numcols") or 0) if (attribute(grid, "numcols") or "0").isdigit() else 0
    if values and len(values) < width:
        width = 2 if len(values) % 2 == 0 else 1
    width = width or len(values) or 1
    return [values[i : i + width] for i in range(0, len(values), width)]
