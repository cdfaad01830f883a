"""Text-like formats: CSV, JSON, YAML, XML, notebooks, feeds, HTML, encyclopedia pages, plain text."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from folioforge.formats.dom import Node, parse
from folioforge.formats.markdown import html_to_markdown, normalized_tables, strip_blocks, title_of, tree_to_markdown


def decoded(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def csv_rows(text: str, delimiter: str) -> list[list[str]]:
    """Rows of trimmed cells: quotes toggle anywhere, doubled ones stand for one, blank rows go.

    A cell is a run of bare signs and quoted pieces; a piece without an end reaches to the text's.
    """
    cell = re.compile(rf'((?:[^"{delimiter}\r\n]+|\r(?!\n)|"(?:[^"]|"")*(?:"|\Z))*)({delimiter}|\r?\n|\Z)')
    rows: list[list[str]] = [[]]
    for found in cell.finditer(text):
        bare, end = found.groups()
        value = re.sub(r'"((?:[^"]|"")*)(?:"|\Z)', lambda m: m[1].replace('""', '"'), bare) if '"' in bare else bare
        rows[-1].append(value.strip())
        if not end:
            break
        if end != delimiter:
            rows.append([])
    return [r for r in rows if any(r)]


def csv(data: bytes, info: dict) -> tuple[str, str | None]:
    rows = csv_rows(decoded(data), "\t" if info.get("extension") == ".tsv" else ",")
    if not rows:
        return "", None
    # Rows longer than the head keep their cells.
    width = len(rows[0])
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]]), None


def fenced(language: str, text: str) -> str:
    return f"```{language}\n{text}\n```"


def as_json(data: bytes, info: dict) -> tuple[str, str | None]:
    value = json.loads(decoded(data), parse_int=lambda s: int(s) if -(1 << 63) <= int(s) < 1 << 64 else float(s))
    return fenced("json", json.dumps(value, indent=2, ensure_ascii=False)), None


def yaml(data: bytes, info: dict) -> tuple[str, str | None]:
    return fenced("yaml", decoded(data)), None


def xml(data: bytes, info: dict) -> tuple[str, str | None]:
    return fenced((info.get("extension") or ".xml").lstrip("."), decoded(data)), None


def plain(data: bytes, info: dict) -> tuple[str, str | None]:
    text, kind = decoded(data), (info.get("extension") or "").lstrip(".")
    return (text if kind in ("", "md", "markdown", "txt", "log", "rst") else fenced(kind, text)), None


def html(data: bytes, info: dict) -> tuple[str, str | None]:
    text = decoded(data)
    return html_to_markdown(normalized_tables(strip_blocks(text))), title_of(text)


def _text(value) -> str:
    return "".join(map(str, value)) if isinstance(value, list) else value if isinstance(value, str) else ""


def ipynb(data: bytes, info: dict) -> tuple[str, str | None]:
    book = json.loads(data.decode("utf-8"))
    meta = book.get("metadata") or {} if isinstance(book, dict) else {}
    language = (meta.get("kernelspec") or {}).get("language") or (meta.get("language_info") or {}).get("name") or "python"
    sections, title = [], None
    for cell in (book.get("cells") or [] if isinstance(book, dict) else []):
        kind, source = cell.get("cell_type"), _text(cell.get("source"))
        if kind == "markdown":
            heads = (x[2:].strip() for x in source.split("\n") if x.startswith("# "))
            title = title or next((h for h in heads if h), None)
            sections.append(source)
        elif kind == "raw":
            sections.append(fenced("", source))
        elif kind == "code":
            sections.append(fenced(language, source))
            shown = [x for out in cell.get("outputs") or [] if (x := _output(out))]
            if shown:
                sections.append(fenced("", "\n".join(shown)))
    if isinstance(meta.get("title"), str):
        title = meta["title"]
    return "\n\n".join(sections).strip(), title


def _output(out: dict) -> str:
    kind = out.get("output_type")
    if kind == "stream":
        return _text(out.get("text")).strip()
    if kind in ("execute_result", "display_data"):
        return _text((out.get("data") or {}).get("text/plain")).strip()
    if kind == "error" and "\n".join(x if isinstance(x, str) else "" for x in out.get("traceback") or []).strip():
        return f"Error: {out.get('ename', '')}: {out.get('evalue', '')}"
    return ""


# ---------------------------------------------------------------- feeds

CDATA = re.compile(r"(?s)<!\[CDATA\[(.*?)\]\]>")
MARKUP = re.compile(r"(?s)<!\[CDATA\[.*?\]\]>|<!--.*?-->|<[?!][^>]*>|<(/?)([A-Za-z_][\w:.-]*)([^>]*)>")


class Outline:
    """Elements of a tagged text in order, as (name, from, to) of what they hold; what is left open ends with what holds it."""

    def __init__(self, text: str):
        self.text, self.names = text, []
        self.spans: list[list[int]] = []
        open_: list[int] = []
        for found in MARKUP.finditer(text):
            closing, name, rest = found.groups()
            if name is None:
                continue
            name = name.lower()
            if not closing:
                self.names.append(name)
                self.spans.append([found.end(), found.end() if rest.endswith("/") else len(text)])
                if not rest.endswith("/"):
                    open_.append(len(self.names) - 1)
            elif any(self.names[k] == name for k in open_):
                while True:
                    k = open_.pop()
                    self.spans[k][1] = found.start()
                    if self.names[k] == name:
                        break

    def every(self, name: str, within: tuple[int, int] | None = None) -> list[tuple[int, int]]:
        low, high = within or (0, len(self.text))
        return [(a, b) for n, (a, b) in zip(self.names, self.spans) if n == name and low <= a and b <= high]

    def first(self, name: str, within: tuple[int, int] | None = None) -> str | None:
        """What the first element of a name holds, None where there is none or it is blank."""
        for a, b in self.every(name, within)[:1]:
            return CDATA.sub(r"\1", self.text[a:b]).strip() or None
        return None


def _body(text: str) -> str:
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = text.replace(entity, sign)
    return html_to_markdown(text) if "<" in text else text.strip()


@dataclass(frozen=True)
class Dialect:
    """What a kind of feed calls its parts, and how the facts of an entry are told."""

    about: str
    entry: str
    facts: tuple[tuple[str, str], ...]
    bodies: tuple[str, ...]
    #: Whether what the feed says of itself is HTML.
    html: bool


RSS = Dialect("description", "item", (("pubdate", "Published: {}"), ("link", "[Link]({})")), ("content:encoded", "description"), True)
ATOM = Dialect("subtitle", "entry", (("updated", "Updated: {}"),), ("content", "summary"), False)


def feed(data: bytes, info: dict) -> tuple[str, str | None]:
    marked = Outline(data.decode("utf-8"))
    dialect = RSS if "rss" in marked.names else ATOM if "feed" in marked.names else None
    if dialect is None:
        raise ValueError("Not an RSS or Atom feed")
    home = next(iter(marked.every("channel")), None) if dialect is RSS else None
    title, about = marked.first("title", home), marked.first(dialect.about, home)
    sections = [f"# {title}" if title else "", (_body(about) if dialect.html else about) if about else ""]
    for place in marked.every(dialect.entry):
        head = marked.first("title", place)
        told = [f"## {head}"] if head else []
        told += [form.format(value) for name, form in dialect.facts if (value := marked.first(name, place))]
        bodies = [b for name in dialect.bodies if (b := marked.first(name, place))]
        sections.append("\n".join(told + [_body(b) for b in bodies[:1]]))
    return "\n\n".join(filter(None, sections)).strip(), title


# ---------------------------------------------------------------- encyclopedia pages

# Elements of an article that are not its text, as (element, class).
ASIDE = (("div", "mw-editsection"), ("sup", "reference"), ("div", "navbox"), ("table", "sidebar"))
ARTICLE, HEADING, SITE = "mw-content-text", "mw-page-title-main", " - Wikipedia"


def wikipedia(data: bytes, info: dict) -> tuple[str, str | None]:
    """The article of an encyclopedia's page, found in its tree by id and class."""
    root = parse(strip_blocks(decoded(data)))
    nodes = [n for n in root.walk() if n.name is not None]
    named = next((n for n in nodes if n.name == "span" and HEADING in n.attrs.get("class", "").split()), None) or next((n for n in nodes if n.name == "title"), None)
    title = named.content().strip().removesuffix(SITE).strip() or None if named else None
    main = next((n for n in nodes if n.attrs.get("id") == ARTICLE), root)
    for node in nodes:
        if any(node.name == name and mark in node.attrs.get("class", "") for name, mark in ASIDE) and node.parent is not None:
            node.remove()
    if main is not root:
        # The article stands by itself, so that what surrounds it lends it no white space.
        top = Node("#root")
        for child in main.children:
            top.add(child)
        main = top
    body = tree_to_markdown(main)
    return (f"# {title}\n\n{body}" if title else body), title
