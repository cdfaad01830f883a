"""A forgiving HTML tree builder over the standard library's tokenizer.

It covers what decides the text of real pages: implied end tags, void elements,
formatting that outlives its block, misnested formatting, tables without
sections, and raw text elements.
"""

from __future__ import annotations

from html.parser import HTMLParser

VOID = frozenset("area base br col command embed hr img input keygen link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside audio blockquote body canvas center dd dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html isindex li main menu nav noframes noscript ol output p pre section table tbody td tfoot th thead tr ul video".split()
)
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
#: A start tag closes an open element of these, up to the named border.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    **dict.fromkeys(("thead", "tbody", "tfoot"), ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"})),
}
PARTS = frozenset("caption col colgroup tbody td tfoot th thead tr".split())
ENDS_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "noscript", "audio", "video", "canvas", "output"}


class Node:
    """An element or, with ``name`` None, a piece of text."""

    __slots__ = ("name", "attrs", "children", "parent", "text", "place", "filled", "lead", "trail", "edges", "output")

    def __init__(self, name: str | None, attrs: dict[str, str] | None = None, text: str = ""):
        self.name, self.attrs, self.text = name, attrs or {}, text
        self.children: list[Node] = []
        self.parent: Node | None = None
        #: What a renderer keeps at the node.
        self.output = None

    def add(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children.remove(self)
            self.parent = None

    def content(self) -> str:
        """All text below the node."""
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if node.name is None:
                out.append(node.text)
            stack.extend(reversed(node.children))
        return "".join(out)

    def walk(self):
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))


class Builder(HTMLParser):
    """Feeds a tree; ``root`` is its top."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]
        self.active: list[Node] = []

    @property
    def top(self) -> Node:
        return self.open[-1]

    def within(self, name: str, border: frozenset[str] | set[str] = frozenset(("table", "td", "th"))) -> int:
        """Place of the innermost open ``name`` above any border, or -1."""
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name == name:
                return k
            if self.open[k].name in border:
                return -1
        return -1

    def close_to(self, k: int) -> None:
        del self.open[k:]

    def reopen(self) -> None:
        """Formatting elements that are still in force open again."""
        for i, old in enumerate(self.active):
            if old not in self.open:
                new = self.top.add(Node(old.name, dict(old.attrs)))
                self.open.append(new)
                self.active[i] = new

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        values = {}
        for k, v in attrs:
            values.setdefault(k, v or "")
        if tag in ("html", "head", "body") and any(n.name == tag for n in self.open):
            return
        # Parts of tables mean nothing outside of one.
        if tag in PARTS and not any(n.name == "table" for n in self.open):
            return
        if tag in CLOSES:
            names, border = CLOSES[tag]
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].name in border:
                    break
                if self.open[k].name in names:
                    self.close_to(k)
                    if tag in ("td", "th", "li", "dt", "dd", "option"):
                        break
        if tag in ENDS_P and (k := self.within("p", {"table", "td", "th", "button", "caption"})) > 0:
            self.close_to(k)
        if tag[0] == "h" and tag[1:].isdigit() and self.top.name and self.top.name[0] == "h" and self.top.name[1:].isdigit():
            self.open.pop()
        if tag == "tr" and self.top.name == "table":
            self.open.append(self.top.add(Node("tbody")))
        if tag in ("td", "th") and self.top.name in ("table", "tbody", "thead", "tfoot"):
            if self.top.name == "table":
                self.open.append(self.top.add(Node("tbody")))
            self.open.append(self.top.add(Node("tr")))
        if tag == "a" and (old := next((n for n in reversed(self.active) if n.name == "a"), None)):
            self.end_formatting("a")
            if old in self.active:
                self.active.remove(old)
        if tag not in BLOCK or tag in FORMATTING:
            if self.top.name not in ("table", "tbody", "thead", "tfoot", "tr"):
                self.reopen()
        node = self.top.add(Node(tag, values))
        if tag not in VOID:
            self.open.append(node)
            if tag in FORMATTING:
                # Of formatting that is the same, three stay in force.
                same = [n for n in self.active if n.name == tag and n.attrs == values]
                if len(same) >= 3:
                    self.active.remove(same[0])
                self.active.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            if tag == "br":
                self.handle_starttag("br", [])
            return
        if tag in FORMATTING:
            self.end_formatting(tag)
            return
        if tag == "p" and self.within("p") < 0:
            self.handle_starttag("p", [])
        border = {"table"} if tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else {"td", "th"} if tag != "table" else set()
        if tag[0] == "h" and tag[1:].isdigit():
            k = next((k for k in range(len(self.open) - 1, 0, -1) if self.open[k].name and self.open[k].name[0] == "h" and self.open[k].name[1:].isdigit()), -1)
        else:
            k = self.within(tag, border)
        if k > 0:
            self.close_to(k)
            if tag in ("td", "th", "table", "caption"):
                self.active = [n for n in self.active if n in self.open]

    def end_formatting(self, tag: str) -> None:
        node = next((n for n in reversed(self.active) if n.name == tag), None)
        if node is None:
            k = self.within(tag)
            if k > 0:
                self.close_to(k)
            return
        self.active.remove(node)
        if node not in self.open:
            return
        k = self.open.index(node)
        block = next((j for j in range(k + 1, len(self.open)) if self.open[j].name in BLOCK), None)
        if block is None:
            self.close_to(k)
            return
        # The block outlives the formatting: it moves out, and what it holds keeps the formatting.
        outer = self.open[block]
        inner = Node(node.name, dict(node.attrs))
        for child in list(outer.children):
            child.remove()
            inner.add(child)
        if inner.children:
            outer.add(inner)
        outer.remove()
        home = node.parent
        home.children.insert(home.children.index(node) + 1, outer)
        outer.parent = home
        self.open = [n for i, n in enumerate(self.open) if i < k or i >= block]

    def handle_data(self, data: str) -> None:
        top = self.top
        if top.name in ("table", "tbody", "thead", "tfoot", "tr"):
            if data.isspace():
                return
            # Text astray in a table stands before it.
            table = next(n for n in reversed(self.open) if n.name == "table")
            home = table.parent or self.root
            stray = Node(None, text=data)
            stray.parent = home
            home.children.insert(home.children.index(table), stray)
            return
        if top.name not in ("script", "style", "title", "textarea"):
            self.reopen()
        top = self.top
        if top.children and top.children[-1].name is None:
            top.children[-1].text += data
        else:
            top.add(Node(None, text=data))

    def handle_comment(self, data: str) -> None:
        pass


def parse(html: str) -> Node:
    """The tree of a document or fragment."""
    builder = Builder()
    builder.feed(html)
    builder.close()
    return builder.root
