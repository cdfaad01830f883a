"""HTML to Markdown, and Markdown tables."""

from __future__ import annotations

import re

from folioforge.formats.dom import BLOCK, VOID, Node, parse

#: Elements that mean something even without text.
FULL_WHEN_EMPTY = frozenset("a table thead tbody tfoot th td iframe script audio video".split())
SKIPPED = frozenset(("script", "style"))
SPACES = re.compile(r"[ \r\n\t]+")
ESCAPES = (
    (re.compile(r"\\"), r"\\\\"),
    (re.compile(r"\*"), r"\\*"),
    (re.compile(r"^-"), r"\\-"),
    (re.compile(r"^\+ "), r"\\+ "),
    (re.compile(r"^(=+)"), r"\\\1"),
    (re.compile(r"^(#{1,6}) "), r"\\\1 "),
    (re.compile(r"`"), r"\\`"),
    (re.compile(r"^~~~"), r"\\~~~"),
    (re.compile(r"\["), r"\\["),
    (re.compile(r"\]"), r"\\]"),
    (re.compile(r"^>"), r"\\>"),
    (re.compile(r"_"), r"\\_"),
    (re.compile(r"^(\d+)\. "), r"\1\\. "),
)
RULES = {"left": ":--", "right": "--:", "center": ":-:"}


def escape(text: str) -> str:
    """``text`` so that Markdown shows it as it is."""
    for pattern, by in ESCAPES:
        text = pattern.sub(by, text)
    return text


def strip_blocks(html: str) -> str:
    """``html`` without its scripts and styles."""
    return re.sub(r"(?is)<style\b.*?</style>", "", re.sub(r"(?is)<script\b.*?</script>", "", html))


def title_of(html: str) -> str | None:
    found = re.search(r"(?is)<title[^>]*>(.*?)</title>", html)
    return found.group(1).strip() or None if found else None


def normalized_tables(html: str) -> str:
    """Cells without paragraphs, and a head for every table that opens without one."""

    def cell(m: re.Match) -> str:
        inner = re.sub(r"(?is)^\s*<p[^>]*>|</p>\s*$", "", m.group(2))
        return m.group(1) + re.sub(r"(?is)</p>\s*<p[^>]*>", " ", inner) + m.group(3)

    def head(m: re.Match) -> str:
        inside = m.group(2)
        if re.match(r"(?is)\s*(?:<caption.*?</caption>\s*)?<thead", inside):
            return m.group(0)
        row = re.search(r"(?is)<tr[^>]*>(.*?)</tr>", inside)
        if row is None:
            return m.group(0)
        cells = re.sub(r"(?is)<(/?)td\b", r"<\1th", row.group(1))
        return f"{m.group(1)}<thead><tr>{cells}</tr></thead>{inside[: row.start()]}{inside[row.end() :]}{m.group(3)}"

    html = re.sub(r"(?is)(<t[dh]\b[^>]*>)(.*?)(</t[dh]>)", cell, html)
    return re.sub(r"(?is)(<table\b[^>]*>)(.*?)(</table>)", head, html)


def html_to_markdown(html: str) -> str:
    """The Markdown of a document or fragment, in time that grows with its length, however deep it is nested."""
    html = re.sub(r"(?i)<(/?)noscript(\s[^>]*)?>", lambda m: f"<{m.group(1)}div{m.group(2) or ''}>", html)
    return tree_to_markdown(parse(html))


def tree_to_markdown(root: Node) -> str:
    """The Markdown of a tree, whose white space is collapsed on the way."""
    collapse(root)
    measure(root)
    return Renderer().render(root).strip(" \t\r\n")


def is_block(node: Node) -> bool:
    return node.name in BLOCK


def passes(root: Node):
    """(node, whether it is left) of a walk that meets every node before and, where it may have children, after them."""
    stack = [(root, False)]
    while stack:
        node, left = stack.pop()
        yield node, left
        if not left and node.name is not None:
            stack.append((node, True))
            stack.extend((c, False) for c in reversed(node.children))


def collapse(root: Node) -> None:
    """Runs of white space become one space, none at the edges of blocks; preformatted text stays."""
    last: Node | None = None
    keep = False
    skip: Node | None = None
    thin: list[Node] = []

    def trim() -> None:
        if last is not None and last.text.endswith(" "):
            last.text = last.text[:-1]
            if not last.text:
                thin.append(last)

    for node, left in passes(root):
        if skip is not None:
            if node is skip and left:
                skip = None
            continue
        if node.name is None:
            text = SPACES.sub(" ", node.text)
            if (last is None or last.text.endswith(" ")) and not keep and text.startswith(" "):
                text = text[1:]
            node.text = text
            if text:
                last, keep = node, False
            else:
                thin.append(node)
        elif node.name in SKIPPED or node.name == "pre":
            skip = node
            if node.name == "pre":
                last, keep = None, True
        elif left:
            if is_block(node):
                trim()
                last, keep = None, False
        elif is_block(node) or node.name == "br":
            trim()
            last, keep = None, False
        elif node.name in VOID:
            # What stands inline keeps the space behind it.
            last, keep = None, True
    trim()
    for home in {id(n.parent): n.parent for n in thin if n.parent is not None}.values():
        home.children = [c for c in home.children if c.name is not None or c.text]


def measure(root: Node) -> None:
    """What rendering asks of every node, from the leaves up: its place, whether it shows anything, and the edges of its text."""
    for node, left in passes(root):
        if node.name is None:
            text = node.text
            bare = text.strip()
            node.filled = bool(bare)
            node.lead = text[: len(text) - len(text.lstrip(" \t\r\n"))]
            node.trail = text[len(text.rstrip(" \t\r\n")) :]
            # Of text that is only white space both edges are all of it.
            node.edges = (text[:1], text[-1:], not text.strip(" \t\r\n"), not bare)
        elif left:
            for k, c in enumerate(node.children):
                c.place = k
            node.filled = node.name in VOID or node.name in FULL_WHEN_EMPTY or any(c.filled for c in node.children)
            shown = [c for c in node.children if c.edges[0]]
            node.lead = node.trail = ""
            for c in shown:
                node.lead += c.lead
                if not c.edges[2]:
                    break
            for c in reversed(shown):
                node.trail = c.trail + node.trail
                if not c.edges[2]:
                    break
            node.edges = (shown[0].edges[0], shown[-1].edges[1], all(c.edges[2] for c in shown), all(c.edges[3] for c in shown)) if shown else ("", "", True, True)


class Pieces:
    """Text put together piece by piece, with as many line feeds between two as the longer of their edges has, two at most."""

    __slots__ = ("parts", "feeds")

    def __init__(self):
        self.parts: list[str] = []
        self.feeds = 0

    def add(self, piece: str) -> None:
        body = piece.lstrip("\n")
        between = min(2, max(self.feeds, len(piece) - len(body)))
        if not body:
            self.feeds = between
            return
        bare = body.rstrip("\n")
        self.parts += ("\n" * between, bare)
        self.feeds = len(body) - len(bare)

    def whole(self) -> str:
        return "".join(self.parts) + "\n" * self.feeds


class Renderer:
    """Renders a collapsed and measured tree."""

    def render(self, root: Node) -> str:
        code, open_, skip = 0, [Pieces()], None
        for node, left in passes(root):
            if skip is not None:
                if node is skip and left:
                    skip = None
                continue
            if node is root:
                continue
            if node.name is None:
                open_[-1].add(node.text if code else escape(node.text))
                continue
            if not left:
                if node.name in SKIPPED or not node.filled:
                    open_[-1].add("\n\n" if node.name not in SKIPPED and is_block(node) else "")
                    skip = node
                    continue
                code += node.name in ("code", "pre")
                open_.append(Pieces())
                continue
            code -= node.name in ("code", "pre")
            content = open_.pop().whole()
            open_[-1].add(self.one(node, content))
        return open_[0].whole()

    def one(self, node: Node, content: str) -> str:
        if node.name == "pre":
            return self.pre(node, content)
        if node.name == "code":
            return self.flanked(node, self.inline_code, content)
        rule = getattr(self, "on_" + node.name, None)
        if is_block(node) or node.name == "br":
            return rule(node, content) if rule else f"\n\n{content}\n\n"
        return self.flanked(node, rule or (lambda n, c: c), content)

    def flanked(self, node: Node, rule, content: str) -> str:
        """White space at the edges of an inline element moves outside of its marks."""
        before, after = node.lead, "" if node.edges[3] else node.trail
        if before or after:
            content = content.strip(" \t\r\n")
        home, k = node.parent.children, node.place
        if before and k and not is_block(home[k - 1]) and home[k - 1].edges[1] == " ":
            before = ""
        if after and k + 1 < len(home) and not is_block(home[k + 1]) and home[k + 1].edges[0] == " ":
            after = ""
        return before + rule(node, content) + after

    def inline_code(self, node: Node, content: str) -> str:
        text = re.sub(r"\r?\n|\r", " ", node.content())
        if not text:
            return ""
        mark = "`"
        runs = set(re.findall(r"`+", text))
        while mark in runs:
            mark += "`"
        extra = " " if re.search(r"^`|^ .*?[^ ].* $|`$", text) else ""
        return mark + extra + text + extra + mark

    def pre(self, node: Node, content: str) -> str:
        first = node.children[0] if node.children else None
        if first is None or first.name != "code":
            return f"\n\n{content}\n\n"
        language = re.search(r"language-(\S+)", first.attrs.get("class", ""))
        code = first.content()
        size = max([2, *(len(m) for m in re.findall(r"(?m)^`{3,}", code))]) + 1
        fence = "`" * size
        return f"\n\n{fence}{language.group(1) if language else ''}\n{code.removesuffix(chr(10))}\n{fence}\n\n"

    def on_p(self, node, content):
        return f"\n\n{content}\n\n"

    def on_br(self, node, content):
        return "  \n"

    def on_hr(self, node, content):
        return "\n\n* * *\n\n"

    def heading(self, node, content):
        return f"\n\n{'#' * int(node.name[1])} {content.strip(' ').replace(chr(92) + '.', '.')}\n\n"

    on_h1 = on_h2 = on_h3 = on_h4 = on_h5 = on_h6 = heading

    def strong(self, node, content):
        return f"**{content}**" if content.strip() else ""

    on_strong = on_b = strong

    def emphasis(self, node, content):
        return f"_{content}_" if content.strip() else ""

    on_em = on_i = emphasis

    def struck(self, node, content):
        return f"~~{content}~~" if content.strip() else ""

    on_del = on_s = on_strike = struck

    def on_a(self, node, content):
        href = node.attrs.get("href")
        if not href:
            return content
        return f"[{content}]({href.replace('(', chr(92) + '(').replace(')', chr(92) + ')')}{self.title(node)})"

    def on_img(self, node, content):
        source = node.attrs.get("src", "")
        alt = re.sub(r"(\n+\s*)+", "\n", node.attrs.get("alt", ""))
        return f"![{alt}]({source}{self.title(node)})" if source else ""

    @staticmethod
    def title(node):
        title = re.sub(r"(\n+\s*)+", "\n", node.attrs.get("title", "")).replace('"', '\\"')
        return f' "{title}"' if title else ""

    def on_blockquote(self, node, content):
        return "\n\n" + "\n".join("> " + x for x in content.strip("\n").split("\n")) + "\n\n"

    def listing(self, node, content):
        # The last element of an entry needs no blank line.
        if node.parent.name == "li" and all(c.name is None for c in node.parent.children[node.place + 1 :]):
            return "\n" + content
        return f"\n\n{content}\n\n"

    on_ul = on_ol = listing

    def on_li(self, node, content):
        home = node.parent
        mark = "- "
        if home.name == "ol":
            # Entries are numbered as they come.
            if home.output is None:
                start = home.attrs.get("start", "")
                first = int(start) if re.fullmatch(r"-?[0-9]+", start) else 1
                home.output = dict(zip((id(c) for c in home.children if c.name is not None), range(first, first + len(home.children))))
            mark = f"{home.output[id(node)]}. "
        content = re.sub(r"\n+$", "\n", content.lstrip("\n")).replace("\n", "\n  ")
        content = re.sub(r"\n[ ]+$", "\n", content)
        more = node.place + 1 < len(home.children)
        return mark + content + ("\n" if more and not content.endswith("\n") else "")

    # ------------------------------------------------------------ tables

    def cell(self, node, content):
        return ("| " if node.place == 0 else " ") + SPACES.sub(" ", content.strip()) + " |"

    on_td = on_th = cell

    def heading_row(self, row: Node) -> bool:
        home = row.parent
        if home.name == "thead":
            return True
        if home.children[0] is not row or not all(c.name == "th" for c in row.children if c.name):
            return False
        return home.name == "table" or home.name == "tbody" and home.parent.children[0] is home

    def on_tr(self, node, content):
        rule = ""
        if self.heading_row(node):
            for k, c in enumerate(x for x in node.children if x.name in ("td", "th")):
                rule += ("| " if k == 0 else " ") + RULES.get(c.attrs.get("align", "").lower(), "---") + " |"
        return "\n" + content + ("\n" + rule if rule else "")

    def section(self, node, content):
        return content

    on_thead = on_tbody = on_tfoot = section

    def on_table(self, node, content):
        row = next((n for n in node.walk() if n.name == "tr"), None)
        if row is None or not self.heading_row(row):
            return "\n\n" + source(node) + "\n\n"
        return "\n\n" + re.sub(r"\n{2,}", "\n", content).strip("\n") + "\n\n"


def source(root: Node) -> str:
    """The HTML of a tree."""
    out: list[str] = []
    for node, left in passes(root):
        if node.name is None:
            out.append(node.text.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace("<", "&lt;").replace(">", "&gt;"))
        elif left:
            if node.name not in VOID:
                out.append(f"</{node.name}>")
        else:
            attrs = "".join(f' {k}="{v.replace("&", "&amp;").replace(chr(160), "&nbsp;").replace(chr(34), "&quot;")}"' for k, v in node.attrs.items())
            out.append(f"<{node.name}{attrs}>")
    return "".join(out)


def table(rows: list[list[str]]) -> str:
    """A Markdown table whose first row is the head; short rows are padded to the widest."""
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])
