"""Text items of PDF pages to Markdown: words, running heads, columns, tables, headings, paragraphs."""

from __future__ import annotations

import re
import unicodedata

#: Points: items of one line, boxes of one line, least gap between columns, largest gap inside a table row.
SAME_LINE, LINE_BAND, GUTTER, TABULAR = 2.0, 3.0, 18.0, 30.0
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st"}
FULLWIDTH = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}
SENTENCE_END = re.compile(r"[.!?:;。！？]['\"”’)\]]*$")


#: Spacing accents that PDF files set over a letter, and their combining forms.
OVERLAID = {"´": "\u0301", "`": "\u0300", "ˆ": "\u0302", "˜": "\u0303", "¨": "\u0308", "˚": "\u030a", "¸": "\u0327", "ˇ": "\u030c", "¯": "\u0304", "˘": "\u0306"}
PRESENTED = re.compile("[\ufb1d-\ufdff\ufe70-\ufefc]")
LEFT_TO_RIGHT = re.compile(r"[A-Za-z0-9][A-Za-z0-9.,:/%+-]*(?: +[A-Za-z0-9][A-Za-z0-9.,:/%+-]*)*")


def clean(text: str) -> str:
    """Ligatures, full-width forms and overlaid accents brought to plain text, lines of right-to-left glyphs to reading order."""
    if text.isascii():
        return text
    for a, b in LIGATURES.items():
        text = text.replace(a, b)
    text = text.translate(FULLWIDTH)
    for a, b in OVERLAID.items():
        if a in text:
            # An accent stands before or after its letter, whichever takes it.
            text = re.sub(rf"{re.escape(a)}([A-Za-zı])", lambda m, b=b: unicodedata.normalize("NFC", m.group(1).replace("ı", "i") + b), text)
    return right_to_left(unicodedata.normalize("NFC", text))


def right_to_left(text: str) -> str:
    """Text set in presentation forms, from the order of the eye to that of reading; words and figures from the left keep theirs."""
    if not PRESENTED.search(text):
        return text
    turned = unicodedata.normalize("NFKC", text[::-1])
    return LEFT_TO_RIGHT.sub(lambda m: m.group(0)[::-1], turned)


# Signs of formulas in LaTeX.
LATEX = {
    "∑": "\\sum", "∫": "\\int", "∏": "\\prod", "√": "\\sqrt", "∞": "\\infty", "∂": "\\partial", "∇": "\\nabla", "≤": "\\leq", "≥": "\\geq", "≠": "\\neq", "≈": "\\approx", "≡": "\\equiv", "∈": "\\in",
    "∉": "\\notin", "⊂": "\\subset", "⊆": "\\subseteq", "∪": "\\cup", "∩": "\\cap", "∀": "\\forall", "∃": "\\exists", "→": "\\to", "⇒": "\\Rightarrow", "×": "\\times", "·": "\\cdot", "±": "\\pm", "−": "-",
    "α": "\\alpha", "β": "\\beta", "γ": "\\gamma", "δ": "\\delta", "ε": "\\epsilon", "θ": "\\theta", "λ": "\\lambda", "μ": "\\mu", "π": "\\pi", "ρ": "\\rho", "σ": "\\sigma", "τ": "\\tau", "φ": "\\phi", "ψ": "\\psi",
    "ω": "\\omega", "Γ": "\\Gamma", "Δ": "\\Delta", "Θ": "\\Theta", "Λ": "\\Lambda", "Σ": "\\Sigma", "Φ": "\\Phi", "Ψ": "\\Psi", "Ω": "\\Omega",
}
STRONG = frozenset("∑∫∏√∞∂∇≤≥≠≈≡∈∉⊂⊆∪∩∀∃⇒")
SCRIPT = re.compile("\ue000(.*?)\ue001|\ue002(.*?)\ue003")
WEAK = re.compile(r"^(?:[A-Za-z]|[0-9.,]+|[-+=<>/()|^*!,;:\[\]{}−×·±→]+|[A-Za-z0-9()+-]*\ue000.*?\ue001[A-Za-z0-9()+=-]*|[A-Za-z0-9()+-]*\ue002.*?\ue003[A-Za-z0-9()+=-]*)$")


def with_formulas(text: str) -> str:
    """Runs of formula signs as LaTeX between dollars.

    A run is made of single letters, figures and signs; it needs two signs that
    only formulas have, or one and a raised or lowered part. Other raised and
    lowered parts lose their marks.
    """
    out, run = [], []

    def close() -> None:
        joined = " ".join(run)
        strong = sum(c in STRONG for c in joined)
        greek = sum(c in LATEX and c not in STRONG for c in joined)
        if strong >= 2 or strong + greek >= 2 and len(run) >= 3 or SCRIPT.search(joined) and strong + greek >= 1:
            inner = SCRIPT.sub(lambda m: f"^{{{m.group(1)}}}" if m.group(1) is not None else f"_{{{m.group(2)}}}", joined)
            for sign, command in LATEX.items():
                inner = re.sub(re.escape(sign) + r"(?=[A-Za-z])", lambda m, c=command: c + " ", inner).replace(sign, command)
            out.append(f"${inner}$")
        else:
            out.extend(run)
        run.clear()

    for token in text.split(" "):
        if token and (WEAK.match(token) or any(c in LATEX for c in token) and len(token) <= 12):
            run.append(token)
        else:
            close()
            out.append(token)
    close()
    return SCRIPT.sub(lambda m: m.group(1) if m.group(1) is not None else m.group(2), " ".join(out))


def escaped(text: str) -> str:
    """Text that Markdown shows as it is; citations by number stay."""
    if "$" in text:
        # Formulas stay as they are.
        parts = re.split(r"(\$[^$]+\$)", text)
        if len(parts) > 1:
            return "".join(p if k % 2 else escaped(p) for k, p in enumerate(parts))
    text = re.sub(r"([\\`*_<>&])", r"\\\1", text)
    text = re.sub(r"\[(?!\d+(?:[,;–-]\s*\d+)*\])([^\]]*)\]", r"\\[\1\\]", text)
    return re.sub(r"^(\s*)(#{1,6}\s|[-+]\s|\d+\.\s)", lambda m: m.group(1) + ("\\" + m.group(2) if not m.group(2)[0].isdigit() else m.group(2).replace(".", "\\.")), text)


def boxes_of(items: list[dict]) -> list[dict]:
    """Items merged into boxes: one line, gaps below a cap that follows the type size, spaces where gaps show."""
    rows: list[list[dict]] = []
    for item in sorted(items, key=lambda i: (-i["y"], i["x"])):
        near = max(SAME_LINE, 0.45 * rows[-1][0]["size"] if rows and item["size"] < 0.8 * rows[-1][0]["size"] else 0)
        if rows and abs(rows[-1][0]["y"] - item["y"]) <= near:
            rows[-1].append(item)
        else:
            rows.append([item])
    out = []
    for row in rows:
        row.sort(key=lambda i: i["x"])
        limit = space_limit(row)
        for item in row:
            box = out[-1] if out and out[-1]["row"] is row else None
            cap = min(max(0.6 * item["size"], 6.0), 14.0)
            gap = item["x"] - box["right"] if box else None
            if box is None or gap > cap or gap < -2 * item["size"]:
                out.append({"row": row, "text": item["text"], "left": item["x"], "right": item["x"] + item["width"], "bottom": item["y"], "top": item["y"] + item["size"], "font": item["size"], "size": item["size"], "bold": item["bold"]})
                continue
            text_ = item["text"]
            base = box["size"]
            if 0.3 * base < item["size"] < 0.8 * base and text_.strip() and abs(item["y"] - box["bottom"]) > 0.08 * base:
                # Raised and lowered parts carry marks until the line is whole.
                text_ = ("\ue000" + text_ + "\ue001") if item["y"] > box["bottom"] else ("\ue002" + text_ + "\ue003")
            glue = " " if gap > (limit if limit is not None else 0.18 * item["size"]) and not box["text"].endswith(" ") and not item["text"].startswith(" ") else ""
            box["text"] = (box["text"] + glue + text_).replace("\ue001\ue000", "").replace("\ue003\ue002", "")
            box["right"] = max(box["right"], item["x"] + item["width"])
            box["top"], box["font"] = max(box["top"], item["y"] + item["size"]), max(box["font"], item["size"])
            box["bold"] = box["bold"] and item["bold"]
    for box in out:
        del box["row"], box["size"]
        box["text"] = with_formulas(clean(re.sub(r"\s+", " ", box["text"]).strip()))
    return [b for b in out if b["text"]]


def space_limit(row: list[dict]) -> float | None:
    """For lines set letter by letter: the middle of the widest jump among the gaps."""
    if len(row) < 12 or sum(len(i["text"]) == 1 for i in row) < 0.9 * len(row):
        return None
    gaps = sorted(b["x"] - a["x"] - a["width"] for a, b in zip(row, row[1:]))
    jumps = [(b - a, a, b) for a, b in zip(gaps, gaps[1:])]
    jump, low, high = max(jumps, default=(0, 0, 0))
    return (low + high) / 2 if jump > 0.5 else None


#: Private signs around raised and lowered parts of a line.
SCRIPTS = "\ue000\ue001\ue002\ue003"
#: Signs of decoration around a line.
ORNAMENT = r"[\s\p{Z}|•·▪–—\-_=~*]+"
# What only furniture of a page says, in lower case.
LINKED = r"https?://|^www\.| www\.|doi:|doi\.org/"
BANNER = r"please cite this article|contents lists available at|available online at|downloaded from|©|copyright |all rights reserved"
FOLIO = r"^page [0-9]|^[0-9]{1,4}$"
ROMAN = r"^m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$"
VOLUME = r"(?:^|[^a-z0-9])(?:vol(?:ume)?[., ].*[0-9]|[vn]\. ?[0-9])"
YEAR = r"(?:^|[^a-z0-9])(?:19|20)[0-9]{2}(?:$|[^a-z0-9])"
RANGE, DATE_RANGE = r"[0-9]+ *[-–—] *[0-9]+", r"^(?:19|20)[0-9]{2} *[-–—] *[0-9]{1,2}$"
CITED = r"[0-9]:[0-9]"
AFTER_YEAR = r"\((?:19|20)[0-9]{2}\)\.? *[0-9]+, *[0-9]+"
DATE_LINE = r"^[0-9]{1,2}\.? +\p{L}+\.? +(?:19|20)[0-9]{2}\.?$|^\p{L}+ +[0-9]{1,2}, +(?:19|20)[0-9]{2}\.?$"


def chrome_line(text: str) -> bool:
    """Whether a line is worded as a page's furniture; the same rule as functions.text.is_chrome."""
    blank = ORNAMENT.replace(r"\p{Z}", "")
    plain = re.sub(f"^{blank}|{blank}$", "", text.translate(dict.fromkeys(map(ord, SCRIPTS))))
    low, size = plain.lower(), len(plain.encode())
    if not plain:
        return False
    if re.search(f"{LINKED}|{BANNER}|{FOLIO}|{VOLUME}", low) or 2 <= size <= 7 and re.search(ROMAN, low) or size <= 80 and "et al" in low:
        return True
    ranges = any(not re.search(DATE_RANGE, r) for r in re.findall(RANGE, plain))
    if size <= 120 and (re.search(YEAR, low) and (ranges or re.search(CITED, plain)) or re.search(AFTER_YEAR, plain)):
        return True
    return size <= 30 and bool(re.search(DATE_LINE.replace(r"\p{L}", r"[^\W\d_]"), plain))


def folio(text: str) -> bool:
    plain = text.strip()
    return bool(re.fullmatch("[0-9]{1,4}", plain)) or 1 <= len(plain.encode()) <= 7 and bool(re.search(ROMAN, plain.lower()))


def line_tops(tops: list[float], step: float = 3.0) -> list[float]:
    """The tops of the lines that boxes with these tops make, from above."""
    out: list[float] = []
    for t in sorted(tops, reverse=True):
        if not out or out[-1] - t > step:
            out.append(t)
    return out


def page_furniture(boxes: list[dict], height: float, band: float = 0.15, edge: float = 0.1) -> set[int]:
    """Places in ``boxes`` of one page's furniture, by place, distance and wording (see operators.layout.page_chrome)."""
    gone: set[int] = set()
    if height <= 0:
        return gone
    sizes = sorted(b["font"] for b in boxes if b["font"] > 0)
    need = sizes[len(sizes) // 2] if sizes else 10.0
    lines = len(line_tops([b["top"] for b in boxes]))
    for side in ("top", "bottom"):
        inside = [k for k, b in enumerate(boxes) if b["text"].strip() and (b["bottom"] >= height * (1 - band) if side == "top" else b["top"] <= height * band and not b["bottom"] >= height * (1 - band))]
        inside.sort(key=lambda k: (-boxes[k]["top"], boxes[k]["left"], k))
        groups: list[list[int]] = []
        for k in inside:
            if groups and boxes[groups[-1][-1]]["bottom"] - boxes[k]["top"] <= need:
                groups[-1].append(k)
            else:
                groups.append([k])
        for group in groups:
            tops = line_tops([boxes[k]["top"] for k in group])
            hits = sum(any(chrome_line(boxes[k]["text"]) and t - 3.0 <= boxes[k]["top"] <= t for k in group) for t in tops)
            if not hits or len(tops) > 4 and 2 * hits < len(tops) or 2 * len(tops) > lines or any(len(boxes[k]["text"].strip().encode()) > 200 for k in group):
                continue
            low, high = min(boxes[k]["bottom"] for k in group), max(boxes[k]["top"] for k in group)
            rest = [b for k, b in enumerate(boxes) if k not in group]
            away = [low - b["top"] for b in rest if b["top"] < low] if side == "top" else [b["bottom"] - high for b in rest if b["bottom"] > high]
            if min(away, default=need) >= need:
                gone |= {*group}
    if len(boxes) > 2:
        for side in ("bottom", "top"):
            left = [k for k in range(len(boxes)) if k not in gone]
            if left:
                k = min(left, key=lambda k: (boxes[k]["bottom"] if side == "bottom" else -boxes[k]["top"], k))
                if folio(boxes[k]["text"]) and (boxes[k]["bottom"] <= height * edge if side == "bottom" else boxes[k]["top"] >= height * (1 - edge)):
                    gone.add(k)
    return gone


def without_page_furniture(pages: list[dict]) -> None:
    for page in pages:
        gone = page_furniture(page["boxes"], page["page_height"])
        page["boxes"] = [b for k, b in enumerate(page["boxes"]) if k not in gone]


def without_running_heads(pages: list[dict]) -> None:
    """Texts of the outer 12 % that stand on a fifth of the pages, or on eight in a row, leave all pages."""
    if len(pages) < 5:
        return
    seen: dict[str, list[int]] = {}
    far = lambda p: 0.12 * p["page_height"]
    margin = lambda p, b: not far(p) < (b["top"] + b["bottom"]) / 2 < p["page_height"] - far(p)
    for k, page in enumerate(pages):
        for text in {b["text"] for b in page["boxes"] if margin(page, b)}:
            seen.setdefault(text, []).append(k)
    gone = set()
    for text, at in seen.items():
        run = best = 1
        for a, b in zip(at, at[1:]):
            run = run + 1 if b == a + 1 else 1
            best = max(best, run)
        if len(at) >= max(3, len(pages) // 5) or best >= 8:
            gone.add(text)
    for page in pages:
        page["boxes"] = [b for b in page["boxes"] if not (b["text"] in gone and margin(page, b))]


def columns(boxes: list[dict]) -> list[list[dict]]:
    """Groups in reading order: cut at empty bands across, then at gutters, again and again; every cut leaves smaller groups."""
    if len(boxes) < 6:
        return [boxes]
    spans = sorted((b["left"], b["right"]) for b in boxes)
    right, cuts = spans[0][1], []
    for a, b in spans[1:]:
        if a - right >= GUTTER:
            cuts.append((right + a) / 2)
        right = max(right, b)
    for cut in cuts:
        sides = [b for b in boxes if b["right"] <= cut], [b for b in boxes if b["left"] >= cut]
        # Columns of text hold lines of words on both sides, tables short cells.
        if all(len(s) >= 4 and sum(len(b["text"].split()) >= 3 for b in s) >= 0.6 * len(s) for s in sides):
            return columns(sides[0]) + columns(sides[1])
    lines = sorted(boxes, key=lambda b: -b["top"])
    height = sorted(b["top"] - b["bottom"] for b in boxes)[len(boxes) // 2]
    low = lines[0]["bottom"]
    for k, b in enumerate(lines[1:], 1):
        if low - b["top"] >= max(2.5 * height, 18.0):
            upper, lower = columns(lines[:k]), columns(lines[k:])
            return upper + lower if len(upper) + len(lower) > 2 else [boxes]
        low = min(low, b["bottom"])
    return [boxes]


#: Least height of a ruled table, and least spread of left edges of one with level rules only.
LEAST_HEIGHT, LEAST_SPREAD = 24.0, 50.0


def ruled_tables(boxes: list[dict], rules: list[tuple]) -> tuple[list[tuple[float, list[list[str]]]], list[dict]]:
    """Tables framed by ruling lines, as (top, rows), and the boxes that no table takes."""
    flat = [r for r in rules if r[3] - r[1] <= 3 and r[2] - r[0] > 8]
    tall = [r for r in rules if r[2] - r[0] <= 3 and r[3] - r[1] > 4]
    found, rest = [], boxes
    islands: list[list[float]] = []
    for x1, _, x2, _ in sorted(flat):
        if islands and x1 <= islands[-1][1] + 10:
            islands[-1][1] = max(islands[-1][1], x2)
        else:
            islands.append([x1, x2])
    for left, right in islands:
        ys = merged([(r[1] + r[3]) / 2 for r in flat if left - 1 <= r[0] and r[2] <= right + 1])
        xs = merged([(r[0] + r[2]) / 2 for r in tall if left - 3 <= r[0] <= right + 3])
        if len(xs) < 2 and len(ys) >= 2 and ys[-1] - ys[0] >= LEAST_HEIGHT:
            grid, used = level_table(rest, ys, left, right)
            if grid and not is_prose(grid, len(ys) - 1):
                found.append((ys[-1], pruned(grid)))
                rest = [b for b in rest if id(b) not in used]
            continue
        if len(ys) < 3 or len(xs) < 3 or len(xs) > 26:
            continue
        cells: dict[tuple[int, int], list[dict]] = {}
        for b, of in split_boxes(rest, xs):
            x, y = (b["left"] + b["right"]) / 2, (b["top"] + b["bottom"]) / 2
            if xs[0] - 2 <= x <= xs[-1] + 2 and ys[0] - 2 <= y <= ys[-1] + 2:
                cells.setdefault((sum(v > y for v in ys[:-1]), sum(v < x for v in xs[1:])), []).append(b | {"of": id(of)})
        rows, width = len(ys) - 1, len(xs) - 1
        if len(cells) < max(2, 0.25 * rows * width):
            continue
        grid = [[cell_text(cells.get((r, c), [])) for c in range(width)] for r in range(rows)]
        if is_prose(grid, len(flat)):
            continue
        used = {b["of"] for c in cells.values() for b in c}
        found.append((ys[-1], pruned(grid)))
        rest = [b for b in rest if id(b) not in used]
    return found, rest


def apportioned(text: str, widths: list[float]) -> list[str]:
    """The words of a text over columns, each taking what its share of the width holds, one word at least; the last takes what is left."""
    words, out, units = text.split(), [], lambda t: len(t.encode("utf-16-le")) // 2
    for k, width in enumerate(widths):
        if k == len(widths) - 1:
            out.append(" ".join(words))
            break
        room, n, used = int(width / sum(widths) * units(text) + 0.5), 0, 0
        while n < len(words) and (n == 0 or used + 1 + units(words[n]) <= room):
            used += units(words[n]) + (n > 0)
            n += 1
        out.append(" ".join(words[:n]))
        words = words[n:]
    return out


def split_boxes(boxes: list[dict], xs: list[float], margin: float = 5.0) -> list[tuple[dict, dict]]:
    """Boxes of several words that reach over borders at ``xs`` as one for each column, each with the box it is of."""
    inside = lambda x: next((c for c, (a, z) in enumerate(zip(xs, xs[1:])) if a <= x <= z), None)
    out = []
    for b in boxes:
        first, last = inside(b["left"] + margin), inside(b["right"] - margin)
        if first is None or last is None or first >= last or len(b["text"].split()) < 2:
            out.append((b, b))
            continue
        borders = [b["left"], *xs[first + 1 : last + 1], b["right"]]
        parts = apportioned(b["text"], [z - a for a, z in zip(borders, borders[1:])])
        out += [({**b, "text": t, "left": a, "right": z}, b) for t, a, z in zip(parts, borders, borders[1:]) if t]
    return out


def cell_text(boxes: list[dict], step: float = 5.0) -> str:
    """The text of a cell: boxes of one height beside each other, others on lines of their own."""
    lines: list[list[dict]] = []
    for b in sorted(boxes, key=lambda b: (-b["top"], b["left"])):
        if lines and lines[-1][0]["top"] - b["top"] <= step:
            lines[-1].append(b)
        else:
            lines.append([b])
    return "<br>".join(" ".join(b["text"] for b in sorted(x, key=lambda b: b["left"])) for x in lines)


def level_table(boxes: list[dict], ys: list[float], left: float, right: float, near: float = 30.0, gap: float = 20.0, band: float = 8.0) -> tuple[list[list[str]], set[int]]:
    """The rows of a table that has level rules only, and the boxes it takes (see operators.tables.level_tables)."""
    at = lambda b: ((b["left"] + b["right"]) / 2, (b["top"] + b["bottom"]) / 2)
    held = [b for b in boxes if b["left"] >= left - near and b["right"] <= right + near and ys[0] <= at(b)[1] <= ys[-1]]
    last = ys[0]
    for b in sorted((b for b in boxes if left <= at(b)[0] <= right and at(b)[1] < ys[0]), key=lambda b: -at(b)[1]):
        if last - at(b)[1] > near:
            break
        held.append(b)
        last = at(b)[1]
    if not held or max(b["left"] for b in held) - min(b["left"] for b in held) < LEAST_SPREAD:
        return [], set()
    centres = sorted(at(b)[0] for b in held)
    borders = [(a + z) / 2 for a, z in zip(centres, centres[1:]) if z - a >= gap]
    rows: list[tuple[float, list[dict]]] = []
    for b in sorted(held, key=lambda b: (-at(b)[1], b["left"])):
        if rows and rows[-1][0] - at(b)[1] <= band:
            rows[-1][1].append(b)
        else:
            rows.append((at(b)[1], [b]))
    grid, used = [], set()
    for _, row in rows:
        cells: list[list[dict]] = [[] for _ in range(len(borders) + 1)]
        for b in row:
            if left <= at(b)[0] <= right:
                cells[sum(x < at(b)[0] for x in borders)].append(b)
                used.add(id(b))
        grid.append([" ".join(b["text"] for b in sorted(c, key=lambda b: b["left"])) for c in cells])
    return grid, used


def is_prose(rows: list[list[str]], rules: int) -> bool:
    """Whether a ruled area holds running text: far more rows than rules part, and most of them sentences."""
    texts = [" ".join(c for c in r if c) for r in rows]
    said = sum(len(t.split()) >= 5 and sum(map(str.isalpha, t)) >= 25 for t in texts)
    return bool(rules) and len(rows) > 3 * rules and said >= 4 and 5 * said >= 3 * len(rows)


def pruned(rows: list[list[str]]) -> list[list[str]]:
    """A grid without its empty rows and columns, in order."""
    keep = [c for c in range(max(map(len, rows), default=0)) if any(c < len(r) and r[c] for r in rows)]
    return [[r[c] if c < len(r) else "" for c in keep] for r in rows if any(r)]


def html_table(rows: list[list[tuple[str, int, int]]]) -> str:
    """An HTML table of (text, rows, columns) cells, for grids that Markdown can't show."""
    safe = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("\n", "<br>")
    span = lambda r, c: (f' rowspan="{r}"' if r > 1 else "") + (f' colspan="{c}"' if c > 1 else "")
    return "<table>\n" + "\n".join("<tr>" + "".join(f"<td{span(r, c)}>{safe(t)}</td>" for t, r, c in row) + "</tr>" for row in rows) + "\n</table>"


def merged(values: list[float], near: float = 2.0) -> list[float]:
    out: list[float] = []
    for v in sorted(values):
        if not out or v - out[-1] > near:
            out.append(v)
    return out


def lines_of(boxes: list[dict]) -> list[list[dict]]:
    out: list[list[dict]] = []
    for b in sorted(boxes, key=lambda b: (-b["bottom"], b["left"])):
        if out and abs(out[-1][0]["bottom"] - b["bottom"]) <= LINE_BAND:
            out[-1].append(b)
        else:
            out.append([b])
    return [sorted(x, key=lambda b: b["left"]) for x in out]


def bare_tables(lines: list[list[dict]]) -> list[tuple[int, int, list[list[str]]]]:
    """Runs of at least three lines whose boxes share columns, as (first, end, rows)."""
    out, k = [], 0
    while k < len(lines):
        end = k
        while end < len(lines) and len(lines[end]) >= 2 and any(b["left"] - a["right"] > TABULAR / 2 for a, b in zip(lines[end], lines[end][1:])):
            end += 1
        if end - k >= 3:
            stops = merged([b["left"] for x in lines[k:end] for b in x], 12.0)
            grid = []
            for x in lines[k:end]:
                row = [""] * len(stops)
                for b in x:
                    c = max(i for i, s in enumerate(stops) if s <= b["left"] + 12.0)
                    row[c] = (row[c] + " " + b["text"]).strip()
                grid.append(row)
            if sum(bool(c) for r in grid for c in r) >= 0.55 * len(grid) * len(stops):
                out.append((k, end, grid))
        k = max(end, k + 1)
    return out


def modal_size(boxes: list[dict]) -> float:
    """The commonest type size, to a tenth, of at least 7 where there is one; of equals the first seen."""
    counts: dict[float, int] = {}
    for b in boxes:
        size = round(b["font"], 1)
        if size > 0:
            counts[size] = counts.get(size, 0) + 1
    return max((s for s in counts if s >= 7), key=counts.get, default=None) or max(counts, key=counts.get, default=0.1)


def heading_mark(size: float, bold: bool, body: float) -> str:
    ratio = size / body
    return "# " if ratio >= 2 else "## " if ratio >= 1.4 else "### " if ratio >= 1.1 and bold else ""


def joined(a: str, b: str) -> str:
    """Two lines of one paragraph; a hyphen goes where the next line begins in lower case, except in compounds."""
    if a.endswith("-") and b[:1].islower() and not re.search(r"\w-\w+-$", a):
        return a[:-1] + b
    return f"{a} {b}"


def table_text(rows: list[list[str]]) -> str:
    width = max(map(len, rows))
    cell = lambda c: c.replace("|", "\\|").replace("\n", "<br>")
    lines = ["| " + " | ".join(cell(c) for c in r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def render_group(boxes: list[dict], rules: list[tuple], body: float) -> list[tuple[float, str]]:
    """(top, block) of one column."""
    tables, rest = ruled_tables(boxes, rules)
    blocks = [(top, table_text(rows)) for top, rows in tables if rows]
    lines = lines_of(rest)
    bare = bare_tables(lines)
    for first, end, grid in bare:
        blocks.append((lines[first][0]["top"], table_text(grid)))
    taken = {k for first, end, _ in bare for k in range(first, end)}
    open_: list | None = None  # top, text, mark, bottom
    for k, line in enumerate(lines):
        if k in taken:
            open_ = None
            continue
        text, size = " ".join(b["text"] for b in line), max(b["font"] for b in line)
        mark = heading_mark(size, all(b["bold"] for b in line), body)
        top, bottom = max(b["top"] for b in line), min(b["bottom"] for b in line)
        gap = open_[3] - top if open_ else 0
        if open_ and mark == open_[2] and (mark and gap <= max(3 * body, 30.0) or not mark and gap <= body and len(open_[4]) > 25 and not (SENTENCE_END.search(open_[1]) and gap > 0.6 * body)):
            open_[1], open_[3], open_[4] = joined(open_[1], text), bottom, text
            continue
        if open_:
            blocks.append((open_[0], open_[2] + escaped(open_[1])))
        open_ = [top, text, mark, bottom, text]
        if k + 1 in taken:
            blocks.append((top, mark + escaped(text)))
            open_ = None
    if open_:
        blocks.append((open_[0], open_[2] + escaped(open_[1])))
    return sorted(blocks, key=lambda b: -b[0])


def render_pages(pages: list[dict]) -> str:
    """The Markdown of a document from its pages' items, rules and images."""
    for page in pages:
        page["boxes"] = boxes_of(page["items"])
    without_running_heads(pages)
    without_page_furniture(pages)
    out = []
    for page in pages:
        body, blocks = modal_size(page["boxes"]), []
        groups = columns(page["boxes"]) if page["boxes"] else []
        for group in groups:
            left, right = min(b["left"] for b in group) - 10, max(b["right"] for b in group) + 10
            mine = [r for r in page["rules"] if r[0] < right and r[2] > left] if len(groups) > 1 else page["rules"]
            blocks += render_group(group, mine, body)
        # A number of its own at the foot of the page is the page's.
        for k in range(len(blocks) - 1, max(-1, len(blocks) - 4), -1):
            if blocks[k][0] <= 120 and blocks[k][1].strip("—- ") == str(page["page_number"]):
                del blocks[k]
                break
        texts = [t for _, t in blocks]
        shown = [i for i in page["images"] if int(i[2] - i[0]) * int(i[3] - i[1]) >= 5000]
        texts += [f"<!-- image: p{page['page_number']}-i{k} (page {page['page_number']}, {round(i[2] - i[0])}x{round(i[3] - i[1])}pt) -->" for k, i in enumerate(shown)]
        if texts:
            out.append("\n\n".join(texts))
    return dehyphenated("\n\n".join(out)).strip()


def dehyphenated(text: str) -> str:
    """Words broken over blocks joined; a word with another hyphen keeps this one (see functions.text.dehyphenated)."""
    done, *parts = text.split("-\n\n")
    for part in parts:
        if not (done[-1:].isalpha() and part[:1].islower()):
            done += "-\n\n" + part
        else:
            done += ("-" if re.search(r"-\S*$", done) else "") + part
    return done
