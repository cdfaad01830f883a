"""Problem 1: the main body of a page, apart from what its site puts around it.

Minimum-cut labelling. A classifier of lines gives each a cost for being kept and
one for being dropped, the terminal capacities of a network; neighbouring lines
and lines that the page's structure ties together (a list, a list and its title,
siblings) are joined by smoothness edges. The maximum flow's cut parts content
from boilerplate.

The classifier is fitted on a bounded sample of pages whose lines label
themselves: what recurs on a site is furniture, sentences that do not are text.
It knows words only from there, so it serves any language and vocabulary.
"""

from __future__ import annotations

import re
import string
import zlib
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.sites import Memo, host, key_of, line_key, recurring, skeleton, slices
from folioforge.runtime import cut

LINK = re.compile(r"!?\[([^\]]*)\]\(([^)\s]*)\)")
HEAD, ITEM, TABLE = re.compile(r"^#{1,6}\s"), re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+"), re.compile(r"^\s*\|.*\|\s*$")
#: Signs of a skeleton, which is ASCII, stand between its words; a star stands for letters beyond ASCII, and any figure for all.
BETWEEN = bytes(48 if chr(c).isdigit() else 32 if chr(c) in string.punctuation and c != 42 else c for c in range(256))
ENDS = ".!?…”»\"'"

#: Hashed features of a line: the table of weights has two to the power of this.
BITS = 15
#: The sample that the classifier is fitted on: so many hosts, pages of each and lines of each, drawn by hash.
HOSTS, PAGES, LINES = 30, 50, 600
#: Pages with different texts that a host of the sample needs, and pages on which a line stands that recurs on it.
LEAST_PAGES, LEAST = 5, 3
#: Words of lines in which pairs of neighbours count beside single words.
PAIRED = 12
#: Weight of words beside shapes, and of lines that may be either beside those whose label is sure.
WORDS, UNSURE = 2.0, 0.1
#: Added to every line's log-odds: lines that never recur are furniture too, and the sample knows them as text only.
BIAS = 1.0
#: Bounds of a line's evidence, what recurring on the host adds, and what a title that heads links to its site adds.
MOST, RECURS, TITLE = 6.0, 2.0, 1.5
#: What the entries of a list below such a title say for themselves at most, and entries without links from which a list behind a gap is another one.
ENTRIES, OWN = 0.6, 4
#: Ties: of lines of one kind in one block, of others in it, across blank lines, of a list, of a title and its list, of siblings one run apart.
SAME_KIND, SAME_BLOCK, NEXT_BLOCK, SAME_LIST, TITLED, SIBLING = 2.5, 1.0, 0.3, 3.0, 24.0, 0.5
#: Evidence of each line from which furniture ends a block as surely as a blank line does.
CLEAR = 3.0


def site_names(host_: str | None) -> tuple[str, ...]:
    """What a site may call itself: the host and the label before its ending."""
    if not host_:
        return ()
    parts = host_.lower().split(".")
    return tuple(dict.fromkeys([host_.lower(), parts[-2] if len(parts) > 1 else parts[0]]))


def slot(feature: str | bytes) -> int:
    return zlib.crc32(feature if isinstance(feature, bytes) else feature.encode()) & ((1 << BITS) - 1)


SLOTS = Memo(slot)
#: A site's names, and the parts of names with hyphens that could stand alone.
OWN_WORDS = Memo(lambda names: frozenset(w.encode() for w in [*names, *(x for n in names for x in n.split("-") if len(n) > 3)]))


def step(n: float, edges: tuple) -> int:
    return bisect_right(edges, n)


def shaped(form: tuple) -> tuple[str, ...]:
    """Features of (look, words, last sign, capital, separators)."""
    look, n, end, capital, sep = form
    return f"k={look}", f"n={step(n, (1, 2, 3, 4, 6, 8, 12, 18, 26, 40))}", f"kn={look}{step(n, (2, 4, 8, 14, 26))}", f"e={end}{n >= 4}", f"c={capital}", f"sep={sep}"


SHAPES = Memo(shaped)


@dataclass(slots=True)
class Line:
    """What one line is by itself."""

    kind: str
    shapes: tuple[str, ...]
    words: set[bytes]
    #: Whether it links to its own site, and whether it reads as a sentence.
    inside: bool
    sentence: bool
    #: Its key among the lines of its site.
    key: int


def seen(line: str, names: tuple[str, ...]) -> Line:
    """Kind and features of a non-blank line. Every word counts, whatever the line's length."""
    s = line.strip()
    links = LINK.findall(s) if "](" in s else ()
    plain = LINK.sub(r"\1", LINK.sub(r"\1", s)) if links else s
    bones = skeleton(plain)
    key = line_key(line) if links else key_of(bones)
    words = bones.encode().translate(BETWEEN).split()
    if names and not (own := OWN_WORDS[names]).isdisjoint(words):
        words = [b"<site>" if w in own else w for w in words]
    n = len(words)
    spaced = s.count(" ") >= 7 and len(s.split()) >= 8
    if s[0] == "|" and TABLE.match(s):
        kind = "table"
    elif s[0] == "#" and HEAD.match(s):
        kind = "head"
    elif (s[0] in "-*+•" or s[0].isdigit()) and ITEM.match(s):
        kind = "item"
    elif links and sum(len(t) for t, _ in links) >= 0.6 * len(plain) - 6:
        kind = "links"
    else:
        kind = "prose" if spaced else "plain"
    look = f"h{min(3, s.index(' '))}" if kind == "head" else "b" if s.startswith("**") else "p" if kind in ("prose", "plain", "links") else kind
    sep = min(3, bones.count("|") + bones.count("/") + bones.count(">")) if n < 40 else 0
    shapes = SHAPES[look, n, "a" if s[-1].isalnum() else s[-1], s[0].isupper(), sep]
    inside = False
    if links:
        more = {f"ld={step(sum(len(t) for t, _ in links) / max(1, len(plain)), (0.3, 0.6, 0.9))}": None}
        for _, target in links:
            own_ = target[:1] in ("/", "#") or any(x in target for x in names)
            inside |= own_
            more[f"u={'#' if target[:1] == '#' else 'in' if own_ else 'out'}{look}"] = None
        shapes += tuple(more)
    else:
        shapes += ("nolink",)
    told = {*words}
    if len(words) <= PAIRED:
        told.update(a + b" " + b for a, b in zip(words, words[1:]))
    return Line(kind, shapes, told, inside, spaced and s[-1] in ENDS and not links and kind == "prose", key)


def places(lines: list[str], at: list[int], mine: list[Line]) -> list[tuple[int, int, int]]:
    """Features of where each of the non-blank lines ``at`` stands: counted from the nearer end, between which gaps, and on which side of heading and text."""
    n, blank = len(at), [not x or x.isspace() for x in lines]
    where = [step(q, (1, 2, 4, 8, 14)) if q < n - q else 10 + step(n - 1 - q, (1, 2, 4, 8, 14)) for q in range(n)]
    text = [q for q, x in enumerate(mine) if x.sentence or x.kind == "head"]
    first, last = (text[0], max([q for q in text if mine[q].sentence], default=n)) if text else (0, n)
    side = ["above" if q < first else "below" if q > last else "in" for q in range(n)]
    return [(SLOTS[f"pos={w}"], SLOTS[f"gap={int(k == 0 or blank[k - 1])}{int(k + 1 >= len(lines) or blank[k + 1])}"], SLOTS[f"side={z}{x.kind}"]) for w, k, z, x in zip(where, at, side, mine)]


#: Lines whose value a task remembers.
KEPT, NOTHING = 10_000, frozenset()


@dataclass
class Classifier:
    """Log-odds that a line is furniture, linear in hashed features; without a fit it knows shapes that all sites share."""

    weights: np.ndarray = field(default_factory=lambda: prior())
    start: float = -BIAS

    def __post_init__(self):
        self.known = Memo(lambda feature: float(self.weights[slot(feature)]))
        self.shape = Memo(lambda shapes: sum(map(self.known.__getitem__, shapes)))
        self.place = self.weights.tolist()
        self.memo: dict = {}

    def __reduce__(self):
        return Classifier, (self.weights, self.start)

    def line(self, line: str, names: tuple[str, ...]) -> tuple[Line, float]:
        """The line and its log-odds but for its place; kept for the next page that has it, but for sentences, which few have."""
        got = self.memo.get((line, names))
        if got is None:
            x = seen(line, names)
            v = self.shape[x.shapes]
            if x.words:
                v += WORDS / len(x.words) ** 0.5 * sum(map(self.known.__getitem__, x.words))
            # What the value was made of is not kept.
            x.shapes, x.words = (), NOTHING
            got = x, v
            if not x.sentence:
                if len(self.memo) >= KEPT:
                    self.memo.clear()
                self.memo[line, names] = got
        return got

    def odds(self, shapes: list[int], words: list[int]) -> float:
        w = self.weights
        return self.start + float(w[shapes].sum()) + (WORDS / len(words) ** 0.5 * float(w[words].sum()) if words else 0.0)

    def fit(self, rows: list[tuple[list[int], list[int], float, float]], steps: int = 80, rate: float = 0.1, shrink: float = 1e-4) -> Classifier:
        """Logistic regression on (shapes, words, label, weight), drawn towards the weights it starts from."""
        if not rows or len({r[2] for r in rows}) < 2:
            return self
        size = 1 << BITS
        row = np.repeat(np.arange(len(rows)), [len(r[0]) + len(r[1]) for r in rows])
        col = np.array([i for r in rows for part in r[:2] for i in part], np.int64)
        val = np.array([v for r in rows for v in [1.0] * len(r[0]) + [WORDS / max(1, len(r[1])) ** 0.5] * len(r[1])])
        y, weight = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
        w, b = self.weights.copy(), 0.0
        m, v = np.zeros(size + 1), np.zeros(size + 1)
        for t in range(1, steps + 1):
            p = 1 / (1 + np.exp(-(np.bincount(row, val * w[col], len(rows)) + b)))
            e = (p - y) * weight
            g = np.append(np.bincount(col, val * e[row], size) / weight.sum() + shrink * (w - self.weights), e.sum() / weight.sum())
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            w, b = w - move[:-1], b - move[-1]
        return Classifier(w, float(b))


def prior() -> np.ndarray:
    """Weights before any page is seen: links to the site itself speak for furniture, sentences, tables and first headings for text."""
    w = np.zeros(1 << BITS)
    for feature, value in {"k=h1": -3.0, "k=h2": -1.0, "k=table": -3.0, "u=inp": 2.0, "u=initem": 2.0, "u=#p": 3.0, "u=#item": 3.0, "u=outitem": -2.0, "u=outp": -1.0}.items():
        w[slot(feature)] = value
    for n in range(6, 11):
        w[slot(f"n={n}")] = -1.0 * (n - 5)
    return w


def labelled(texts: list[str], names: tuple[str, ...]) -> list[tuple[list[int], list[int], float, float]]:
    """(shapes, words, label, weight) of every line of one host's pages.

    Lines on LEAST pages are furniture. Between the first sentence and the last that
    do not recur lies the text: its lines are text but where they link to the
    site or stand beside furniture. All others may be either and weigh little;
    links to the site among them nothing.
    """
    count = Counter(k for text in texts for k in {line_key(x) for x in text.split("\n") if x and not x.isspace()})
    out = []
    for text in texts:
        lines = text.split("\n")
        at = [k for k, x in enumerate(lines) if x and not x.isspace()]
        mine = [seen(lines[k], names) for k in at]
        often = [count[x.key] >= LEAST for x in mine]
        core = [q for q, x in enumerate(mine) if x.sentence and not often[q]]
        low, high = (core[0], core[-1]) if core else (1, 0)
        while low > 0 and mine[low - 1].kind == "head":
            low -= 1
        for q, (x, place) in enumerate(zip(mine, places(lines, at, mine))):
            sure = low <= q <= high and not x.inside and (x.sentence or not any(often[max(0, q - 3) : q + 2]))
            weight = 1.0 if often[q] or sure else 0.0 if x.inside else UNSURE
            if weight:
                out.append(([slot(f) for f in x.shapes] + list(place), [slot(w) for w in x.words], float(often[q]), weight))
    return out


def minimum_cut(keep: list[float], drop: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes fall to the sink's side: the labelling of least total cost.

    ``keep[i]`` is paid where node i is kept, ``drop[i]`` where it is dropped, an
    edge's weight where its ends differ. Shortest augmenting paths; of several least
    cuts the one that drops fewest.
    """
    n = len(keep)
    caps: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        caps[a][b] = caps[a].get(b, 0.0) + w
        caps[b][a] = caps[b].get(a, 0.0) + w
    # The part that both terminals share flows straight through.
    excess = [d - k for k, d in zip(keep, drop)]
    while True:
        # From every node the source still feeds to the nearest that the sink still drains.
        back: dict[int, int] = {i: -1 for i in range(n) if excess[i] > 1e-9}
        queue = list(back)
        end = -1
        for u in queue:
            for v, c in caps[u].items():
                if c > 1e-9 and v not in back:
                    back[v] = u
                    if excess[v] < -1e-9:
                        end = v
                        break
                    queue.append(v)
            if end >= 0:
                break
        if end < 0:
            return [i not in back and (keep[i] > drop[i] or _drained(i, caps, excess)) for i in range(n)]
        path, v = [], end
        while back[v] >= 0:
            path.append((back[v], v))
            v = back[v]
        flow = min(excess[v], -excess[end], *(caps[a][b] for a, b in path))
        for a, b in path:
            caps[a][b] -= flow
            caps[b][a] += flow
        excess[v] -= flow
        excess[end] += flow


def _drained(start: int, caps: list[dict[int, float]], excess: list[float]) -> bool:
    """Whether a node that the source no longer reaches can still reach the sink."""
    seen, queue = {start}, [start]
    for u in queue:
        if excess[u] < -1e-9:
            return True
        for v, c in caps[u].items():
            if c > 1e-9 and v not in seen:
                seen.add(v)
                queue.append(v)
    return False


def furniture(text: str, host_: str | None = None, often: frozenset[int] = frozenset(), model: Classifier | None = None) -> list[int]:
    """Numbers of the non-blank lines of ``text`` that are not main body.

    Lines are what stands between line feeds and count from 0. ``often`` holds the
    keys of lines that recur on the host, which speak for furniture whatever they
    say. A page has a main body: where the cut leaves nothing but headings, the
    neighbouring lines with the least evidence stay. A blank text has no lines.
    """
    return sorted(parted(text.split("\n"), host_, often, model or Classifier())[0])


def parted(lines: list[str], host_: str | None, often: frozenset[int], model: Classifier) -> tuple[set[int], set[int]]:
    """Numbers of the lines that are furniture, and of those that recur on the host."""
    names = site_names(host_)
    at = [k for k, x in enumerate(lines) if x and not x.isspace()]
    judged = [model.line(lines[k], names) for k in at]
    found, fenced, weights = [], False, model.place
    for k, (x, v), place in zip(at, judged, places(lines, at, [x for x, _ in judged])):
        v += weights[place[0]] + weights[place[1]] + weights[place[2]] + model.start + BIAS
        fence = lines[k].lstrip().startswith("```")
        fenced ^= fence
        found.append((k, "code", -MOST, False, False) if fence or fenced else (k, x.kind, v, x.inside, x.key in often))
    gone = _cut(lines, found)
    if gone and all(f[1] == "head" for f in found if f[0] not in gone):
        gone -= _body(found, gone)
    return gone, {k for k, (x, _) in zip(at, judged) if x.key in often} if often else set()


def _body(found: list[tuple], gone: set[int]) -> set[int]:
    """The neighbouring lines of text or of one list of least evidence, those that do not recur and stand below a heading first; none where there are no such lines."""
    groups: list[list[tuple]] = [[]]
    for f in found:
        if f[1] in ("plain", "prose", "item", "table") and not f[3]:
            last = groups[-1][-1] if groups[-1] else None
            if last and last[1] != "head" and (last[4], last[1] == "item") != (f[4], f[1] == "item"):
                groups.append([])
            groups[-1].append(f)
        elif f[0] in gone or f[1] != "head":
            groups.append([])
        elif groups[-1]:
            groups.append([(*f[:1], "head")])
        else:
            groups[-1].append((*f[:1], "head"))
    best = min(((any(f[1] != "head" and f[4] for f in g), not any(f[1] == "head" for f in g), sum(f[2] for f in g if f[1] != "head") / sum(f[1] != "head" for f in g), g[0][0], g) for g in groups if any(f[1] not in ("head", "item") for f in g) or sum(f[1] == "item" for f in g) >= OWN), default=None)
    return {f[0] for f in best[4]} if best else set()


def _cut(lines: list[str], found: list[tuple]) -> set[int]:
    """The dropped ones of (line, kind, log-odds, links to the site, recurs) for all non-blank lines."""
    runs: list[list] = []  # kind, lines, evidence, first of its block, lines that link to the site
    before = -2
    for q, (k, kind, v, inside, often) in enumerate(found):
        v = max(-MOST, min(MOST, v))
        if often:
            v = max(v, RECURS) + RECURS
        gap, before = k - before > 1, k
        titles = kind == "head" or kind == "plain" and (lines[k].startswith("**") or q + 1 < len(found) and found[q + 1][1] in ("item", "links"))
        if runs and runs[-1][0] == kind and (runs[-1][2] > 0) == (v > 0) and not gap and not titles:
            runs[-1][1].append(k)
            runs[-1][2] += v
            runs[-1][4] += inside
        else:
            runs.append([kind, [k], v, gap, int(inside)])
    under = _titled(lines, runs)
    if not any(r[2] > 0 for r in runs):
        return set()
    edges = []
    for i in range(1, len(runs)):
        a, b = runs[i - 1], runs[i]
        lists = b[0] in ("item", "links")
        if under[i]:
            weight = SAME_LIST * 4 if under[i - 1] else TITLED
        elif lists and (a[0] in ("item", "links") and not b[3] or a[0] == "head"):
            weight = SAME_LIST
        elif b[3]:
            weight = NEXT_BLOCK
        elif (a[2] > 0) != (b[2] > 0) and max(a[2] / len(a[1]), b[2] / len(b[1])) > CLEAR:
            weight = NEXT_BLOCK
        else:
            weight = SAME_KIND if a[0] == b[0] else SAME_BLOCK
        edges.append((i - 1, i, weight))
        if i > 1 and not b[3] and not a[3] and runs[i - 2][0] == b[0]:
            edges.append((i - 2, i, SIBLING))
    dropped = minimum_cut([max(r[2], 0.0) for r in runs], [max(-r[2], 0.0) for r in runs], edges)
    return {k for r, d in zip(runs, dropped) if d for k in r[1]}


def _titled(lines: list[str], runs: list[list]) -> list[bool]:
    """Which runs are lists below a title of furniture; their entries say little for themselves, and a title of links to the site says more."""
    under, i = [False] * len(runs), 0
    while i < len(runs):
        j = i
        # A longer list without a link to the site is one of its own.
        while j < len(runs) and runs[j][0] in ("item", "links") and not (j > i and runs[j][3] and len(runs[j][1]) >= OWN and not runs[j][4]):
            j += 1
        if j > i and i and runs[i - 1][0] in ("head", "plain") and not lines[runs[i - 1][1][-1]].startswith("# "):
            title, size, inside = runs[i - 1], sum(len(r[1]) for r in runs[i:j]), sum(r[4] for r in runs[i:j])
            if 4 * inside >= size:
                title[2] += TITLE
            if title[2] > 0 and (4 * inside >= size or not runs[i][3] or title[0] == "head"):
                for q in range(i, j):
                    under[q] = True
                    runs[q][2] = max(runs[q][2], -ENTRIES)
        i = max(j, i + 1)
    return under


@dataclass
class Pages:
    """Converted records with what their sites repeat, and the classifier fitted on a sample of them."""

    rows: DataFrame
    model: Classifier
    #: The texts as they were read, for what needs neither their order nor their sites.
    texts: DataFrame

    def where(self, condition) -> Pages:
        return Pages(self.rows.where(condition), self.model, self.texts)


def pages(documents: DataFrame, sources: DataFrame) -> Pages:
    """``doc_id, markdown, host, web, recurring``: each distinct text of a converted record once (of repeats the first row).

    ``web`` says whether a URL is known, ``host`` is its host, and ``recurring`` the
    keys of the lines that recur on that host. A record's list is looked up beside
    its small row, so that the texts are shuffled once, by record and never by host:
    a host may hold any share of them.
    """
    text = F.xxhash64("markdown")
    rows = documents.where(F.col("markdown").rlike(r"\S")).select("doc_id", "markdown", "converted_at", text.alias("text"))
    first = rows.groupBy("doc_id", "text").agg(F.min(F.struct(F.col("converted_at").isNull().alias("none"), "converted_at")).alias("first"))
    urls = sources.groupBy("doc_id").agg(F.min("url").alias("url"))
    known = cut(first.join(urls, "doc_id", "left").select(F.col("doc_id").alias("id"), F.col("text").alias("mark"), F.col("first.converted_at").alias("first"), host("url").alias("host"), F.col("url").isNotNull().alias("web")))
    on = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text") == F.col("mark")) & F.col("converted_at").eqNullSafe(F.col("first"))
    # Of a host's copies of one text, the small rows choose the one that is counted.
    single = known.where("host is not null").groupBy("host", "mark").agg(F.min(F.struct("id", "first")).alias("one")).select("host", "mark", "one.*")
    sizes = single.groupBy("host").agg(F.count("*").alias("pages"))
    often = recurring(rows.join(single, on).select("host", "markdown", "text"), sizes)
    met = rows.join(known.join(often, "host", "left"), on).select("doc_id", "markdown", "host", "web", "recurring")
    return Pages(met, fitted(rows, single), rows)


def fitted(rows: DataFrame, single: DataFrame) -> Classifier:
    """The classifier, from at most HOSTS hosts, PAGES pages of each and LINES lines of each, drawn by hash.

    The small rows choose the pages, which the texts then meet by a broadcast of at
    most HOSTS times PAGES rows.
    """
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.xxhash64("id", "mark"), "id", "mark"))
    # Pages of a hash class first, so that no window holds all pages of a host.
    size = single.groupBy("host").agg(F.count("*").alias("size")).where(F.col("size") >= LEAST_PAGES)
    chosen = size.orderBy(F.xxhash64("host"), "host").limit(HOSTS)
    share = F.pmod(F.xxhash64("mark", "id"), F.lit(1_000_003)) < F.lit(1_000_003.0) * 4 * PAGES / F.col("size")
    drawn = single.join(F.broadcast(chosen), "host").where(share).withColumn("k", rank).where(F.col("k") <= PAGES).select("id", "mark", "first", F.col("host").alias("site"))
    on = (F.col("doc_id") == F.col("id")) & (F.col("text") == F.col("mark")) & F.col("converted_at").eqNullSafe(F.col("first"))

    def learn(batch: pa.Table) -> pa.Table:
        site = batch.column("site")[0].as_py()
        out = labelled(sorted(set(batch.column("markdown").to_pylist())), site_names(site))
        if len(out) > LINES:
            order = np.random.default_rng(len(out)).permutation(len(out))[:LINES]
            out = [out[i] for i in sorted(order.tolist())]
        return pa.table({"shapes": pa.array([r[0] for r in out], pa.list_(pa.int32())), "words": pa.array([r[1] for r in out], pa.list_(pa.int32())), "label": pa.array([r[2] for r in out], pa.float64()), "weight": pa.array([r[3] for r in out], pa.float64())})

    got = rows.join(F.broadcast(drawn), on).select("site", "markdown").groupBy("site").applyInArrow(learn, "shapes array<int>, words array<int>, label double, weight double")
    lines = sorted((list(r.shapes), sorted(r.words), r.label, r.weight) for r in got.collect())
    # Lines that look like furniture but did not recur in the sample are no examples of text.
    first = Classifier().fit(lines)
    return Classifier().fit([r for r in lines if r[2] or first.odds(r[0], r[1]) < 0])


def boilerplate_lines(found: Pages) -> DataFrame:
    """``doc_id, line_no`` of every non-blank line outside the main body of each page.

    ``found`` as :func:`pages` gives it. Null and blank texts have no lines;
    repeated rows count once; a page without a host is judged by its lines alone.
    """
    sent = found.rows.sparkSession.sparkContext.broadcast(found.model)

    def run(batches):
        model = sent.value
        for batch in slices(batches):
            at, no = [], []
            for k, (text, host_, keys) in enumerate(zip(batch.column("markdown").to_pylist(), batch.column("host").to_pylist(), batch.column("recurring").to_pylist())):
                gone = furniture(text, host_, frozenset(keys or ()), model)
                at += [k] * len(gone)
                no += gone
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(no, pa.int32())], names=["doc_id", "line_no"])

    return found.rows.select("doc_id", "markdown", "host", "recurring").mapInArrow(run, "doc_id string, line_no int")


def bodies(found: Pages) -> DataFrame:
    """``doc_id, body``: the main body of each page alone, without the blank lines that what is gone leaves at its ends.

    Null and blank texts have no row; a record without a URL is its own body.
    """
    sent = found.rows.sparkSession.sparkContext.broadcast(found.model)

    def run(batches):
        model = sent.value
        for batch in slices(batches):
            out = []
            for text, host_, web, keys in zip(*(batch.column(c).to_pylist() for c in ("markdown", "host", "web", "recurring"))):
                lines = text.split("\n")
                gone = parted(lines, host_, frozenset(keys or ()), model)[0] if web else set()
                # Of blank lines in a row, where furniture stood between them, one stays.
                kept = [x for k, x in enumerate(lines) if k not in gone]
                out.append("\n".join(x for k, x in enumerate(kept) if not gone or x.strip() or (k and kept[k - 1].strip())).strip("\n") if gone else text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "body"])

    return found.rows.select("doc_id", "markdown", "host", "web", "recurring").mapInArrow(run, "doc_id string, body string")
