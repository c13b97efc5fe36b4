"""Operator 1: main text of web pages by gradient-boosted trees over DOM nodes and hierarchical decoding.

A page becomes a tree of its structural elements (block elements, and inline ones that carry a class, id or role). Each
node is described by its depth, its subtree (text, text density per node, links, punctuation, lists, form fields), its
siblings (number, place, share of the parent's text), and learned log-odds of its tag, attribute words and those of its
ancestors. Gradient-boosted trees give the probability that a node holds main text. Decoding maximises the sum of
log-probabilities over all labellings in which no node is kept below a dropped one: a tree dynamic programme, so an
ancestor's and a descendant's choices can't contradict each other.

The model is trained here, on generated pages (`html_pages`) with random words: only structure can be learned.

Null or empty html gives an empty text. Text outside any element belongs to the root, which is kept. Text in head,
script, style, template, noscript and comments is never text. White space inside a block becomes one space, blocks are
joined by one space; nothing else is dropped. Rows with null or repeated ids get a row each.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import prepare, read_table
from .html_pages import annotated
from .textcore import blocks

# Elements of the HTML standard by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe object svg canvas math title textarea head".split())
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
CLOSED_BY = {"p": BLOCKS - {"body", "html", "button"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot", "thead"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "option": frozenset(["option", "optgroup"]), "thead": frozenset(["tbody", "tfoot"]), "tbody": frozenset(["tbody", "tfoot"])}
#: An end never implied across these.
SCOPE = frozenset("table td th ul ol dl select article section div main nav aside footer header form body html blockquote figure".split())
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: The rest of an ordinary tag. It never looks beyond the next "<", so a page is read in time proportional to its size.
REST = re.compile(r"""[^<>"']*+(?:"[^<>"]*+"[^<>"']*+|'[^<>']*+'[^<>"']*+)*+>""")
SPECIAL = re.compile(r"""[>"']""")
#: Character references of more digits than any character has.
LONG_REF = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")
CLOSERS = frozenset().union(*CLOSED_BY.values())
NAMED = re.compile(r"""\b(class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
PUNCT = re.compile(r"[.,;:!?]")


@dataclass
class Page:
    """Nodes in document order; `end` is one past a node's last descendant. Segments are (node, text), None a break."""

    tag: list[str] = field(default_factory=lambda: ["#root"])
    words: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    end: list[int] = field(default_factory=lambda: [0])
    mark: list[bool] = field(default_factory=lambda: [True])
    segments: list[tuple[int, str] | None] = field(default_factory=list)
    chars: list[int] = field(default_factory=lambda: [0])
    linked: list[int] = field(default_factory=lambda: [0])
    punct: list[int] = field(default_factory=lambda: [0])


@lru_cache(20_000)
def attribute_words(attrs: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(w.lower() for m in NAMED.finditer(attrs) for w in WORD.findall(m[2] or m[3] or m[4] or "")))


def unescaped(piece: str) -> str:
    """Character references decoded; numbers beyond all characters become U+FFFD, as in the standard."""

    def short(m: re.Match) -> str:
        digits = m[0].strip("&#xX;").lstrip("0")
        return "\ufffd" if len(digits) > 7 else f"&#{'x' if m[0][2] in 'xX' else ''}{digits or '0'};"

    return html.unescape(LONG_REF.sub(short, piece) if "&#" in piece else piece) if "&" in piece else piece


class Scanner:
    """Finds tags. Every character is looked at a bounded number of times, however malformed the page."""

    def __init__(self, source: str):
        self.source = source
        self.dead: set[int] = set()  # quotes outside which, from there on, no tag ends
        self.headless = False

    def tag_end(self, pos: int) -> int:
        """Just after the tag whose name ends at pos: after the first ">" outside quotes, or else the first one at all;
        -1 without any."""
        m = REST.match(self.source, pos)
        if m:
            return m.end()
        at, seen = pos, []
        while m := SPECIAL.search(self.source, at):
            if m[0] == ">":
                return m.end()
            if m.start() in self.dead:
                break
            seen.append(m.start())
            close = self.source.find(m[0], m.end())
            if close < 0:
                break
            at = close + 1
        self.dead.update(seen)
        return self.source.find(">", pos) + 1 or -1

    def tags(self, pos: int) -> tuple[int, int, str, str, bool] | None:
        """The next (start, end, name or "" of what is no element, attributes, whether it is an end tag) from pos on."""
        source = self.source
        while (start := source.find("<", pos)) >= 0:
            if source.startswith("<!--", start):
                end = start + (5 if source.startswith(">", start + 4) else 6) if source.startswith((">", "->"), start + 4) else source.find("-->", start + 4) + 3
                return start, end if end > 2 else len(source), "", "", False
            m = NAME.match(source, start + 1)
            if m:
                end = self.tag_end(m.end())
                if end < 0:
                    return self.comment(start)
                return start, end, m[2].lower(), source[m.end() : end - 1], bool(m[1])
            if source[start + 1 : start + 2] in ("!", "?", "/"):
                end = source.find(">", start + 2) + 1
                if not end:
                    return self.comment(start)
                return start, end, "", "", False
            pos = start + 1
        return None

    def comment(self, pos: int) -> tuple[int, int, str, str, bool] | None:
        """Where no tag ends any more, a comment that is never closed may still begin."""
        start = self.source.find("<!--", pos)
        return (start, len(self.source), "", "", False) if start >= 0 else None

    def raw_end(self, tag: str, pos: int) -> int:
        """Where the content of an element without text ends; -1 for a head that isn't closed, which is read on."""
        if tag != "head":
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(self.source, pos)
            return stop.end() if stop else len(self.source)
        stop = None if self.headless else HEAD_END.search(self.source, pos)
        self.headless |= stop is None
        return stop.end() if stop else -1


HEAD_END = re.compile(r"</head\s*>|(?=<body\b)", re.I)
#: Cells and tables keep inline end tags inside from closing what is open outside.
FENCES = frozenset(["td", "th", "table"])
#: Open elements that a new one may close, or that stop the search for one.
MET = SCOPE | frozenset(CLOSED_BY)


def parse(source: str) -> Page:
    page, scan = Page(), Scanner(source)
    stack: list[tuple[str, int]] = [("#root", 0)]  # (tag, node of its text); inline elements share their parent's node
    # depths of the open elements by tag, of those that stop an inline end tag, and of those that a new element meets
    depths: dict[str, list[int]] = {}
    fences: list[int] = []
    meets: list[int] = []

    def text(piece: str) -> None:
        piece = unescaped(piece)
        node = stack[-1][1]
        page.segments.append((node, piece))
        n = len(piece) - piece.count(" ")
        page.chars[node] += n
        page.punct[node] += len(PUNCT.findall(piece))
        if depths.get("a"):
            page.linked[node] += n

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            tag, node = stack.pop()
            depths[tag].pop()
            if tag in FENCES:
                fences.pop()
            if tag in MET:
                meets.pop()
            if tag in BLOCKS:
                page.segments.append(None)
            if node != stack[-1][1]:
                page.end[node] = len(page.tag)

    pos = at = 0
    while found := scan.tags(pos):
        start, pos, tag, attrs, closes = found
        if start > at:
            text(source[at:start])
        at = pos
        if not tag:
            continue
        if closes:  # an end tag closes its element if that is open
            own = depths.get(tag)
            if own and (tag in BLOCKS or not fences or fences[-1] < own[-1]):
                pop_to(own[-1])
            continue
        if tag in RAW and not attrs.endswith("/"):
            stop = scan.raw_end(tag, pos)
            if stop >= 0:
                pos = at = stop
            continue
        if tag in BLOCKS:
            page.segments.append(None)
        elif tag == "br":
            page.segments.append((stack[-1][1], " "))
        if tag in VOID or attrs.endswith("/"):
            continue
        if tag in CLOSERS:
            for k in [*meets[-len(CLOSED_BY) - 1 :]][::-1]:  # in one scope, a kind is open once
                open_ = stack[k][0]
                if tag in CLOSED_BY.get(open_, ()):
                    pop_to(k)
                elif open_ in SCOPE:
                    break
        named = attribute_words(attrs) if attrs else ()
        node = stack[-1][1]
        if tag in BLOCKS or named:
            page.parent.append(node)
            node = len(page.tag)
            page.tag.append(tag)
            page.words.append(named)
            page.depth.append(page.depth[page.parent[-1]] + 1)
            page.end.append(node + 1)
            page.mark.append("data-m=" in attrs)
            for x in (page.chars, page.linked, page.punct):
                x.append(0)
        depths.setdefault(tag, []).append(len(stack))
        if tag in FENCES:
            fences.append(len(stack))
        if tag in MET:
            meets.append(len(stack))
        stack.append((tag, node))
    if at < len(source):
        text(source[at:])
    pop_to(1)
    page.end[0] = len(page.tag)
    return page


LISTS, FIELDS, HEADS, PARAS = frozenset(["li"]), frozenset("form input button select option label fieldset legend".split()), frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset(["p"])
N_FEATURES = 26


def features(page: Page, odds: dict[str, float]) -> np.ndarray:
    n = len(page.tag)
    parent, end, depth = np.array(page.parent), np.array(page.end), np.array(page.depth)
    start = np.arange(n)

    def below(x) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(x)])
        return (c[end] - c[start]).astype(np.float64)

    chars, linked, punct = below(page.chars), below(page.linked), below(page.punct)
    nodes = (end - start).astype(np.float64)
    lists, fields, heads, paras = (below([t in k for t in page.tag]) for k in (LISTS, FIELDS, HEADS, PARAS))
    up = np.maximum(parent, 0)
    siblings = np.bincount(parent[1:], minlength=n).astype(np.float64) if n > 1 else np.zeros(n)
    order = np.argsort(up[1:], kind="stable") + 1
    place = np.zeros(n)
    if n > 1:
        first = np.concatenate([[True], up[order][1:] != up[order][:-1]])
        run = np.arange(n - 1) - np.maximum.accumulate(np.where(first, np.arange(n - 1), 0))
        place[order] = run
    tag = np.array([odds.get("<" + t, 0.0) for t in page.tag])
    each = [[odds.get(w, 0.0) for w in ws] or [0.0] for ws in page.words]
    high, low = np.array([max(x) for x in each]), np.array([min(x) for x in each])
    known = np.array([sum(w in odds for w in ws) for ws in page.words])
    tag_min, low_min, high_max = tag.copy(), low.copy(), high.copy()
    for i in range(1, n):
        p = page.parent[i]
        tag_min[i], low_min[i], high_max[i] = min(tag[i], tag_min[p]), min(low[i], low_min[p]), max(high[i], high_max[p])
    before = np.concatenate([[0], np.cumsum(page.chars)])[start]
    total = max(1.0, chars[0])
    own = np.array(page.chars, np.float64)
    return np.stack([
        depth, nodes, np.log1p(chars), chars / nodes, linked / np.maximum(chars, 1), punct / np.maximum(chars, 1), siblings, siblings[up], place, place / np.maximum(siblings[up], 1),
        chars / np.maximum(chars[up], 1), chars / total, before / total, np.log1p(own), own / np.maximum(chars, 1), lists / nodes, fields / nodes, heads, paras, np.log1p(chars / np.maximum(paras, 1)),
        tag, tag[up], tag_min, high, low_min, high_max + low + 0.01 * known,
    ], 1).astype(np.float32)


@dataclass
class Trees:
    """Boosted trees of fixed depth over binned features; logistic loss."""

    edges: list[np.ndarray]
    base: float
    split: np.ndarray  # (trees, 2**depth - 1): feature
    cut: np.ndarray  # bin above which the right child is taken
    leaf: np.ndarray  # (trees, 2**depth)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k]) for k, e in enumerate(self.edges)], 1).astype(np.uint8)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        rows = np.arange(len(b))
        out = np.full(len(b), self.base)
        depth = int(np.log2(self.leaf.shape[1]))
        for f, c, v in zip(self.split, self.cut, self.leaf, strict=True):
            at = np.zeros(len(b), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (b[rows, f[at]] > c[at])
            out += v[at - (1 << depth) + 1]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 5.0) -> Trees:
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(edges, float(np.log(p / (1 - p))), np.zeros((trees, (1 << depth) - 1), np.int64), np.full((trees, (1 << depth) - 1), 255), np.zeros((trees, 1 << depth)))
    b = model.bins(x).astype(np.int64)
    n, k = b.shape
    flat = b + np.arange(k) * bins
    m = np.full(n, model.base)
    for t in range(trees):
        q = 1 / (1 + np.exp(-m))
        g, h = q - y, q * (1 - q)
        at = np.zeros(n, np.int64)
        for d in range(depth):
            first, width = (1 << d) - 1, 1 << d
            code = ((at - first)[:, None] * (k * bins) + flat).ravel()
            hist = [np.bincount(code, np.repeat(w, k), minlength=width * k * bins).reshape(width, k, bins) for w in (g, h)]
            left = [np.cumsum(a, 2) for a in hist]
            whole = [a[:, :, -1:] for a in left]
            gain = left[0] ** 2 / (left[1] + ridge) + (whole[0] - left[0]) ** 2 / (whole[1] - left[1] + ridge)
            gain[:, :, -1] = -1
            best = gain.reshape(width, -1).argmax(1)
            better = gain.reshape(width, -1)[np.arange(width), best] > (whole[0][:, 0, 0] ** 2 / (whole[1][:, 0, 0] + ridge)) + 1e-6
            model.split[t, first : first + width] = best // bins
            model.cut[t, first : first + width] = np.where(better, best % bins, 255)
            at = 2 * at + 1 + (b[np.arange(n), model.split[t, at]] > model.cut[t, at])
        leaf = at - (1 << depth) + 1
        model.leaf[t] = -rate * np.bincount(leaf, g, minlength=1 << depth) / (np.bincount(leaf, h, minlength=1 << depth) + ridge)
        m += model.leaf[t][leaf]
    return model


@dataclass
class Extractor:
    odds: dict[str, float]
    trees: Trees

    def texts(self, sources: list[str]) -> list[str]:
        pages = [parse(s) for s in sources]
        if not pages:
            return []
        m = self.trees.margin(np.concatenate([features(p, self.odds) for p in pages]))
        out, at = [], 0
        for p in pages:
            out.append(assemble(p, decode(p.parent, m[at : at + len(p.tag)])))
            at += len(p.tag)
        return out


def decode(parent: list[int], margin: np.ndarray) -> list[bool]:
    """The likeliest labelling without a kept node below a dropped one; the root is kept."""
    n = len(parent)
    yes, no = (-np.logaddexp(0, -margin)).tolist(), (-np.logaddexp(0, margin)).tolist()
    best, none = [0.0] * n, no[:]
    for i in range(n - 1, 0, -1):
        best[i] += yes[i]
        p = parent[i]
        none[p] += none[i]
        best[p] += best[i] if best[i] > none[i] else none[i]
    keep = [True] * n
    for i in range(1, n):
        keep[i] = keep[parent[i]] and best[i] > none[i]
    return keep


def assemble(page: Page, keep: list[bool]) -> str:
    out, block = [], []
    for s in [*page.segments, None]:
        if s is None:
            if block and (t := " ".join("".join(block).split())):
                out.append(t)
            block = []
        elif keep[s[0]]:
            block.append(s[1])
    return " ".join(out)


def learn(pages: int = 900, seed: int = 1) -> Extractor:
    """Train on generated pages: half of them give the log-odds, all of them the trees."""
    parsed = [parse(annotated(seed * 1_000_003 + i)) for i in range(pages)]
    hot, cold = Counter(), Counter()
    for p in parsed[: pages // 2]:
        for t, ws, y in zip(p.tag[1:], p.words[1:], p.mark[1:], strict=True):
            (hot if y else cold).update(["<" + t, *ws])
    a, b = sum(hot.values()), sum(cold.values())
    odds = {k: float(np.log((hot[k] + 0.5) / a) - np.log((cold[k] + 0.5) / b)) for k in hot.keys() | cold.keys() if hot[k] + cold[k] > 2}
    x = np.concatenate([features(p, odds) for p in parsed])
    y = np.concatenate([np.array(p.mark, np.float64) for p in parsed])
    return Extractor(odds, boost(x, y))


def extract(spark: SparkSession, pages: DataFrame, model: Extractor) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages."""
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "html"):
            text = shared.value.texts([b.text(i) for i in range(len(b))])
            yield pa.RecordBatch.from_arrays([b.rows.column(0).cast(pa.int64()), b.rows.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark, read_table(spark, sf_dir, "pages"), learn())
