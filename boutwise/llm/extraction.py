"""Main text of HTML pages by tag-path ratios.

Each page is read once into text leaves with their root-to-leaf tag path. Per path the text length and the punctuation count are averaged over its leaves; both
ratios are smoothed over neighbouring leaves in page order, fused by their product, and paths at or above a share of the page's standard deviation hold content.
All blocks of those paths are kept, and with them the rest of the content region: the <article> and <main> elements if they hold nearly all text of those
paths together, else the deepest element that does. Left out is what is marked as menu, header, footer, sidebar, notice, advert, form, script, style or reader
comment by its element, or by a word of its class, id or role unless the element so marked holds nearly all text of those paths itself and no unmarked
<article> or <main> has text.

Defined results: a null, empty or textless page gives an empty text; white space (any Unicode blank, line breaks of markup included) inside a block is one space;
blocks are joined by an empty line in page order; unclosed, crossed and cut-off markup is closed as a browser would; a `<` that begins no tag is text; repeated rows are
pages of their own; an empty table gives an empty result; other columns pass through.

Scale: one pass, no shuffle, memory of one page at a time.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)

# fixed values: HTML's element classes
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search "
    "section summary table ul".split())
SAME_ENDS = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")),
             "th": ("td th", ("tr", "table")), "option": ("option", ("select",)), "tbody": ("tr td th tbody thead tfoot", ("table",))}
SCOPE = frozenset("article aside body section main table td th html blockquote".split())
P_SCOPE = SCOPE | frozenset("button li div ul ol form nav footer header".split())
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li".split())

# what is no part of an article: elements, and words of class, id and role
DROP_TAGS = frozenset("nav footer aside form button select dialog svg canvas object audio video menu head fieldset input math".split())
DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising advertorial adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar "
    "aside complementary footer foot contentinfo colophon cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "comment comments commentlist respond reply replies disqus discussion share sharing social related recommended recommendations toolbar widget widgets pagination pager search "
    "skip masthead topbar paywall disclaimer".split())
HEADER_WORDS = frozenset("header head banner masthead".split())
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PUNCT = re.compile(r"[,.;:!?，。、；：！？…\"“”»«]")

SHARE = 0.9
LAMBDA = 0.1
KERNEL = np.exp(-0.5 * (np.arange(-2, 3) / 1.0) ** 2)
KERNEL /= KERNEL.sum()


class Node:
    """drop: 0, or 1 in an element that a word marks, or 2 in one that its tag marks or that is hidden; marks: whether a word marks this element itself."""

    __slots__ = ("tag", "parent", "drop", "path", "depth", "mass", "inside", "kept", "marks")

    def __init__(self, tag, parent, drop, path):
        self.tag, self.parent, self.path = tag, parent, path
        self.drop, self.marks = max(drop, parent.drop if parent else 0), drop == 1
        self.depth = parent.depth + 1 if parent else 0
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        self.mass, self.kept = 0.0, False


def _dropped(tag: str, attrs: str, parent: Node) -> int:
    inside = parent.inside or parent.tag in ("article", "main")
    if parent.drop == 2 or tag in DROP_TAGS or tag == "header" and not inside:
        return 2
    if not attrs or tag in ("body", "html", "article", "main"):
        return 0
    if HIDDEN.search(attrs):
        return 2
    for m in ATTR.finditer(attrs):
        raw = m[2] or m[3] or m[4] or ""
        words = set(_SPLIT.split(_CAMEL.sub("-", raw).lower()))
        if words & DROP_WORDS or not inside and words & HEADER_WORDS:
            return 1
    return 0


class Reader:
    """Open elements while a page is read. nodes: all elements, parents first; leaves: (decoded text, element, block number) in page order."""

    def __init__(self, page: str):
        self.root = self.here = Node("", None, 0, 0)
        self.nodes = [self.root]
        self.leaves: list[tuple[str, Node, int]] = []
        self.block = 0
        self._open: dict[str, int] = {}
        self._paths: dict[tuple[int, str], int] = {}
        at, n = 0, len(page)
        while at < n:
            m = TOKEN.search(page, at)
            to = m.start() if m else n
            if to > at:
                self.leaves.append((html.unescape(page[at:to]), self.here, self.block))
            if m is None:
                break
            at = m.end()
            tag = m["tag"] or m["tag2"]
            if tag is None:
                if m["cdata"]:
                    self.leaves.append((m["cdata"], self.here, self.block))
                continue
            tag = tag.lower()
            if m["close"] or m["close2"]:
                self._end(tag)
            elif tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
                self.block += 1
            else:
                self._begin(tag, m["attrs"] or m["attrs2"] or "")

    def _leave(self, node: Node) -> None:
        """Closes the open elements down to node, node included."""
        p = self.here
        while p is not node.parent:
            self._open[p.tag] -= 1
            p = p.parent
        self.here = p

    def _find(self, tags, stop) -> Node | None:
        """The innermost open element of these tags with none of stop inside it."""
        if not any(self._open.get(t) for t in tags):
            return None
        p = self.here
        while p is not self.root:
            if p.tag in tags:
                return p
            if p.tag in stop:
                return None
            p = p.parent
        return None

    def _end(self, tag: str) -> None:
        if tag not in INLINE:
            self.block += 1
        node = self._find((tag,), SCOPE if tag in INLINE or tag in ("p", "li") else ())
        if node is not None:
            self._leave(node)

    def _begin(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self.leaves.append((" ", self.here, self.block))
            return
        if tag not in INLINE:
            self.block += 1
        if tag in VOID:
            return
        if tag in ENDS_P:
            p = self._find(("p",), P_SCOPE)
            if p is not None:
                self._leave(p)
        elif tag in SAME_ENDS:
            ends, stop = SAME_ENDS[tag]
            while (p := self._find(ends.split(), stop)) is not None:
                self._leave(p)
        path = self._paths.setdefault((self.here.path, tag), len(self._paths) + 1)
        self.here = Node(tag, self.here, _dropped(tag, attrs, self.here), path)
        self.nodes.append(self.here)
        self._open[tag] = self._open.get(tag, 0) + 1


def main_text(page: str | None) -> str:
    """The article's blocks, joined by an empty line."""
    if not page:
        return ""
    read = Reader(page)
    _clear_marks([x for x in read.leaves if x[1].drop < 2 and x[0].strip()], read.nodes)
    found = [x for x in read.leaves if not x[1].drop]
    words = [x for x in found if x[0].strip()]
    if not words:
        return ""
    chosen = _weigh(words, read.nodes)
    whole = {block for (_, _, block), c in zip(words, chosen.tolist(), strict=True) if c}
    for node in _regions(read.nodes):
        node.kept = True
    for node in read.nodes[1:]:
        node.kept |= node.parent.kept
    blocks: dict[int, list[str]] = {}
    for t, node, block in found:
        if node.kept or block in whole:
            blocks.setdefault(block, []).append(t)
    joined = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(b for b in joined if b)


def _clear_marks(words: list[tuple[str, Node, int]], nodes: list[Node]) -> None:
    """A word's mark does not count on an element that holds SHARE of the mass, as there the path scores disagree with it, unless an unmarked <article> or
    <main> has text."""
    if not any(node.drop for _, node, _ in words) or any(not node.drop and (node.inside or node.tag in ("article", "main")) for _, node, _ in words):
        return
    _weigh(words, nodes)
    for node in nodes[1:]:
        node.marks &= node.mass < SHARE * nodes[0].mass
        if node.drop == 1:
            node.drop = 1 if node.marks else node.parent.drop


def _weigh(found: list[tuple[str, Node, int]], nodes: list[Node]) -> np.ndarray:
    """Whether the path of each leaf is selected by its ratios; sets each element's mass, the weighted text of those paths in it."""
    length = np.array([len(t.strip()) for t, _, _ in found], float)
    marks = np.array([len(_PUNCT.findall(t)) for t, _, _ in found], float)
    at = np.unique([node.path for _, node, _ in found], return_inverse=True)[1]
    n = np.bincount(at)
    ratio = (np.bincount(at, length) / n)[at]
    punct = (np.bincount(at, marks) / n)[at]
    if len(at) >= len(KERNEL):
        ratio, punct = (np.convolve(np.pad(x, 2, mode="edge"), KERNEL, mode="valid") for x in (ratio, punct))
    fused = ratio * (0.1 + punct)
    per_path = np.bincount(at, fused * length) / np.bincount(at, length)
    chosen = per_path[at] >= LAMBDA * fused.std()
    if not chosen.any():
        chosen[:] = True
    for node in nodes:
        node.mass = 0.0
    for w, (_, node, _) in zip(np.where(chosen, length * per_path[at], 0.0).tolist(), found, strict=True):
        node.mass += w
    for node in reversed(nodes[1:]):
        node.parent.mass += node.mass
    return chosen


def _regions(nodes: list[Node]) -> list[Node]:
    """The elements that hold SHARE of the mass: all <article> and <main> if they do, each without an outer one that adds nothing; else the deepest element."""
    own = {p: p.mass for p in nodes if p.tag in ("article", "main") and p.mass > 0}
    total = 0.0
    for p in own:
        q = p.parent
        while q is not None and q not in own:
            q = q.parent
        if q is None:
            total += p.mass
        else:
            own[q] -= p.mass
    if own and total >= SHARE * nodes[0].mass:
        return [p for p, m in own.items() if m > 1e-9 * p.mass]
    full = [p for p in nodes if p.mass >= SHARE * nodes[0].mass and p.tag not in INLINE and p.tag not in LEAF]
    return [max(full, key=lambda p: p.depth)]


def _extract(at: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                text = pa.array([main_text(h) for h in part.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, text], [*part.schema.names, name])

    return run


def extract(pages: DataFrame, html_col: str = "html", name: str = "text") -> DataFrame:
    """All columns of pages, and the main text."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields)
    return pages.mapInArrow(_extract(pages.columns.index(html_col), name), f"{schema}, `{name}` string")
