"""Main text of web pages by tag-path ratios.

A page's text nodes are grouped by their root-to-leaf tag path.  Each path has
a ratio of characters and one of punctuation marks to its nodes; both series
are smoothed along the page, fused by multiplication, and the nodes above the
threshold are taken for content.  The deepest article or main element that holds
most of the content is the article; its text is taken whole, without the parts
that tags, roles or names mark as something else, since a heading or a short
paragraph of the article has a small ratio of its own.  Without such an element
the article is all that stands from the first content to the last and in the
lowest container of all content, and what adjoins it up to a block of links: in
the containers around it, or in the body as far as a heading before it.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm.arrays import slices, tidy

#: Share of the mean fused ratio (weighted by characters) that content has, and
#: share of the content that an article or main element holds.
THRESHOLD, HOLDS = 0.2, 0.6

# Elements and names that are never the article's text.
_RAW = frozenset({"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes"})
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OTHER = frozenset(
    "script style head title noscript template nav footer aside form button select option textarea iframe svg canvas object menu dialog input label fieldset audio video".split()
)
_OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar alertdialog".split())
_OTHER_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising advertisment sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent gdpr notice notices
    nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside rail footer masthead topbar toolbar comment comments commentlist disqus reply replies respond
    share sharing social related recommended recommendations popular trending subscribe subscription newsletter signup login popup modal overlay paywall alert widget
    widgets pagination pager skip search tags outbrain taboola copyright colophon""".split()
)
#: What a name may have beside one of those: "main-nav" is a menu, "share-of-market" isn't.
_BESIDE = frozenset(
    """account area articles bar block bottom box button buttons by col column container content email end first float form global group head header holder icon icons id in
    inner item items last layer left line link links list main media message module more new news on outer page panel point policy post posts primary right row secondary section
    site slot small social space stories sub text title to top topics unit us user view wrap wrapper you your""".split()
)
_PAGE_PARTS = frozenset({"header"})  # of the page, unless inside the article
_CONTAINERS = frozenset("html body main article section div td center".split())
_BLOCKS = frozenset(
    """html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption header footer nav
    aside form fieldset address hr details summary center""".split()
)
#: A start tag closes these elements, if they are open nearer than a table, list or container.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SCOPE = frozenset("html body main article section div table ul ol dl aside nav header footer form blockquote figure".split())

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""(?i)\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
_NAME = re.compile(r"[a-z]+")
_MARKS = re.compile(r"[.,;:!?…。，、！？；：]")


def _is_other(tag: str, attributes: str) -> bool:
    """Whether an element is none of the article's by its tag, role or name."""
    if tag in _OTHER:
        return True
    if attributes and tag not in ("html", "body"):
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            if name == "role" and value in _OTHER_ROLES:
                return True
            if name in ("class", "id") and tag not in ("article", "main") and any(_names_other(x) for x in value.split()):
                return True
    return False


def _names_other(word: str) -> bool:
    parts = set(_NAME.findall(word))
    return not parts.isdisjoint(_OTHER_NAMES) and parts <= _OTHER_NAMES | _BESIDE


class Node:
    """An element that is open, or was; elements below it have numbers up to ``last``."""

    __slots__ = ("article", "container", "depth", "heading", "last", "link", "number", "other", "parent", "path", "tag")

    def __init__(self, tag: str, parent: Node | None, number: int, other: bool, paths: dict[tuple[int, str], int]) -> None:
        self.tag, self.parent, self.number, self.last = tag, parent, number, number
        self.other = other or parent is not None and parent.other
        #: Equal for elements with the same tags from the root on.
        self.path = paths.setdefault((parent.path, tag), len(paths) + 1) if parent else 0
        self.depth = parent.depth + 1 if parent else 0
        self.link = tag == "a" or parent is not None and parent.link
        self.heading = tag in _HEADINGS or parent is not None and parent.heading
        # The nearest of their kinds, itself included.
        self.article: Node | None = self if tag in ("article", "main") else parent.article if parent else None
        self.container: Node | None = self if tag in _CONTAINERS and tag not in ("html", "body") else parent.container if parent else None

    def holds(self, node: Node) -> bool:
        return self.number <= node.number <= self.last


def blocks(page: str) -> list[tuple[Node, str]]:
    """(innermost element, decoded text with single spaces) of each block's text, in page order, other parts left out."""
    paths: dict[tuple[int, str], int] = {}
    root = Node("", None, 0, False, paths)
    top, nodes = root, [root]
    opened: dict[str, int] = defaultdict(int)
    out: list[tuple[Node, str]] = []
    pieces: list[str] = []
    held = root  # where the block's longest piece stands
    size = 0

    def flush() -> None:
        nonlocal size, held
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            out.append((held, text))
        size, held = 0, top

    def take(raw: str) -> None:
        nonlocal size, held
        if raw and not top.other:
            text = html.unescape(raw)
            pieces.append(text)
            if len(text.strip()) > size:
                size, held = len(text.strip()), top

    def shut(node: Node) -> Node:
        """The innermost open element once ``node`` and all within it are closed."""
        now = top
        while now is not node:
            opened[now.tag] -= 1
            now = now.parent
        opened[node.tag] -= 1
        return node.parent

    at, end = 0, len(page)
    while at < end:
        m = _MARKUP.search(page, at)
        if m is None:
            take(page[at:])
            break
        take(page[at : m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            if opened[tag]:
                node = top
                while node.tag != tag:
                    node = node.parent
                if tag in _BLOCKS:
                    flush()
                top = shut(node)
            continue
        if tag in _VOID:
            if tag in ("br", "hr", "img", "input"):
                pieces.append(" ")
            continue
        if tag in _RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag in _BLOCKS:
            flush()
            node = top
            closes = _CLOSES.get(tag, ())
            if opened["p"] or any(opened[x] for x in closes):
                while node is not root and node.tag not in _SCOPE:
                    above = node.parent
                    if node.tag == "p" or node.tag in closes:
                        top = shut(node)
                    node = above
        if m.group(3).endswith("/") and tag not in _BLOCKS:
            continue
        other = _is_other(tag, m.group(3)) or tag in _PAGE_PARTS and top.article is None
        top = Node(tag, top, len(nodes), other, paths)
        nodes.append(top)
        opened[tag] += 1
        if not size:
            held = top
    flush()
    for node in reversed(nodes[1:]):
        node.parent.last = max(node.parent.last, node.last)
    return out


def _smooth(x: np.ndarray) -> np.ndarray:
    padded = np.concatenate([x[:1], x, x[-1:]])
    return (padded[:-2] + 2 * padded[1:-1] + padded[2:]) / 4


def _around(nodes: list[Node], content: list[int]) -> tuple[int, int]:
    """The range of blocks that is the article, where no element says so."""
    lo, hi = content[0], content[-1] + 1
    low, high = min(nodes[k].number for k in content), max(nodes[k].number for k in content)
    lowest = nodes[lo].container
    while lowest is not None and not lowest.number <= low <= high <= lowest.last:
        lowest = lowest.parent.container
    if lowest is not None:
        outermost = lowest
        while (above := outermost.parent.container) is not None:
            outermost = above
        inside = [k for k, n in enumerate(nodes) if lowest.holds(n)]
        lo, hi = min(lo, inside[0]), max(hi, inside[-1] + 1)
        while lo and outermost.holds(nodes[lo - 1]) and not nodes[lo - 1].link:
            lo -= 1
        while hi < len(nodes) and outermost.holds(nodes[hi]) and not nodes[hi].link:
            hi += 1
    k = lo - 1
    while k >= 0 and not nodes[k].link:
        if nodes[k].heading:
            lo = k
        k -= 1
    return lo, hi


def main_text(page: str | None) -> str:
    """The article's text; empty if there is none."""
    found = blocks(page) if page else []
    if not found:
        return ""
    chars, marks, nodes = defaultdict(int), defaultdict(int), defaultdict(int)
    for node, text in found:
        nodes[node.path] += 1
        chars[node.path] += len(text)
        marks[node.path] += len(_MARKS.findall(text))
    length = np.array([len(text) for _, text in found], float)
    by_text = _smooth(np.array([chars[n.path] / nodes[n.path] for n, _ in found]))
    by_mark = _smooth(np.array([(marks[n.path] + 0.1) / nodes[n.path] for n, _ in found]))
    fused = by_text * by_mark
    content = fused >= THRESHOLD * float((fused * length).sum() / length.sum())
    total, held = 0.0, defaultdict(float)
    container: dict[int, Node] = {}
    for (node, _), size, good in zip(found, length.tolist(), content.tolist(), strict=True):
        if good:
            total += size
            holder = node.article
            while holder is not None:
                held[holder.number] += size
                container[holder.number] = holder
                holder = holder.parent.article
    holders = [container[k] for k, size in held.items() if size >= HOLDS * total]
    if not holders:
        lo, hi = _around([node for node, _ in found], np.flatnonzero(content).tolist())
        return " ".join(text for _, text in found[lo:hi])
    article = max(holders, key=lambda n: n.depth)
    return " ".join(text for node, text in found if article.holds(node))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "html"):
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([main_text(x) for x in part.column(2).to_pylist()], pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars``: one row for each input row.

    A null or empty page, or one without content, has the empty text.  Markup
    that is cut off or unbalanced is read as far as it goes.  Repeated rows and
    ids get a row each; other columns are not read.
    """
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return source.mapInArrow(tidy(_run), "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
