"""Main text of web pages by composite text density.

The page becomes a tree of block elements; inline elements only count as tags. A node's density is its
characters per tag, adjusted for links: C / T times the logarithm of (C / LC) (T / LT) to the base
ln(C LC / (C - LC) + C LCb / Cb + e), where C, T are characters and tags of the subtree, LC, LT those of links, and b
stands for the body. The node with the largest sum of its children's densities is the main text; the least density on
its path to the body is the threshold at which other nodes join it, unless it is the page's article.

What a page names as menu, header, footer, side bar, notice, advert, form, script, style or comments is left
out first, since short boilerplate can be as dense as short paragraphs. Names are whole words of class and id; an element
whose name would take most of the page's text (more than WRAPS) is its wrapper and stays. Within the main text nothing else is left out.

Text: character references decoded, white space within a block one space, blocks trimmed, empty blocks left out, one line feed
between blocks, in page order.

Defined cases: null and empty html give an empty text; so does a page without text. Unclosed and stray tags are
closed or ignored as the block structure demands. Repeated rows each get a row. An empty table gives an empty table.
Columns besides page_id, url and html are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

#: Where markup starts: a comment or section up to its end, a tag up to its name, or a declaration.
OPENING = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)|<[!?]""", re.S)
MARK = re.compile(r"""[>"']""")
#: What stands in these is no text of the page.
RAW = frozenset("script style noscript template textarea iframe svg math object audio video canvas button".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element of the first kind ends an open one of the second, up to an enclosing one of the third.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("tr td th thead tbody", "table"), "tfoot": ("tr td th tbody", "table")}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
LEFT_OUT = frozenset("head title nav header footer aside form dialog menu select fieldset button".split())
NAMED = re.compile(r"(?:(?:site|cookie)[-_])?(?:ads?|advert\w*|banners?|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|masthead|menus?|modal|nav|navbar|navigation|newsletter|notices?|notifications?|popup|promo\w*|related|replies|respond|share|sharing|sidebars?|social|sponsor\w*|subscribe|subscription|toolbar)", re.I)
ROUNDS = 6
#: A named element with a larger share of all text is no boilerplate.
WRAPS = 0.8
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]++)))?""")
WHOLE = frozenset("html body main article".split())


class Tags:
    """The markup of a page from left to right, each character looked at a bounded number of times.

    Gives start, end, whether it closes, name and attributes of each tag, and no name for comments and declarations. A tag ends
    at the first > outside quotes. Once a quote is never closed, quotes no longer count; without a > what follows is text.
    """

    def __init__(self, html: str) -> None:
        self.html, self.quotes, self.ends = html, True, {}

    def end(self, at: int) -> int:
        while self.quotes:
            m = MARK.search(self.html, at)
            if m is None:
                break
            if m[0] == ">":
                return m.end()
            close = self.html.find(m[0], m.end())
            if close < 0:
                break
            at = close + 1
        else:
            return self.html.find(">", at) + 1
        self.quotes = False
        return self.html.find(">", at) + 1

    def skip(self, name: str, at: int) -> int:
        """Behind the closing tag of a raw element, or the end of the page."""
        if self.ends.get(name) == -1:
            return len(self.html)
        m = re.compile(rf"</{re.escape(name)}\s*+>", re.I).search(self.html, at)
        if m is None:
            self.ends[name] = -1
        return m.end() if m else len(self.html)

    def __iter__(self) -> Iterator[tuple[int, int, bool, str | None, str]]:
        at = 0
        while m := OPENING.search(self.html, at):
            if m[2] is None and m[0] not in ("<!", "<?"):
                yield m.start(), m.end(), False, None, ""
                at = m.end()
                continue
            end = self.end(m.end())
            if not end:
                return
            name = m[2] and m[2].lower()
            if name in RAW and not m[1] and self.html[end - 2] != "/":
                body = self.skip(name, end)
                if name == "button" and body == len(self.html):  # never closed: its label goes no further than the tag
                    body = end
                yield m.start(), body, False, name, ""
                at = body
                continue
            yield m.start(), end, bool(m[1]), name, self.html[m.end() : end - 1]
            at = end


class Node:
    __slots__ = ("tag", "parent", "parts", "left_out", "named", "chars", "tags", "link_chars", "link_tags", "density", "sum")

    def __init__(self, tag: str, parent: Node | None, left_out: bool) -> None:
        self.tag, self.parent, self.parts, self.left_out = tag, parent, [], left_out
        self.named = None  # which element's name left this one out
        self.chars = self.tags = self.link_chars = self.link_tags = 0

    def children(self) -> list[Node]:
        return [x for x in self.parts if isinstance(x, Node)]


def _unwanted(tag: str, attributes: str, forms: bool) -> tuple[bool, bool]:
    """Whether an element is left out whatever its name, and whether by its name."""
    if tag in LEFT_OUT:
        return not (forms and tag in ("form", "fieldset")), False
    if not attributes or tag in WHOLE:
        return False, False
    found = {k.lower(): a or b or d for k, a, b, d in ATTRIBUTE.findall(attributes)}
    if found.get("role", "").lower() in ROLES or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return True, False
    return False, any(map(NAMED.fullmatch, f"{found.get('class', '')} {found.get('id', '')}".split()))


def parse(html: str, forms: bool = False) -> Node:
    """The tree of block elements; forms: keep what stands in forms. Wrappers within wrappers are looked for ROUNDS times, then names don't count."""
    spared: set[int] = set()
    for round_ in range(ROUNDS + 1):
        lost: dict[int, int] = {}
        root = _parse(html, forms, spared, lost)
        total = sum(lost.values()) + sum(x.chars for x in _all(root))
        wrappers = {place for place, n in lost.items() if n > WRAPS * total}
        if not wrappers:
            return root
        spared |= set(range(len(html))) if round_ == ROUNDS - 1 else wrappers
    return root


def _all(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack += node.children()


def _parse(html: str, forms: bool, spared: set[int], lost: dict[int, int]) -> Node:
    """spared: places of elements whose name doesn't count; lost: gets the characters that each other name takes."""
    root = Node("html", None, False)
    at, link, done = root, False, 0

    def text(raw: str) -> None:
        if raw and at.named is not None:
            lost[at.named] = lost.get(at.named, 0) + len(raw.strip())
        if raw and not at.left_out:
            raw = unescape(raw) if "&" in raw else raw
            at.parts.append(raw)
            n = len(raw.strip())
            at.chars += n
            if link:
                at.link_chars += n

    open_: Counter[str] = Counter()

    def up_to(node: Node) -> None:
        nonlocal at
        while at is not node:
            open_[at.tag] -= 1
            at = at.parent

    for start, end, closes, tag, attributes in Tags(html):
        text(html[done:start])
        done = end
        if tag is None:
            continue
        if closes:
            if tag == "a":
                link = False
            if tag in BLOCKS and tag not in ("html", "body") and open_[tag]:
                node = at
                while node.tag != tag:
                    node = node.parent
                up_to(node.parent)
                link = False
            continue
        if tag in RAW:
            at.tags += tag == "button"
            continue
        if tag not in BLOCKS:
            at.tags += 1
            if tag == "a":
                at.link_tags += 1
                link = True
            elif tag == "br":
                text(" ")
            continue
        if tag in ("html", "body"):
            node = at
            while node.left_out and node.parent is not None:
                node = node.parent
            up_to(node)
            continue
        if at.tag == "p" or tag in HEADINGS and at.tag in HEADINGS:
            up_to(at.parent)
        if tag in ENDS and any(open_[x] for x in ENDS[tag][0]):
            closed, within = ENDS[tag]
            node = ends = at
            while node.parent is not None and node.tag not in within:
                if node.tag in closed:
                    ends = node.parent
                node = node.parent
            up_to(ends)
        always, named = _unwanted(tag, attributes, forms)
        named = named and start not in spared
        child = Node(tag, at, at.left_out or always or named)
        if at.left_out:
            child.named = None if always else at.named
        elif named and not always:
            child.named = start
        at.parts.append(child)
        if tag not in VOID:
            at, link = child, False
            open_[tag] += 1
    text(html[done:])
    return root


def measure(root: Node) -> list[Node]:
    """Give each node its densities; all nodes that are not left out, children before parents."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        node.parts = [x for x in node.parts if not isinstance(x, Node) or not x.left_out]
        order.append(node)
        stack += node.children()
    order.reverse()
    for node in order:
        for x in node.children():
            node.chars += x.chars
            node.tags += x.tags + 1
            node.link_chars += x.link_chars
            node.link_tags += x.link_tags
    share = root.link_chars / root.chars if root.chars else 0.0
    for node in order:
        ch, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        base = log(ch * node.link_chars / max(ch - node.link_chars, 1) + share * ch + e)
        inner = ch / lc * t / lt
        node.density = ch / t * (log(inner) / log(base) if base > 1.0001 else log(max(inner, 1e-9))) if ch else 0.0
        node.sum = sum(x.density for x in node.children()) or node.density
    return order


def _blocks(node: Node, out: list[str]) -> None:
    """Texts of the node's blocks, in order."""
    stack: list = [node]
    run: list[str] = []

    def flush() -> None:
        if s := " ".join("".join(run).split()):
            out.append(s)
        run.clear()

    while stack:
        x = stack.pop()
        if isinstance(x, str):
            run.append(x)
            continue
        flush()
        if x is None:
            continue
        stack += [None, *reversed(x.parts)]
    flush()


def main_nodes(root: Node) -> list[Node]:
    """The nodes whose texts are the main text, in page order."""
    order = measure(root)
    if not root.chars:
        return []
    best = max(reversed(order), key=lambda x: x.sum)
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    for node in path[1:]:  # the article that it is part of
        if node.tag in ("article", "main"):
            return [node]
    inside = [x for x in order if x.tag in ("article", "main") and 2 * x.chars >= best.chars]
    if best.tag not in ("article", "main") and inside:
        return [max(inside, key=lambda x: (x.tag == "article", x.chars))]
    if best.tag in ("article", "main"):
        return [best]
    threshold, on_path = min(x.density for x in path), set(map(id, path))
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if node is best or id(node) not in on_path and node.density >= threshold:
            found.append(node)
        elif id(node) in on_path:
            stack += reversed(node.children())
    return found


def main_text(html: str) -> str:
    out: list[str] = []
    for forms in (False, True):
        for node in main_nodes(parse(html, forms)):
            _blocks(node, out)
        if out or "<form" not in html.lower():
            break
    return "\n".join(out)


def html_text(pages: DataFrame) -> DataFrame:
    """page_id, url and text of each row of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([main_text(x.as_py()) for x in b.column(2)], pa.string())], names=["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), c.text_or_empty("html").alias("html")).mapInArrow(run, "page_id long, url string, text string")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(c.table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
