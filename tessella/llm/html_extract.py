"""Main text of HTML pages by tag-path ratios.

A page is read into blocks, each with its path of tags (and the classes that tell a part's role) from
the root. Text length, punctuation and linked text are summed by path; both ratios are smoothed over
neighbouring paths and fused. A path whose role word or tag says that it is around an article has its
ratio lowered, unless it holds most of the page's text; an <article> or <main> is part of it only where
it lists such (comments, related). Nothing is left out by words alone: all paths, lowered or not, are
held against one threshold, which selects paths, and their blocks are the main text. Headings, short
lines and the like, whose own paths are low, come with the part that they stand in: a block is filled in
where a container above it has most of its text selected and no more than half of it in the branch that
the block stands in; a lowered part with little selected in it is no way up.

A null or empty page has empty text. Scripts, styles and comments never count. Unclosed elements end
where HTML ends them; a page that breaks off inside a tag loses that tag alone. Repeated rows each get
a row; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, ship

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.S)
ROLE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NONE = re.compile(r"display\s*:\s*none", re.I)
RAW = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "textarea", "title", "head", "video", "audio"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
#: A start of one of these ends an open one of those.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements and role words of what is around an article.
AROUND = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "fieldset"}
AROUND_WORDS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside footer foot masthead topbar cookie cookies consent gdpr notice notification alert banner ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments respond reply replies discussion disqus share sharing social related recommended newsletter subscribe subscription signup login popup modal widget pagination pager copyright legal disclaimer toolbar search searchform skip".split())
#: Parts that hold articles which aren't the page's own; and tags of parts that never are its main text.
LISTS = frozenset("comment comments respond reply replies discussion disqus related recommended promo promotion sponsor sponsored ad ads advert adverts advertisement advertising".split())
NEVER = {"nav", "footer", "menu", "button", "select"}
MOST = 0.5
PUNCTUATION = re.compile(r"[.,;:!?…。、！？]")
SPACES = re.compile(r"\s+")
#: The share of the spread above the mean from which a path is selected, and what the ratio of a path around the article is lowered to.
THRESHOLD, LOWERED = 0.5, 0.05
#: The share of a container's text that is selected where the rest is filled in, and that a branch filled in has at most.
SELECTED, BRANCH = 0.5, 0.5
#: Elements of text, which are no containers.
TEXTS = HEADINGS | {"p", "li", "ul", "ol", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "blockquote", "pre", "figure", "figcaption", "address", "center", "details", "summary", "caption", "hr"}


def is_hidden(attributes: str) -> bool:
    """Whether an element's own attributes hide it."""
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").strip()
        if (name == "hidden" and value.lower() != "false") or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and NONE.search(value)):
            return True
    return False


class Element:
    """An open or closed element: its place in page order, the number of its tag path, and what it is part of."""

    __slots__ = ("tag", "place", "path", "around", "apart", "marked", "parent", "hidden", "inside", "depth")

    def __init__(self, tag: str, attributes: str, parent: Element | None, page: Page):
        words = set()
        if attributes and "=" in attributes:
            for m in ROLE.finditer(attributes):
                words |= set(re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", m[1] or m[2] or m[3] or "").lower())) & AROUND_WORDS
        self.tag, self.parent, self.depth, self.place = tag, parent, parent.depth + 1 if parent else 0, len(page.elements)
        step = (parent.path if parent else -1, tag, *sorted(words))
        self.path = page.paths.setdefault(step, len(page.paths))
        before = parent is not None and parent.inside
        self.inside = before or tag in ("article", "main")
        self.marked = bool(words and tag not in ("html", "body", "article", "main")) or tag in AROUND or (tag == "header" and not before)
        self.apart = self.marked and (tag in AROUND - {"form", "fieldset"} or bool(words & LISTS))
        self.around = self.marked
        self.hidden = bool(parent and parent.hidden) or bool(attributes and is_hidden(attributes))
        page.elements.append(self)


class Page:
    def __init__(self) -> None:
        self.elements: list[Element] = []
        self.paths: dict[tuple, int] = {}
        self.blocks: list[Block] = []


class Block:
    __slots__ = ("element", "text", "linked")

    def __init__(self, element: Element, text: str, linked: int):
        self.element, self.text, self.linked = element, text, linked


def read_page(page: str) -> Page:
    """The blocks of text in page order, each with the element it stands in."""
    read = Page()
    root = Element("#", "", None, read)
    now, out, parts, linked, link = root, read.blocks, [], 0, 0

    opened: Counter[str] = Counter()

    def leave(element: Element) -> None:
        """Ends everything open up to this element, itself included."""
        nonlocal now
        stop = element.parent
        while now is not stop:
            opened[now.tag] -= 1
            now = now.parent

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACES.sub(" ", html.unescape("".join(parts))).strip()
            if text and not now.hidden:
                out.append(Block(now, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
            linked += (m.start() - at) * (link > 0)
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closing = bool(m[1])
        if tag in INLINE:
            if tag == "a":
                link = 0 if closing else 1
            continue
        if tag == "br" or tag == "wbr":
            parts.append(" " if tag == "br" else "")
            continue
        flush()
        link = 0
        if tag in RAW and not closing:
            if m[3].rstrip().endswith("/") and tag in ("svg", "math"):
                continue
            if tag == "head":
                stop = re.compile(r"</head\s*>|<body\b", re.I).search(page, at)
                at = (stop.start() if stop and stop[0][1] != "/" else stop.end()) if stop else end
            else:
                stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = stop.end() if stop else end
        elif closing:
            if opened[tag]:
                up = now
                while up.tag != tag:
                    up = up.parent
                leave(up)
        elif tag not in VOID:
            if now.tag == "p":
                leave(now)
            shut = CLOSES.get(tag, set())
            up = now
            while any(opened[x] for x in shut) and up is not root and up.tag not in ("ul", "ol", "dl", "table", "select", "tbody"):
                if up.tag in shut:
                    leave(up)
                    break
                up = up.parent
            if tag in HEADINGS and now.tag in HEADINGS:
                leave(now)
            now = Element(tag, m[3], now, read)
            opened[tag] += 1
    flush()
    return read


def place_around(read: Page) -> bool:
    """Tells of each element whether it is around the article, now that it is known how much text each holds; and whether all text was."""
    size = [0] * len(read.elements)
    for b in read.blocks:
        size[b.element.place] += len(b.text) - b.linked
    for e in reversed(read.elements):  # parents stand before their children
        if e.parent is not None:
            size[e.parent.place] += size[e.place]
    for e in read.elements:
        if e.marked and e.tag not in NEVER and size[0] and size[e.place] >= MOST * size[0]:
            e.around = e.apart = False
        if e.parent is not None:
            e.apart = e.apart or e.parent.apart
            e.around = e.apart if e.tag in ("article", "main") else e.around or e.parent.around
    every = all(b.element.around for b in read.blocks)
    if every:
        for e in read.elements:
            e.around = False
    return every


def above_threshold(fused: np.ndarray) -> np.ndarray:
    limit = min(fused.mean() + THRESHOLD * fused.std(), fused.max())
    return (fused >= limit) & (fused > 0)


def selected_paths(blocks: list[Block]) -> set[int]:
    """Paths whose smoothed and fused ratios of text and punctuation, lowered around the article, reach the threshold.

    Without any punctuation the ratio of text decides, and without any text that isn't linked, that of all text.
    """
    order: dict[int, int] = {}
    for b in blocks:
        order.setdefault(b.element.path, len(order))
    size, every, marks, count = (np.zeros(len(order)) for _ in range(4))
    around = np.ones(len(order), bool)
    for b in blocks:
        i = order[b.element.path]
        size[i] += len(b.text) - b.linked
        every[i] += len(b.text)
        marks[i] += len(PUNCTUATION.findall(b.text)) * (1 - b.linked / max(1, len(b.text)))
        count[i] += 1
        around[i] &= b.element.around
    smooth = lambda x: np.convolve(np.pad(x, 1, mode="edge"), [0.1, 0.8, 0.1], "valid")
    lowered = np.where(around, LOWERED, 1.0)
    for ratio in (np.sqrt(smooth(size / count) * smooth(marks / count)), smooth(size / count), smooth(every / count)):
        chosen = above_threshold(ratio * lowered)
        if chosen.any():
            return {p for p, i in order.items() if chosen[i]}
    return set()


def filled_in(block: Block, size: list[int], held: list[int]) -> bool:
    """Whether a container above the block has enough selected text, most of it in other branches than the block's."""
    below, e = len(block.text), block.element
    while e is not None and e.tag not in ("#", "html", "body"):
        enough = held[e.place] >= SELECTED * size[e.place]
        if e.marked and e.around and not enough:
            return False
        if e.tag not in TEXTS and enough and below <= BRANCH * size[e.place]:
            return True
        below, e = size[e.place], e.parent
    return False


def main_text(page: str | None) -> str:
    read = read_page(page or "")
    blocks, elements = read.blocks, read.elements
    if not blocks:
        return ""
    nothing_else = place_around(read)
    if nothing_else and not any(len(b.text) > b.linked and PUNCTUATION.search(b.text) for b in blocks):
        return ""  # menus and the like, and no sentence among them
    chosen = selected_paths(blocks)
    size, held = [0] * len(elements), [0] * len(elements)
    for b in blocks:
        size[b.element.place] += len(b.text)
        held[b.element.place] += len(b.text) * (b.element.path in chosen)
    for e in reversed(elements):  # parents stand before their children
        if e.parent is not None:
            size[e.parent.place] += size[e.place]
            held[e.parent.place] += held[e.place]
    return "\n".join(b.text for b in blocks if b.element.path in chosen or filled_in(b, size, held))


def extract_text(pages: DataFrame) -> DataFrame:
    """pages: page_id, url, html. page_id, url, text, n_chars for each row."""
    ship(pages.sparkSession)

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
