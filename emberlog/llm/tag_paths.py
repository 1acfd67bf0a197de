"""Main text of web pages by tag-path ratios.

Text nodes with the same path of tags from the root share a design role. For every path of a page the
text length and the punctuation per node are taken, both are smoothed over the page in reading order and
fused by their product, and nodes whose fused ratio reaches a share of the page's spread select content.
Names of classes and the like are a vote only: what they call a sidebar or comments goes unless it holds
most of the selected text, and what they call a notice or a search goes unless its paths are selected.
The article or main element with most of the selected text, or else the lowest element that holds all of it
but links, then gives the article: all blocks in it, and those from the heading before it on, but not those in
menus, adverts, forms and the like.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from emberlog.llm.common import only
from emberlog.session import ship

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr".split())
#: An opening tag ends these open elements, up to the nearest enclosing container.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"},
        "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
        "option": {"option"}}
CONTAINERS = frozenset("html body div article main section aside nav header footer form table ul ol dl tbody "
                       "thead blockquote figure td th li dd fieldset button".split())
#: Elements that can be an article as a whole.
SECTIONS = frozenset(["", "html", "body", "div", "article", "main", "section"])
#: Elements that are never part of an article.
OUTSIDE = frozenset("head nav header footer aside form script style noscript template button select iframe "
                    "svg canvas object dialog menu textarea title".split())
#: Words in class, id or role of what is no part of an article, unless it holds most of the selected text.
STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertising breadcrumb breadcrumbs comment comments commentary "
    "discussion disqus replies reply respond responses consent cookie cookies gdpr footer masthead login menu "
    "modal nav navbar navigation newsletter pagination pager popup promo promoted promotion recommended related "
    "share sharing sidebar sidebars signup social sponsor sponsored subscribe toolbar complementary "
    "contentinfo".split())
#: Words of what is no part of an article unless its own paths are selected.
WEAK = frozenset("banner copyright disclaimer foot header notice notices notification search side skip widget".split())
#: Words that turn such a name into one of a layout, as in with-sidebar, no-footer or comments-open.
LAYOUT = frozenset("with without no not has have is are open opened closed enabled disabled show hide toggle".split())
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
UNSEEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
NAME, NEXT = re.compile(r"[a-zA-Z][^\s/>]*"), re.compile(r"[>\"']")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")


def tags(page: str) -> Iterator[tuple[int, int, bool, str | None, str]]:
    """Start, end, whether it closes, name and attributes of each tag; name None for comments and the like.

    Each place is looked at once: what is not found once is not looked for again further on.
    """
    at, size = 0, len(page)
    missing: set[str] = set()

    def find(what: str, start: int) -> int:
        if what in missing:
            return -1
        found = page.find(what, start)
        if found < 0:
            missing.add(what)
        return found

    while (start := page.find("<", at)) >= 0:
        end = -1
        if page.startswith("<!--", start):
            end = find("-->", start + 4)
            yield start, (size if end < 0 else end + 3), False, None, ""
            at = size if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", start) and (end := find("]]>", start + 9)) >= 0:
            yield start, end + 3, False, None, ""
            at = end + 3
            continue
        if page.startswith(("<!", "<?"), start):
            if (end := find(">", start)) >= 0:
                yield start, end + 1, False, None, ""
            at = max(start + 1, end + 1)
            continue
        closes = page.startswith("</", start)
        name = NAME.match(page, start + 1 + closes)
        if name is None or find(">", name.end()) < 0:
            at = start + 1
            continue
        place = name.end()
        while (stop := NEXT.search(page, place)) is not None and stop[0] != ">":
            closed = find(stop[0], stop.end())
            place = stop.end() if closed < 0 else closed + 1  # a quote that never ends is a letter
        if stop is None:  # the last > stands in quotes
            missing.add(">")
            at = start + 1
            continue
        yield start, stop.end(), closes, name[0].lower(), page[name.end():stop.start()]
        at = stop.end()


class Element:
    """An open or closed element; `path` numbers the tag path from the root."""

    __slots__ = ("tag", "parent", "path", "depth", "outside", "doubt", "linked", "heading", "chars", "all", "inside")

    def __init__(self, tag: str, parent: Element | None, outside: bool, doubt: int, paths: dict) -> None:
        self.tag, self.parent, self.chars, self.all, self.inside = tag, parent, 0, 0, False
        self.path = paths.setdefault((parent.path if parent else None, tag), len(paths))
        self.depth = parent.depth + 1 if parent else 0
        self.outside = outside or bool(parent and parent.outside)
        self.doubt = doubt  # 1: named like what is seldom part of an article, 2: like what never is
        self.linked = tag == "a" or bool(parent and parent.linked)
        self.heading = tag if tag in ("h1", "h2") else parent.heading if parent else ""


class Page:
    """Elements and text nodes (element, raw text, number of the block) of a page, in reading order."""

    def __init__(self, page: str) -> None:
        self.paths: dict = {}
        self.elements: list[Element] = []
        self.texts: list[tuple[Element, str, int]] = []
        self.open: dict[str, int] = defaultdict(int)
        self.here = self.top = self.begin("", None, False, 0)
        at, block = 0, 0
        for start, end, closes, tag, attributes in tags(page):
            if start < at:
                continue
            if start > at:
                self.texts.append((self.here, page[at:start], block))
            at = end
            if tag is None:
                continue
            if tag == "br":
                self.texts.append((self.here, " ", block))
                continue
            if tag not in INLINE:
                block += 1
            if closes:
                self.end(tag)
                continue
            self.imply_ends(tag)
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = close.end() if close else len(page)
            elif tag not in VOID and not attributes.endswith("/"):
                self.here = self.begin(tag, self.here, *self.apart(tag, attributes))
        if at < len(page):
            self.texts.append((self.here, page[at:], block))

    def begin(self, tag: str, parent: Element | None, outside: bool, doubt: int) -> Element:
        element = Element(tag, parent, outside, doubt, self.paths)
        self.elements.append(element)
        self.open[tag] += 1
        return element

    def close_to(self, element: Element) -> None:
        """Close everything up to and with the element."""
        while self.here is not element.parent:
            self.open[self.here.tag] -= 1
            self.here = self.here.parent

    def end(self, tag: str) -> None:
        """A closing tag ends the nearest such element; inline ones don't reach beyond their container."""
        element = self.here if self.open[tag] else self.top
        while element is not self.top and element.tag != tag:
            if tag in INLINE and element.tag in CONTAINERS:
                return
            element = element.parent
        if element is not self.top:
            self.close_to(element)

    def imply_ends(self, tag: str) -> None:
        ends, element, last = ENDS.get(tag, ()), self.here, None
        while ends and element is not self.top and (element.tag in ends or element.tag not in CONTAINERS):
            if element.tag in ends:
                last = element
            element = element.parent
        if last is not None:
            self.close_to(last)

    def apart(self, tag: str, attributes: str) -> tuple[bool, int]:
        """Whether the element is no part of an article for sure, and the doubt that its names cast on it."""
        if tag in OUTSIDE and not (tag == "header" and (self.open["article"] or self.open["main"])):
            return True, 0
        if not attributes or tag in ("html", "body"):
            return False, 0
        values = {k.lower(): a or b or c for k, a, b, c in reversed(ATTRIBUTE.findall(attributes))}
        if ("hidden" in values and values["hidden"].lower() != "until-found"
                or values.get("aria-hidden", "").lower() == "true" or UNSEEN.search(values.get("style", ""))):
            return True, 0
        if tag in ("article", "main"):
            return False, 0
        doubt = 0
        for name in " ".join(values.get(k, "") for k in ("class", "id", "role")).split():
            words = set(re.split(r"[-_\d]+", name.lower()))
            if not words & LAYOUT:
                doubt = max(doubt, 2 if words & STRONG else 1 if words & WEAK else 0)
        return False, doubt


def smoothed(x: np.ndarray) -> np.ndarray:
    """Gaussian smoothing over reading order with a reach of two nodes."""
    kernel = np.exp(-np.arange(-2, 3) ** 2 / 2.0)
    weight = np.convolve(np.ones(len(x)), kernel, "same")
    return np.convolve(x, kernel, "same")[:len(x)] / weight[:len(x)] if len(x) >= 5 else x


def selected(texts: list[tuple[Element, str]], reach: float) -> np.ndarray:
    """Which text nodes the ratios of their tag paths select; each text has its white space in single spaces."""
    n, length, marks = defaultdict(int), defaultdict(int), defaultdict(int)
    for e, t in texts:
        n[e.path] += 1
        length[e.path] += len(t)
        marks[e.path] += len(PUNCTUATION.findall(t))
    by_length = smoothed(np.array([length[e.path] / n[e.path] for e, _ in texts]))
    by_marks = smoothed(np.array([marks[e.path] / n[e.path] for e, _ in texts]))
    fused = by_length * (by_marks + 0.1)
    return fused >= min(reach * fused.std(), fused.max())


def gather(parsed: Page, texts: list[tuple[Element, str]], chosen) -> None:
    """Characters of all and of the selected text nodes in each element."""
    for e in parsed.elements:
        e.chars = e.all = 0
    for (e, t), c in zip(texts, chosen):
        e.all += len(t)
        e.chars += len(t) if c else 0
    for e in reversed(parsed.elements):  # children come after their parents
        if e.parent is not None:
            e.parent.chars += e.chars
            e.parent.all += e.all


def leave_out_doubtful(parsed: Page) -> None:
    """Doubtful elements are outside if the selected text doesn't speak for them."""
    for e in parsed.elements:
        if e.parent is not None and e.parent.outside:
            e.outside = True
        elif e.doubt:
            e.outside |= 2 * e.chars <= (parsed.top.chars if e.doubt == 2 else e.all)


def article_of(parsed: Page) -> Element:
    """The article or main element with most of the selected text, or else the lowest one with all of it."""
    for tag in ("article", "main"):
        best = max((e for e in parsed.elements if e.tag == tag and not e.outside), key=lambda e: e.chars, default=None)
        if best is not None and 2 * best.chars > parsed.top.chars:
            return best
    return max((e for e in parsed.elements if e.tag in SECTIONS and e.chars == parsed.top.chars), key=lambda e: e.depth)


def title_at(kept: list[tuple[Element, str, int]]) -> tuple[int, int]:
    """Places of the text with which the article starts, which may be the heading before it, and of its own first.

    Headings are looked for where the article has none of that rank.
    """
    inside = [i for i, (e, _, _) in enumerate(kept) if e.inside]
    ranks = {kept[i][0].heading for i in inside}
    for tag in ("h1", "h2"):
        before = [i for i, (e, t, _) in enumerate(kept[:inside[0]]) if e.heading == tag and t.strip()]
        if tag in ranks:
            break
        if before:
            return min(i for i in before if kept[i][2] == kept[before[-1]][2]), inside[0]
    return inside[0], inside[0]


def main_text(page: str, reach: float = 0.5) -> str:
    """The article of a page as blocks joined by blank lines; empty if there is none.

    `reach` is the share of the standard deviation of fused ratios that content must have. On a page
    without a container, blocks of nothing but links before or after all content are its menu.
    """
    parsed = Page(page)
    kept = [(e, entities.unescape(t) if "&" in t else t, b) for e, t, b in parsed.texts if not e.outside]
    flat = [" ".join(t.split()) for _, t, _ in kept]
    if any(e.doubt for e in parsed.elements) and any(flat):
        some = [(e, t) for (e, _, _), t in zip(kept, flat) if t]
        gather(parsed, some, selected(some, reach))
        leave_out_doubtful(parsed)
        flat = [t for (e, _, _), t in zip(kept, flat) if not e.outside]
        kept = [x for x in kept if not x[0].outside]
    real = [(e, t, b) for (e, _, b), t in zip(kept, flat) if t]
    if not real:
        return ""
    chosen = selected([(e, t) for e, t, _ in real], reach)
    # smoothing reaches into menus, so links widen the article only where nothing else is selected
    plainly = [c and not e.linked for (e, _, _), c in zip(real, chosen)]
    if not any(plainly):
        plainly = chosen
    gather(parsed, [(e, t) for e, t, _ in real], plainly)
    article = article_of(parsed)
    for e in parsed.elements:
        e.inside = e is article or bool(e.parent and e.parent.inside)
    start, own = title_at(kept)
    blocks_of = {b for (_, _, b), c in zip(real, plainly) if c}
    first, last = min(blocks_of), max(blocks_of)
    loose = article.tag in ("", "html", "body")
    parts, plain = defaultdict(list), set()
    for i, (e, t, b) in enumerate(kept):
        if e.inside or start <= i < own:
            parts[b].append(t)
            if t.strip() and not e.linked:
                plain.add(b)
    blocks = []
    for b in sorted(parts):
        text = " ".join("".join(parts[b]).split())
        if text and (b in plain or not loose or first <= b <= last):
            blocks.append(text)
    return "\n\n".join(blocks)


def extracted(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page; null and empty html give an empty text.

    Repeated rows give repeated rows, an empty table none. Pages of any length are read whole, each by itself, in time
    that grows with their length, broken mark-up too. Other columns are left out, whatever their names.
    """
    ship(pages.sparkSession)

    @F.pandas_udf("string")
    def text_of(page: pd.Series) -> pd.Series:
        return pd.Series([main_text(p or "") for p in page], dtype=object)

    return only(pages, id, url, html).toDF("page_id", "url", "html").select(
        "page_id", "url", text_of("html").alias("text")).withColumn(
        "n_chars", F.length("text").cast("bigint"))
