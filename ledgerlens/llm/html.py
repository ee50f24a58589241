"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block element; elements that never hold an article (head,
navigation, footers, asides, forms, scripts) leave no line. The text lengths of a line and the next
ones are summed over a sliding window. The text surges where a window passes the threshold at a line
with text, and dives where the windows have run out. These points decide on every page. Article and
main elements are a weight only: on a page that has them, text outside counts half, and link text
inside counts as text, which it does nowhere else.

Every line between a surge and its dive is kept, whatever its links. So are headings, paragraphs and
lines of an article right before or after that lie in the innermost element common to the block, and
lines between two blocks that lie in an element (not the body) common to both.

Elements whose whole class, id or role names an extra (an advert, comments, ..) are dropped, articles
too, unless they hold long text and hardly any is left outside, or hold an article and most of the text.
End tags of p, li, dt, dd, tr, td, th and option are implied as browsers do.

A null or empty page has the empty text. Blocks are joined by an empty line; white space inside a
block is one space. Unclosed and stray tags are tolerated, character references are decoded.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerlens.llm.common import small_batches, whole

WINDOW = 3
SURGE = 80
DIVE_SHARE = 0.1
OUTSIDE = 0.5

# Element names and hints.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section summary table tbody tfoot thead "
    "tr ul".split()
)
SPACES = frozenset("br td th wbr".split())
DROPPED = frozenset(
    "head title script style noscript template nav footer aside form button select textarea svg math iframe object "
    "canvas menu dialog audio video".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
REGIONS = frozenset(("article", "main"))
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus discussion dropdown footer masthead menu modal nav navbar navigation newsletter notice notices "
    "pager pagination popup promo promotion related replies respond search share sharing sidebar signup social "
    "sponsor sponsored subscribe toolbar widget contentinfo complementary".split()
)
_EXTRA = "|".join(sorted(HINTS))
# A whole name: the hint alone, with a word for a part of a page before it, or one for a container after it.
_HINT = re.compile(
    rf"(?:(?:article|bottom|footer|main|page|post|reader|site|social|top|user)[-_])?(?:{_EXTRA})"
    rf"(?:[-_](?:area|articles|bar|block|box|button|buttons|container|content|form|item|items|link|links|list|menu|message|"
    rf"overlay|panel|posts|section|slot|thread|unit|widget|wrap|wrapper))?"
)
_WHITE = re.compile(r"\s+")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = _HEADINGS | frozenset(("p", "pre", "blockquote"))

# Which open elements a start tag ends, and which elements it does not look beyond.
_TABLE = frozenset(("table", "template", "html"))
_LISTS = BLOCKS - frozenset(("address", "div", "p", "li", "dt", "dd"))
_ROWS, _CELLS = frozenset(("tr",)), frozenset(("td", "th"))
_ENDS: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset(("li",)), _LISTS),
    "dt": (frozenset(("dt", "dd")), _LISTS),
    "dd": (frozenset(("dt", "dd")), _LISTS),
    "td": (_CELLS, _TABLE | _ROWS),
    "th": (_CELLS, _TABLE | _ROWS),
    "tr": (_ROWS, _TABLE | frozenset(("tbody", "thead", "tfoot"))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    **{t: (frozenset(("tbody", "thead", "tfoot")) | _ROWS, _TABLE) for t in ("tbody", "thead", "tfoot")},
}
_ENDS_P = BLOCKS - frozenset(("body", "html", "caption", "tbody", "thead", "tfoot", "tr", "legend", "summary"))
_P_SCOPE = frozenset("td th caption table html button object template marquee".split())


class Line(NamedTuple):
    text: str
    linked: int  # characters of link text
    inside: bool  # an article or main element
    tag: str  # the innermost block
    path: tuple[int, ...]  # the blocks that can hold others around it, outermost first
    hints: tuple[int, ...]  # those of them that are named as an extra


class _Lines(HTMLParser):
    """Collects a line per block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, bool, int, bool]] = []  # name, whether dropped, number, whether a hint
        self.articles: set[int] = set()  # hinted elements that hold an article which is none
        self.dropped = self.region = self.linked = self.hinted = self.number = 0
        self.parts: list[str] = []
        self.link_chars = 0

    def flush(self) -> None:
        text = _WHITE.sub(" ", "".join(self.parts)).strip()
        if text:
            around = [(name, i) for name, _, i, _ in self.open if name in BLOCKS and name not in ("html", "body")]
            hints = tuple(i for _, _, i, hint in self.open if hint) if self.hinted else ()
            tag, path = around[-1][0] if around else "", tuple(i for name, i in around if name not in PROSE)
            self.lines.append(Line(text, min(self.link_chars, len(text)), self.region > 0, tag, path, hints))
        self.parts, self.link_chars = [], 0

    def _unwanted(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in DROPPED or (tag == "header" and not self.region):
            return True
        return any(name == "hidden" or (name == "aria-hidden" and value == "true") for name, value in attrs) and tag not in ("html", "body")

    @staticmethod
    def _hint(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in ("html", "body", "main"):
            return False
        names = [n for name, value in attrs if name in ("class", "id", "role") and value for n in value.lower().split()]
        return any(_HINT.fullmatch(n) for n in names)

    def _close(self, at: int) -> None:
        for name, drop, _, hint in self.open[at:]:
            self.dropped -= drop
            self.region -= name in REGIONS
            self.linked -= name == "a"
            self.hinted -= hint
        del self.open[at:]

    def _imply(self, names: frozenset[str], stops: frozenset[str]) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] in names:
                if not self.dropped:
                    self.flush()
                self._close(at)
                return
            if self.open[at][0] in stops:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _ENDS_P:
            self._imply(frozenset(("p",)), _P_SCOPE)
        if tag in _ENDS:
            self._imply(*_ENDS[tag])
        if tag in SPACES:
            self.parts.append(" ")
        elif tag in BLOCKS and not self.dropped:
            self.flush()
        if tag in VOID:
            return
        if tag == "body":  # whatever the head left open ends here
            self.open, self.dropped, self.region, self.linked, self.hinted = [], 0, 0, 0, 0
        drop, hint = self._unwanted(tag, attrs), self._hint(tag, attrs)
        if tag in REGIONS and not hint and self.hinted:
            self.articles.update(i for _, _, i, is_hint in self.open if is_hint)
        self.number += 1
        self.open.append((tag, drop, self.number, hint))
        self.dropped += drop
        self.region += tag in REGIONS
        self.linked += tag == "a"
        self.hinted += hint

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS and not self.dropped:
            self.flush()
        at = len(self.open) - 1
        while at >= 0 and self.open[at][0] != tag:
            at -= 1
        if at >= 0:
            self._close(at)

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.parts.append(data)
            if self.linked:
                self.link_chars += len(data)


def _without_extras(lines: list[Line], articles: set[int], surge: int) -> list[Line]:
    """Drops the lines of hinted elements, unless an element turns out to be what holds the text."""
    stay: set[int] = set()
    own: dict[int, int] = {}
    for line in lines:
        for i in line.hints:
            own[i] = own.get(i, 0) + len(line.text) - line.linked
    for i in sorted(own):  # outer elements first
        outside = sum(len(x.text) - x.linked for x in lines if stay.issuperset(x.hints))
        if own[i] >= surge and (outside < surge or (i in articles and own[i] > outside)):
            stay.add(i)
    return [x for x in lines if stay.issuperset(x.hints)]


def page_lines(html: str, surge: int = SURGE) -> list[Line]:
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    return _without_extras(parser.lines, parser.articles, surge)


def _common(lines: list[Line]) -> int | None:
    """The innermost element around all the lines."""
    path = lines[0].path
    for x in lines[1:]:
        n = 0
        while n < min(len(path), len(x.path)) and path[n] == x.path[n]:
            n += 1
        path = path[:n]
    return path[-1] if path else None


def main_lines(lines: list[Line], window: int = WINDOW, surge: int = SURGE) -> list[str]:
    """The lines between the surge and dive points of the text lengths."""
    region = any(x.inside for x in lines)
    lengths = [len(x.text) if x.inside else (len(x.text) - x.linked) * (OUTSIDE if region else 1) for x in lines]
    n = len(lines)
    total = [0.0]
    for x in lengths:
        total.append(total[-1] + x)
    sums = [total[min(i + window, n)] - total[i] for i in range(n)]
    rise = min(surge, max(sums, default=0) // 2 + 1)
    fall = rise * DIVE_SHARE
    found: list[list[int]] = []
    i = 0
    while i < n:
        if lengths[i] and sums[i] >= rise:
            end = i
            while end < n and sums[end] > fall:
                end += 1
            while end > i and not lengths[end - 1]:
                end -= 1
            found.append([i, end])
            i = end
        else:
            i += 1

    def belongs(x: Line, element: int | None) -> bool:
        return element in x.path and (x.inside or x.tag in PROSE)

    blocks: list[list[int]] = []
    for start, end in found:
        if blocks:
            last = blocks[-1]
            both = _common([lines[last[1] - 1], lines[start]])
            if both is not None and all(both in x.path for x in lines[last[1] : start]):
                last[1] = end
                continue
        blocks.append([start, end])
    reached = 0
    for i, block in enumerate(blocks):
        following = blocks[i + 1][0] if i + 1 < len(blocks) else n
        around = _common(lines[block[0] : block[1]])
        while block[0] > reached and belongs(lines[block[0] - 1], around):
            block[0] -= 1
        while block[1] < following and belongs(lines[block[1]], around):
            block[1] += 1
        reached = block[1]
    return [x.text for start, end in blocks for x in lines[start:end]]


def extract_text(html: str) -> str:
    return "\n\n".join(main_lines(page_lines(html)))


@F.pandas_udf(StringType())
def main_text(pages: pd.Series) -> pd.Series:
    return pd.Series([extract_text(p) for p in pages], dtype=object)


def extract_pages(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the main text of the html."""
    small_batches(pages.sparkSession)
    return pages.withColumn(text, main_text(whole(html)))
