"""Main text of HTML pages by text-to-tag ratio (operator 4).

The standard library's parser streams through a page once. A line is the text of one block;
its ratio is its characters over the tags met in and around it. The ratios are smoothed along
the page with a Gaussian, and lines whose smoothed ratio reaches a threshold form the content
cluster. The innermost element that leaves out no line of the cluster and no heading, or the first article or
main on the way to it, is the content region: all its blocks are kept, short ones too. Blocks within elements that by their name or their
class, id or role are menus, page headers, footers, sidebars, notices, adverts, forms or
reader comments count as zero and are never kept; nor is the text of inline elements that are hidden or named as adverts.
Within an article, a name may be that of the article's subject: unless it is an advert's, an element so named is left out only if much of its text is links or
none of its lines is in the cluster by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ids, slices, strings

#: Standard deviation of the smoothing, in lines.
SIGMA = 1.5
#: Share of the mean smoothed ratio from which a line is in the content cluster.
LEVEL = 0.5

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template noscript head title svg math iframe object select textarea button datalist canvas audio video".split())
BOILER = frozenset("nav footer aside form menu dialog".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose open tag ends these open ones.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banners?|sidebars?|side-?bar|menus?|nav|navbar|navigation|breadcrumbs?|footers?|site-?header|page-?header|masthead|topbar|cookies?|consent|notices?|alerts?|popups?|modal|overlay|subscribe|subscription|newsletter|signup|login|related|recommended|share|sharing|social|widgets?|pagination|pager|skip|complementary|contentinfo)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: Share of an element's characters that are links, from which a doubtful name is believed.
LINKED = 1 / 3
#: Names that are believed within articles too.
_FIRM = re.compile(r"(?:^|\s)(?:ads?|advert\w*|ad-\w+|adsense|sponsor\w*|promo\w*|banners?|cookies?|consent|popups?|modal|overlay|subscribe|subscription|newsletter)(?:$|\s)", re.IGNORECASE)
#: An article of its own that is an advert or a teaser.
_TEASER = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsored|promo|related|recommended|teaser)(?:$|[\s_-])", re.IGNORECASE)
_HEADER = re.compile(r"(?:^|\s)header(?:\s|$)", re.IGNORECASE)
_COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|comment\w+|disqus\w*|replies|reply|respond|responses)(?:$|[\s_-])", re.IGNORECASE)


#: Names that mark boilerplate around an article, but may name a part of one.
_OUTER = re.compile(r"(?:^|[\s_-])(?:copyright|legal|disclaimer|search)(?:$|[\s_-])", re.IGNORECASE)
_NO_DISPLAY = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


class _Page(HTMLParser):
    """Lines of a page and its tree of elements. Every step is amortised over the tags, however deep they nest."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int]] = []
        self.open: dict[str, int] = {}  # open elements by name
        # of each element: parent, name, whether boilerplate, reader comments, within an article, its way up cleared
        self.parent, self.name, self.boiler, self.comments, self.inside, self.freed = [-1], [""], [False], [False], [False], [True]
        self.doubt = [False]  # by its name boilerplate, but within an article
        self.lines: list[tuple[str, int, int]] = []  # text, tags, element
        self.linked: list[int] = []  # characters of each line that are links, white space apart
        self.links = 0
        self.link: int | None = None  # depth of the stack at an open link
        self.text: list[str] = []
        self.tags = 0
        self.unseen = 0
        self.inline: tuple[str, int, int] | None = None  # an open inline element that is not shown: name, its own kind in it, depth of the stack

    def flush(self) -> None:
        line = " ".join("".join(self.text).split())
        self.text.clear()
        if line:
            self.lines.append((line, self.tags, self.stack[-1][1] if self.stack else 0))
            self.linked.append(self.links)
            self.tags = 0
        self.links = 0

    def _push(self, tag: str, element: int) -> None:
        self.stack.append((tag, element))
        self.open[tag] = self.open.get(tag, 0) + 1

    def _pop(self) -> None:
        tag, _ = self.stack.pop()
        self.open[tag] -= 1
        self.unseen -= tag in UNSEEN
        if self.inline and len(self.stack) < self.inline[2]:
            self.inline = None
        if self.link is not None and len(self.stack) < self.link:
            self.link = None

    @staticmethod
    def _said(attrs: list[tuple[str, str | None]]) -> tuple[str, bool]:
        """An element's class, id and role, and whether it is hidden."""
        said = dict(attrs)
        words = " ".join(filter(None, (said.get("class"), said.get("id"), said.get("role"))))
        return words, "hidden" in said or said.get("aria-hidden") == "true" or bool(_NO_DISPLAY.search(said.get("style") or ""))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag in ("br", "img", "wbr"):
                self.text.append("" if tag == "wbr" else " ")
            return
        if tag in UNSEEN:
            self.unseen += 1
            self._push(tag, self.stack[-1][1] if self.stack else 0)
            return
        if tag == "body" and self.unseen:
            self._leave_unseen()
        if tag == "a":
            self.link = len(self.stack)
        if tag not in BLOCK:
            if self.inline:
                if self.inline[0] == tag:
                    self.inline = tag, self.inline[1] + 1, self.inline[2]
            elif attrs:
                words, hidden = self._said(attrs)
                if hidden or (words and _TEASER.search(words)):
                    self.inline = tag, 1, len(self.stack)
            return
        self.flush()
        if self.stack and self.stack[-1][0] == "p":
            self._pop()
        for closed in CLOSES.get(tag, ()):
            if self.stack and self.stack[-1][0] == closed:
                self._pop()
        words, hidden = self._said(attrs) if attrs else ("", False)
        talk = bool(words and _COMMENTS.search(words))
        up = self.stack[-1][1] if self.stack else 0
        inside = self.inside[up] or self.name[up] in ("article", "main")
        whole = tag in ("html", "body", "article", "main")
        boiler = tag in BOILER or hidden or (not inside and (tag == "header" or bool(words and not whole and _HEADER.search(words))))
        doubt = False
        if words and not boiler:
            hint = not whole and bool(_HINT.search(words))
            doubt = hint and inside and not _FIRM.search(words)
            boiler = bool(_TEASER.search(words)) if tag == "article" else hint and not doubt or (not whole and not inside and bool(_OUTER.search(words)))
        if tag == "p" and not boiler and not talk and not doubt:
            return  # its text is its parent's
        if tag in ("article", "main") and not talk and not boiler:
            self._free(up)
        self.parent.append(up)
        self.name.append(tag)
        self.boiler.append(boiler)
        self.comments.append(talk)
        self.doubt.append(doubt)
        self.inside.append(inside)
        self.freed.append(False)
        self._push(tag, len(self.name) - 1)

    def _leave_unseen(self) -> None:
        """The body begins: a head, title or style that was left open ends."""
        kept = [s for s in self.stack if s[0] not in UNSEEN]
        while self.stack:
            self._pop()
        for s in kept:
            self._push(*s)

    def _free(self, at: int) -> None:
        """An element around an article, as a form around a page or an advert left open, is no boilerplate."""
        while at > 0 and not self.freed[at]:
            self.freed[at] = True
            if self.name[at] not in ("nav", "aside", "footer"):
                self.boiler[at] = False
            at = self.parent[at]

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        elif tag == "a":
            self.link = None
        if tag not in BLOCK and self.inline and self.inline[0] == tag:
            self.inline = (tag, self.inline[1] - 1, self.inline[2]) if self.inline[1] > 1 else None
        if (tag in BLOCK or tag in UNSEEN) and self.open.get(tag):
            while self.stack[-1][0] != tag:
                self._pop()
            self._pop()

    def handle_data(self, data: str) -> None:
        if not self.unseen and not self.inline:
            self.text.append(data)
            if self.link is not None:
                self.links += len("".join(data.split()))


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing along the lines, the edges held."""
    reach = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def main_text(html: str) -> str:
    """The main text of one page, its blocks joined by newlines; empty where there is none."""
    page = _Page()
    page.feed(html)
    page.close()
    page.flush()
    if not page.lines:
        return ""
    barred = [False] * len(page.name)
    for k in range(1, len(page.name)):  # parents come before their children
        barred[k] = barred[page.parent[k]] or page.boiler[k] or page.comments[k]
    open_lines = [x for x in page.lines if not barred[x[2]]]
    if not open_lines:
        return ""
    ratios = smoothed(np.array([0.0 if barred[e] else len(t) / max(1, n) for t, n, e in page.lines]))
    kept = np.array([not barred[e] for _, _, e in page.lines])
    cluster = kept & (ratios >= LEVEL * ratios[kept].mean())
    if any(page.doubt):
        # characters, linked ones, and lines in the cluster that are not there for their neighbours alone
        least = LEVEL * ratios[kept].mean()
        chars, linked, dense = ([0] * len(page.name) for _ in range(3))
        for (t, tags, e), n, is_dense in zip(page.lines, page.linked, cluster, strict=True):
            chars[e] += len(t.replace(" ", ""))
            linked[e] += n
            dense[e] += bool(is_dense and len(t) >= least * max(1, tags))
        for k in range(len(page.name) - 1, 0, -1):
            for sums in (chars, linked, dense):
                sums[page.parent[k]] += sums[k]
        for k in range(1, len(page.name)):
            barred[k] = barred[k] or barred[page.parent[k]] or (page.doubt[k] and (not dense[k] or linked[k] >= LINKED * chars[k]))
        kept &= np.array([not barred[e] for _, _, e in page.lines])
        cluster &= kept
        if not kept.any():
            return ""
    needed = [0] * len(page.name)
    for (_, _, e), inside, is_open in zip(page.lines, cluster, kept, strict=True):
        needed[e] += bool(inside or (is_open and page.name[e] in ("h1", "h2", "h3", "h4", "h5", "h6")))
    for k in range(len(page.name) - 1, 0, -1):
        needed[page.parent[k]] += needed[k]
    region = 0
    for k in range(1, len(page.name)):  # the innermost is the last that its parent's region leads to
        if needed[k] == needed[0] and page.parent[k] == region and page.name[region] not in ("article", "main") and page.name[k] not in ("li", "td", "th", "tr", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "ul", "ol", "table", "tbody"):
            region = k
    inside = [False] * len(page.name)
    inside[region] = True
    for k in range(region + 1, len(page.name)):
        inside[k] = inside[page.parent[k]]
    return "\n".join(t for t, _, e in page.lines if inside[e] and not barred[e])


def html_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for ``pages(page_id, url, html)``.

    A null or empty page, and a page with nothing but boilerplate, has an empty text. Repeated
    rows and nulls in the other columns stay as they are; further columns are not read; an empty table
    gives no rows. Pages are parsed whole; broken markup is read as far as the parser makes sense of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(h) for h in strings(batch, "html")]
            yield pa.RecordBatch.from_arrays([ids(batch, "page_id"), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
