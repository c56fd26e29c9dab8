"""Main text of web pages: parser events to lines, text-to-tag ratios, Gaussian smoothing, a threshold, the region it selects."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Elements of the HTML standard by their role.
HIDDEN = frozenset("script style template noscript head title svg math iframe object canvas audio video map datalist textarea select button".split())
FRAME = frozenset("nav footer aside form dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output progress q rp rt ruby s samp small span strike strong sub "
    "sup time tt u var wbr".split()
)
REGIONS = frozenset("article main section div body td".split())
CONTENT = frozenset(("article", "main"))
# Closed by the end or the start of another element, as their end tags may be left out.
LOOSE = frozenset("p li dt dd td th tr option".split())
# Elements never shown that an article or main inside shows to lack their end tag.
BROKEN = frozenset("object canvas audio video map datalist select button".split())
# Whole tokens of a class, id or role that mark a frame around the main text.
MARKS = frozenset(
    "ad ads advert advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice notices alert popup modal overlay newsletter "
    "subscribe signup login search breadcrumb breadcrumbs menu nav navbar navigation topbar sidebar side widget rail toolbar header masthead footer copyright "
    "comment comments commentlist disqus reply replies respond discussion related recommended share sharing social pagination pager skip "
    "ad-banner ad-container ad-slot cookie-banner cookie-notice cookie-consent site-header site-footer site-nav page-footer main-nav main-menu nav-menu "
    "side-bar skip-link search-form comment-list comments-area comment-section related-posts related-articles share-buttons social-share contentinfo complementary".split()
)
# Marks and elements that hold what others wrote or other pages: an article in them is not the page's own.
OTHERS = frozenset("comment comments commentlist disqus reply replies respond discussion related recommended comment-list comments-area comment-section related-posts related-articles".split())
ASIDE = FRAME - {"form"}
# Marks that also name sections of a text: no frame as the id of a section.
TITLES = frozenset(
    "advertising promotion consent cookies notice notices alert search navigation copyright comment reply replies discussion related recommended share sharing social pagination login".split()
)
HEADINGS = frozenset("h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("title meta link script style base noscript template".split())
_SPACE = re.compile(r"\s+")


class Lines(HTMLParser):
    """Turns parser events into lines: the text between two block boundaries, its number of tags and its region.

    Elements that never show are left out with all they hold. Frames (navigation, footers, sidebars, forms, page headers
    and elements marked as such by class, id or role) are regions of their own; :func:`settled` decides what they take
    away when the whole page is known.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []  # element and its region
        self.left_out = -1  # depth of the outermost element left out, or -1
        self.parents = [-1]  # region tree; region 0 is the page
        self.kinds = [""]
        self.barriers = [0]  # 0: no frame, 1: a frame, 2: a frame of what is not the page's own
        self.ended = [True]  # by an end tag of its own
        self.starts = [0]  # lines before
        self.text: list[str] = []
        self.tags = 0
        self.lines: list[tuple[str, int, int]] = []  # text, tags, region

    def region(self) -> int:
        return self.open[-1][1] if self.open else 0

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.lines.append((text, self.tags, self.region()))
        self.text, self.tags = [], 0

    def barrier(self, tag: str, attributes) -> int:
        if tag in FRAME:
            return 2 if tag in ASIDE else 1
        if tag == "header":
            return int(not any(t in CONTENT for t, _ in self.open))
        if tag in ("html", "body", "main", "article", "h1"):
            return 0
        found = 0
        for name, value in attributes:
            if name in ("class", "id", "role") and value:
                marks = MARKS.intersection(value.lower().split())
                if marks and name == "id":
                    if tag in HEADINGS or tag == "section" and any(t in CONTENT for t, _ in self.open):
                        continue
                    if tag == "section":
                        marks -= TITLES
                if marks:
                    found = max(found, 1 if marks.isdisjoint(OTHERS) else 2)
            if name == "hidden" or name == "aria-hidden" and value == "true":
                found = max(found, 1)
        return found

    def handle_starttag(self, tag, attributes):
        if self.left_out >= 0:
            outer = self.open[self.left_out][0]
            if outer == "head" and tag not in IN_HEAD and len(self.open) == self.left_out + 1:
                self.close(self.left_out)  # the end tag of the head may be left out
            elif tag in CONTENT and outer in BROKEN:
                self.close(self.left_out)
        if self.left_out < 0:
            self.tags += 1
            if tag not in INLINE:
                self.flush()
        if tag in VOID:
            return
        if tag in LOOSE and self.open and self.open[-1][0] == tag:
            self.close(len(self.open) - 1)
        region = self.region()
        if self.left_out < 0:
            barrier = 0
            if tag in HIDDEN:
                self.flush()
                self.left_out = len(self.open)
            elif (barrier := self.barrier(tag, attributes)) or tag in REGIONS:
                if barrier:
                    self.flush()
                self.parents.append(region)
                self.kinds.append(tag)
                self.barriers.append(barrier)
                self.ended.append(tag in LOOSE)
                self.starts.append(len(self.lines))
                region = len(self.parents) - 1
        self.open.append((tag, region))

    def handle_startendtag(self, tag, attributes):
        self.handle_starttag(tag, attributes)
        if tag not in VOID:
            self.handle_endtag(tag)

    def close(self, depth: int | None = None):
        if depth is None:
            return super().close()
        if self.left_out < 0 and any(self.barriers[r] for _, r in self.open[depth:]):
            self.flush()
        del self.open[depth:]
        if self.left_out >= len(self.open):
            self.left_out = -1

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == tag:
                break
            if self.open[depth][0] in CONTENT and tag in INLINE | LOOSE:
                return  # a stray end tag does not end the article
        else:
            return
        above = self.open[depth - 1][1] if depth else 0
        if self.left_out < 0:
            if tag in INLINE and any(self.barriers[r] and r != self.open[depth][1] for _, r in self.open[depth + 1 :]):
                return
            self.tags += 1
            if tag not in INLINE:
                self.flush()
        elif tag in INLINE and depth < self.left_out:
            return
        if self.open[depth][1] != above:
            self.ended[self.open[depth][1]] = True
        self.close(depth)

    def handle_data(self, data):
        if self.left_out < 0:
            self.text.append(data)


def settled(parser: Lines, weights: np.ndarray) -> tuple[list[tuple[str, int, int]], list[int]]:
    """The lines that no frame takes away, and the article and main elements that hold the page's text.

    ``weights`` is the clustered text of every region and those in it. The start of an article or main ends the frames
    around it that have no end tag, and other frames if no article or main outside frames has text (or less text than
    it); in a frame of what is not the page's own it counts only if it outweighs all text outside frames. Without such
    elements a frame that holds most of the clustered text is none, navigation, footers and the like apart unless their
    end tag is missing; in such elements, a frame that holds most of theirs.
    """
    parents, kinds, barriers, ended = parser.parents, parser.kinds, parser.barriers, parser.ended
    n = len(parents)
    size = np.zeros(n)
    for text, _, region in parser.lines:
        size[region] += len(text)
    level, cut, home = [0] * n, np.zeros(n, bool), [-1] * n  # home: the innermost article or main
    for r in range(1, n):
        content = kinds[r] in CONTENT
        level[r] = max(level[parents[r]], barriers[r] if ended[r] else 0)
        home[r] = r if content else home[parents[r]]
        cut[r] = not content and (bool(barriers[r]) or cut[parents[r]])
    own = [0.0, 0.0, 0.0]  # text of articles and mains by the strongest frame around them
    for r in range(n):
        if home[r] >= 0 and not cut[r]:
            own[level[home[r]]] += size[r]
    free = sum(size[r] for r in range(n) if home[r] < 0 and not cut[r])
    if own[0]:
        most = 1 if own[1] > own[0] else 0
    elif own[1]:
        most = 1
    else:
        most = 2 if own[2] and own[2] >= free else -1
    content = [r for r in range(n) if kinds[r] in CONTENT and level[r] <= most]
    chosen, last = set(content), len(parser.lines)
    first = [last] * n  # lines before the first chosen element in a region
    for r in range(n - 1, 0, -1):
        first[parents[r]] = min(first[parents[r]], first[r], parser.starts[r] if r in chosen else last)
    since = [0] * n  # the line from which on a region's lines stay
    for r in range(1, n):
        if kinds[r] in CONTENT:
            since[r] = 0 if r in chosen else last
            continue
        since[r] = since[parents[r]]
        if not barriers[r] or since[r] == last:
            continue
        if first[r] < last:  # holds such an element: whole, or up to its start if the end tag is missing
            since[r] = since[r] if ended[r] and barriers[r] == 1 else last if ended[r] else first[r]
        elif home[r] in chosen:
            soft = barriers[r] == 1 or not ended[r]
            since[r] = since[r] if soft and 2 * weights[r] > weights[home[r]] else last
        else:
            soft = kinds[r] not in ASIDE or not ended[r]
            since[r] = since[r] if soft and 2 * weights[r] > weights[0] else last
    return [line for i, line in enumerate(parser.lines) if i >= since[line[2]]], content


def smoothed(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing with the borders repeated."""
    reach = max(1, int(np.ceil(3 * sigma)))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(values, reach, mode="edge"), weights / weights.sum(), mode="valid")


def clustered(lines: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the lines, and which are at or above the mean of the smoothed text-to-tag ratios."""
    sizes = np.array([len(text) for text, _, _ in lines], float)
    ratios = smoothed(sizes / np.maximum(1, [tags for _, tags, _ in lines]))
    return sizes, ratios >= ratios.mean() * (1 - 1e-9)  # the mean of equal ratios may be rounded up


def weighed(parents: list[int], lines: list[tuple[str, int, int]]) -> np.ndarray:
    """The clustered text of every region and those in it."""
    total = np.zeros(len(parents))
    for size, picked, (_, _, region) in zip(*clustered(lines), lines):
        if picked:
            total[region] += size
    for region in range(len(total) - 1, 0, -1):  # children come after their parents
        total[parents[region]] += total[region]
    return total


def main_text(html: str | None) -> str:
    """The main text of a page; empty for null, empty or text-free html.

    Frames are cut away (:func:`settled`). All article and main elements with text are the region, if there are any.
    Otherwise the lines at or above the mean of the smoothed text-to-tag ratios form the content clusters, and the
    smallest element that holds all of them is the region (for a section among others, what they are sections of).
    Every line of the region is kept, so short paragraphs and headings stay.
    """
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    if not parser.lines:
        return ""
    lines, content = settled(parser, weighed(parser.parents, parser.lines))
    if not lines:
        return ""
    parents = parser.parents
    held = np.zeros(len(parents), bool)
    for _, _, region in lines:
        while region >= 0 and not held[region]:
            held[region] = True
            region = parents[region]
    marked = [r for r in content if held[r]]
    if not marked:
        total = weighed(parents, lines)
        region = int(np.flatnonzero(total == total[0])[-1])  # whole numbers: equal sums are the same clusters
        while parser.kinds[region] == "section" and any(held[r] and r != region and parents[r] == parents[region] and parser.kinds[r] == "section" for r in range(len(parents))):
            region = parents[region]
        marked = [region]
    inside = np.zeros(len(parents), bool)
    for region in range(len(parents)):
        inside[region] = region in marked or (region > 0 and inside[parents[region]])
    return " ".join(text for text, _, region in lines if inside[region])


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without the html and with ``text`` (main text) and ``n_chars`` (its code points); one page in memory at a time.

    Extra columns stay; input columns named text or n_chars are replaced. An empty table gives no rows.
    """
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    schema = pages.select(*kept).schema.add("text", "string").add("n_chars", "long")

    def run(batches):
        from strata.llm.tokens import slices

        for batch in batches:
            for part in slices([batch], html):
                texts = [main_text(h) for h in part.column(html).to_pylist()]
                columns = [part.column(c) for c in kept] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "text", "n_chars"])

    return pages.select(*kept, html).mapInArrow(run, schema)
