"""Main text of web pages by text-to-tag ratios."""

from __future__ import annotations

import functools
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgemart.llm.scratch import map_texts

#: Fixed values of HTML: elements without content, elements that start a block, and elements that
#: never hold the text of an article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html hr legend li main menu "
    "nav noscript ol option p pre search section select summary table tbody td template textarea "
    "tfoot th thead title tr ul".split()
)
APART = frozenset(
    "aside audio button canvas datalist dialog footer form head iframe input label menu nav "
    "noscript object script search select style svg template textarea title video".split()
)
ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split()
)
#: Class names and ids, as a whole, that mark what stands around an article.
MARKS = frozenset(
    "ad ads adslot advert adverts advertisement advertisements ad-banner ad-box ad-container ad-slot ad-unit "
    "ad-wrapper breadcrumb breadcrumbs commentlist comment-form comment-list comment-section comments "
    "comments-area comments-section post-comments cookie-banner cookie-bar cookie-consent cookie-notice "
    "cookie-popup disqus gdpr gdpr-banner main-footer page-footer site-footer main-menu site-menu masthead "
    "main-nav nav-bar nav-menu navbar page-nav site-nav newsletter-form newsletter-signup pager pagination "
    "popup respond share-bar share-buttons share-links sidebar side-bar sidebar-widget signup skip-link "
    "skip-links social-buttons social-icons social-links social-share teaser toc toolbar topbar".split()
)
#: The same for names that sections and paragraphs have after what they are about; these mark only
#: elements without a meaning of their own, and lists.
TOPICS = frozenset(
    "advertising banner comment consent cookie cookies disclaimer discussion footer menu menus modal nav "
    "navigation newsletter notice notices notification overlay privacy promo promoted promotion recommended "
    "recommended-articles recommended-posts related related-articles related-links related-posts "
    "related-stories replies reply share sharing skip social social-media sponsor sponsored subscribe "
    "subscription widget widgets".split()
)
PLAIN = frozenset("center details div dl fieldset ol table ul".split())
#: Of these, the names that an article element can have, and those of elements whose articles are
#: readers' comments.
REMARKS = frozenset("ad comment comment-body comment-content reply".split())
THREADS = frozenset(
    "commentlist comment-list comment-section comments comments-area comments-section discussion disqus "
    "post-comments replies respond".split()
)
#: Elements that hold blocks or text, or both, side by side.
AROUND = frozenset("body center div html section td th".split())
#: Elements that the next of their kind ends where the end tag is left out.
ITEMS = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "li": ("li",), "td": ("td", "th"), "th": ("td", "th")}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
STREAM = 1 << 14  # characters fed to the parser at a time


class Mark:
    """An element that a class or id marks as apart, unless it turns out to hold an article."""

    __slots__ = ("apart", "articles", "holds", "outer", "thread")

    def __init__(self, outer: Mark | None, articles: int, thread: bool):
        self.outer, self.articles, self.thread = outer, articles, thread
        self.apart = self.holds = False


class Line:
    """A block of the page: its text, the tags met in it, the element it is directly in, the article
    around it (0: none), whether it stands apart from any article by its elements, and the innermost
    mark around it."""

    __slots__ = ("apart", "article", "block", "mark", "parts", "tags")

    def __init__(self, article: int, apart: bool, mark: Mark | None, block: int):
        self.article, self.apart, self.mark, self.block = article, apart, mark, block
        self.parts: list[str] = []
        self.tags = 0

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


@functools.lru_cache(maxsize=4096)
def _marks(classes: str, name: str, tag: str) -> tuple[bool, bool]:
    """Whether class or id mark an element as apart, and as a thread of comments."""
    if tag in ("html", "body", "main") or tag in HEADINGS:
        return False, False
    classes = classes.replace("_", "-").split()
    names = {*classes, name.replace("_", "-").strip()}
    if tag == "article":
        return not REMARKS.isdisjoint(names), False
    marked = not MARKS.isdisjoint(names)
    if tag in PLAIN and "section" not in classes:
        marked = marked or not TOPICS.isdisjoint(names)
    return marked, marked and not THREADS.isdisjoint(names)


class Lines(HTMLParser):
    """Turns parser events into lines, one for each block of text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # tag; apart, article, innermost mark and block inside
        self.open: list[tuple[str, bool, int, Mark | None, int]] = [("", False, 0, None, 0)]
        # Of each block, by number in the order of their starts: its tag, the block around it, the
        # last block in it, and whether it may have loose text between blocks.
        self.tags, self.outer, self.last, self.loose = [""], [0], [0], [False]
        self.marks: list[Mark] = []
        self.articles = self.paragraphs = self.depth = 0  # depth: article elements open
        self.kinds = [""]  # of the open elements: the tag, or article or main by role
        self.line = Line(0, False, None, 0)
        self.lines = [self.line]

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers aren't needed

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        end = self.rawdata.find(">", i)  # HTML skips "<![" to the next ">", whatever it says
        return end + 1 if end >= 0 else -1

    def close(self) -> None:
        if re.match("<[a-zA-Z/!?]", self.rawdata):
            self.rawdata = ""  # a tag or comment that the page's end cuts off
        super().close()
        for *_, block in self.open:
            self.last[block] = len(self.last) - 1
        for mark in self.marks:  # outer ones come first
            mark.apart = not mark.holds or bool(mark.outer and mark.outer.apart)
        for line in self.lines:
            line.apart = line.apart or bool(line.mark and line.mark.apart)

    def _new_line(self) -> None:
        _, apart, article, mark, block = self.open[-1]
        self.line = Line(article, apart, mark, block)
        self.lines.append(self.line)

    def _holds(self, mark: Mark | None, kind: str) -> None:
        """Takes back the marks around an article, main or h1.

        An article inside an article is a remark on it, and so is one in a thread of comments.
        """
        marks = []
        while mark:
            if not mark.holds:
                if kind == "article" and (mark.articles or mark.thread):
                    return
                if kind == "h1" and mark.articles != self.depth:
                    return
                marks.append(mark)
            mark = mark.outer
        for mark in marks:
            mark.holds = True

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.line.parts.append("\n")
        if tag in VOID:
            if tag == "hr":
                self._new_line()
            self.line.tags += 1
            return
        if tag == "p":
            if self.paragraphs:
                self.handle_endtag("p")  # paragraphs don't nest
            self.paragraphs += 1
        _, apart, article, mark, block = self.open[-1]
        role = ""
        marked = thread = False
        if attrs and not apart:
            values = {k: (v or "").lower() for k, v in attrs}
            role = values.get("role", "")
            named = tag not in ("html", "body", "main", "h1") and role not in ("main", "article")
            apart = "hidden" in values or (named and role in ROLES)
            if "class" in values or "id" in values:
                kind = "main" if role == "main" else "article" if role == "article" else tag
                marked, thread = _marks(values.get("class", ""), values.get("id", ""), kind)
        apart = apart or tag in APART or (tag == "header" and not article)
        kind = tag if tag in ("article", "main") else role if role in ("article", "main") else tag
        if kind == "article" and marked and self.depth:
            apart, marked = True, False
        if kind in ("article", "main", "h1") and mark and not apart and not marked:
            self._holds(mark, kind)
        if kind == "article":
            self.depth += 1
        if marked and not apart:
            mark = Mark(mark, self.depth, thread)
            self.marks.append(mark)
        if kind in ("article", "main") and not article and not apart:
            self.articles += 1
            article = self.articles
        starts = tag in BLOCK or tag in APART
        if starts:
            if not apart and (not self.tags[block] or self.tags[block] in AROUND):
                self.loose[block] = True
            self.tags.append(tag)
            self.outer.append(block)
            self.loose.append(False)
            block = len(self.last)
            self.last.append(block)
        self.open.append((tag, apart, article, mark, block))
        self.kinds.append(kind)
        if starts:
            self._new_line()
        self.line.tags += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # "/" closes nothing in HTML but what is void anyway

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            at = self.open[i][0]
            if at == tag:
                ended = [t for t, *_ in self.open[i:]]
                self.paragraphs -= ended.count("p")
                self.depth -= self.kinds[i:].count("article")
                for *_, block in self.open[i:]:
                    self.last[block] = len(self.last) - 1
                del self.open[i:], self.kinds[i:]
                if any(t in BLOCK or t in APART for t in ended):
                    self._new_line()
                break
            if tag == "p" and at in ("article", "main", "td", "th", "button"):
                break  # a stray end tag doesn't reach out of what it is in
        self.line.tags += 1

    def handle_data(self, data: str) -> None:
        self.line.parts.append(data)


def smooth(values: np.ndarray, width: float) -> np.ndarray:
    """Gaussian smoothing with standard deviation `width` in lines; outside are zeros."""
    reach = max(int(3 * width), 1)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / width) ** 2)
    return np.convolve(values, kernel / kernel.sum(), "full")[reach : reach + len(values)]


def _beside(parser: Lines, lines: list[Line]) -> np.ndarray:
    """Whether a block, by number, is in an element that one of the lines is a block of: the element
    around the line's own, or this itself where the line is loose text between blocks."""
    change = np.zeros(len(parser.last) + 1, np.int64)
    for block in {line.block for line in lines}:
        around = block if parser.loose[block] else parser.outer[block]
        while parser.tags[around] in ITEMS.get(parser.tags[block], ()):
            around = parser.outer[around]
        change[around] += 1
        change[parser.last[around] + 1] -= 1
    return np.cumsum(change) > 0


def main_text(html: str, width: float = 1.0, level: float = 0.5) -> str:
    """The article of a page; its blocks are joined by two line feeds.

    Each block of text is a line with the ratio of its characters to its tags, 0 if it stands apart
    (menus, footers, forms, notices and such, by element, role, class or id; classes and ids never
    mark headings nor what an article, main or h1 element is in). Ratios are smoothed; lines at
    `level` times the mean of the text lines or more are content. All lines of all article and main
    elements stay, short ones as well. Where these hold less of the content than the rest of the
    page, or there are none, the region from the first other content line to the last stays too, and
    on both sides the blocks beside content lines in one element, less what is apart.
    """
    parser = Lines()
    for i in range(0, len(html), STREAM):
        parser.feed(html[i : i + STREAM])
    parser.close()
    lines = [(line, text) for line in parser.lines if (text := line.text())]
    eligible = np.array([not line.apart for line, _ in lines], bool)
    if not eligible.any():
        return ""
    ratio = np.array([len(text) / max(line.tags, 1) for line, text in lines]) * eligible
    score = smooth(ratio, width)
    content = eligible & (score >= level * score[eligible].mean())
    found = np.flatnonzero(content).tolist()
    other = [i for i in found if not lines[i][0].article]
    most = 2 * sum(len(lines[i][1]) for i in other) > sum(len(lines[i][1]) for i in found)
    first, last = (other[0], other[-1]) if most else (len(lines), -1)
    beside = _beside(parser, [lines[i][0] for i in other if most])
    kept = (
        text for i, (line, text) in enumerate(lines)
        if not line.apart and (line.article or first <= i <= last or beside[line.block])
    )
    return "\n\n".join(kept)


def extract_pages(pages: DataFrame, *, page_id="page_id", url="url", html="html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row; n_chars counts code points.

    Null and empty html, and pages without an article, have an empty text. Repeated rows repeat.
    """

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(t or "") for t in rows.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )

    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")
    )
    kind = rows.schema["page_id"].dataType.simpleString()
    return map_texts(rows, "html", batch, f"page_id {kind}, url string, text string, n_chars long")
