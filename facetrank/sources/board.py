"""Board pages: rows of a listing and fields of an article, by a state machine over the tokens of the page.

A regular expression cannot follow nested elements; here ``html.parser`` gives tags and texts (with every named and numeric
entity decoded) and a stack of open elements tells what a text belongs to.  Void elements do not open anything, an end
tag closes the nearest open element of its name and all inside it, and end tags without one are ignored.  Texts of
scripts and styles, and comments, are no content.

listing   rows of ``ROW`` inside ``TABLE``; a row without a number element is a notice and is dropped, and so is a
          row without an article link; positions count the rows that stay.
article   a page without a content box is dropped; of each field the first element inside the first box counts.
          title, date and author are its text, stripped; content is all text inside, pieces joined by a blank,
          whitespace collapsed.  A missing field, or one without text, takes its default.

Each task parses whole pages, Arrow batch by Arrow batch.  A null page has neither rows nor a box.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed

# fixed values: elements of the board pages, (tag, class)
BOX = ("div", "ArticleContentBox")
FIELDS = {"title": ("h3", "title_text"), "date": ("span", "date"), "content": ("div", "se-main-container"),
          "author": ("button", "nickname")}
DEFAULTS = {"title": fixed.DEFAULT_TITLE, "date": fixed.DEFAULT_DATE, "content": "내용없음(복사금지 혹은 이미지글)",
            "author": fixed.DEFAULT_AUTHOR}
TABLE, ROW = ("div", "article-board"), ("tr", None)
CELL, NUMBER, LINK = ("td", "td_article"), (None, "inner_number"), (None, "article")
# end of fixed values

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset(("script", "style"))
BLANKS = re.compile(r"[ \t\n\r\f\v]+")
BLANK = " \t\n\r\f\v"


def _is(tag: str, classes: list[str], wanted: tuple[str | None, str | None]) -> bool:
    return wanted[0] in (None, tag) and (wanted[1] is None or wanted[1] in classes)


class _Page(HTMLParser):
    """A stack of open elements; subclasses are told when one opens or closes, and of texts."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, list[str]]] = []

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        classes = (attrs.get("class") or "").split()
        self.opened(tag, classes, attrs)
        if tag not in VOID:
            self.stack.append((tag, classes))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                while len(self.stack) > k:
                    self.stack.pop()
                    self.closed(len(self.stack))
                return

    def handle_data(self, data):
        if not any(t in SILENT for t, _ in self.stack[-1:]):
            self.said(data)

    def finish(self, html: str):
        self.feed(html)
        self.close()
        while self.stack:                                # what the page left open
            self.stack.pop()
            self.closed(len(self.stack))
        return self

    def opened(self, tag, classes, attrs): ...
    def closed(self, depth): ...
    def said(self, text): ...


class Article(_Page):
    def __init__(self):
        super().__init__()
        self.box: int | None = None                      # depth of the first box; -1 once it is closed
        self.open: dict[str, int] = {}                   # depth of each field's element
        self.texts: dict[str, list[str]] = {}

    def opened(self, tag, classes, attrs):
        if self.box is None:
            if _is(tag, classes, BOX):
                self.box = len(self.stack)
        elif self.box >= 0:
            for name, wanted in FIELDS.items():
                if name not in self.texts and _is(tag, classes, wanted):
                    self.texts[name], self.open[name] = [], len(self.stack)

    def closed(self, depth):
        self.open = {name: d for name, d in self.open.items() if d != depth}
        if depth == self.box:
            self.box = -1

    def said(self, text):
        for name in self.open:
            self.texts[name].append(text)

    def fields(self) -> dict[str, str] | None:
        if self.box is None:
            return None
        out = {}
        for name in FIELDS:
            got = self.texts.get(name, [])
            text = BLANKS.sub(" ", " ".join(got)).strip(BLANK) if name == "content" else "".join(got).strip(BLANK)
            out[name] = text or DEFAULTS[name]
        return out


class Listing(_Page):
    def __init__(self):
        super().__init__()
        self.table = self.row = self.cell = self.number = None
        self.href: str | None = None
        self.digits: list[str] | None = None
        self.rows: list[tuple[str, str]] = []

    def opened(self, tag, classes, attrs):
        depth = len(self.stack)
        if self.table is None:
            if _is(tag, classes, TABLE):
                self.table = depth
        elif self.row is None:
            if _is(tag, classes, ROW):
                self.row, self.href, self.digits = depth, None, None
        else:
            if self.cell is None and _is(tag, classes, CELL):
                self.cell = depth
            elif self.cell is not None and self.digits is None and _is(tag, classes, NUMBER):
                self.number, self.digits = depth, []
            if self.href is None and _is(tag, classes, LINK) and "href" in attrs:
                self.href = attrs["href"] or ""

    def closed(self, depth):
        if depth == self.number:
            self.number = None
        if depth == self.cell:
            self.cell = None
        if depth == self.row:
            if self.digits is not None and self.href is not None:
                self.rows.append(("".join(self.digits).strip(BLANK), self.href))
            self.row = None
        if depth == self.table:
            self.table = None

    def said(self, text):
        if self.number is not None:
            self.digits.append(text)


def board_rows(pages: DataFrame, base: str = fixed.LINK_BASE, key: str = "page_id") -> DataFrame:
    """key, pos, number, url of the rows of listing pages (column ``html``) that are articles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, pos, number, href = [], [], [], []
            for i, html in enumerate(b.column("html").to_pylist()):
                for k, (n, h) in enumerate(Listing().finish(html or "").rows):
                    at.append(i)
                    pos.append(k)
                    number.append(n)
                    href.append(h)
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(at, pa.int64())), pa.array(pos, pa.int64()),
                                              pa.array(number, pa.string()), pa.array(href, pa.string())],
                                             names=[key, "pos", "number", "href"])
    rows = pages.select(key, "html").mapInArrow(run, f"{key} {dict(pages.dtypes)[key]}, pos long, number string, href string")
    url = F.when(F.contains(F.col("href"), F.lit("https")), F.col("href")).otherwise(F.concat(F.lit(base), F.col("href")))
    return rows.select(key, "pos", "number", url.alias("url"))


def board_articles(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, title, author, date, content of the pages (column ``html``) with a content box."""
    names = ["title", "author", "date", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, Article().finish(html or "").fields()) for i, html in enumerate(b.column("html").to_pylist())]
            found = [(i, f) for i, f in found if f is not None]
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array([i for i, _ in found], pa.int64())),
                                              *[pa.array([f[n] for _, f in found], pa.string()) for n in names]], names=[key, *names])
    return pages.select(key, "html").mapInArrow(run, f"{key} {dict(pages.dtypes)[key]}, " + ", ".join(f"{n} string" for n in names))
