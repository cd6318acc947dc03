"""Posts from web pages: a tokeniser of HTML with block structure, character references, title, date, attachments and links.

Pages are parsed in Arrow batches by the standard library's tokeniser, which takes broken markup as it comes. Scripts, styles,
navigation and comments go; a block begins a new line; white space within a line is one space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import published

POST = "id long, url string, title string, content string, raw_date string, attachments array<struct<name:string,url:string>>, links array<string>"
_BLOCKS = {"address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul"}
_SILENT = {"script", "style", "nav", "template", "noscript", "head", "svg"}
_VOID = {"br", "hr", "img", "input", "link", "meta"}
#: Endings of addresses that are files to download.
FILES = (".pdf", ".hwp", ".hwpx", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip")
_DATES = {"article:published_time", "date", "dc.date", "datepublished", "pubdate"}


class _Page(HTMLParser):
    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url, self.silent, self.in_title = url, [], False
        self.title, self.heading, self.lines, self.date = "", "", [""], None
        self.links: list[tuple[str, list[str]]] = []
        self.open_link: list[str] | None = None
        self.in_heading = False

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and (a.get("property") or a.get("name") or a.get("itemprop") or "").lower() in _DATES:
            self.date = self.date or a.get("content")
        if tag == "time" and a.get("datetime"):
            self.date = self.date or a["datetime"]
        self.in_title = tag == "title"
        if tag in _SILENT and tag not in _VOID:
            self.silent.append(tag)
        if tag == "body":  # a head that nobody closed
            self.silent.clear()
        if tag in _BLOCKS:
            self.lines.append("")
        if tag == "h1" and not self.heading:
            self.in_heading = True
        if tag == "a" and a.get("href") and not self.silent:
            self.open_link = []
            self.links.append((urljoin(self.url, a["href"].strip()), self.open_link))

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in self.silent:
            while self.silent.pop() != tag:
                pass
        if tag in _BLOCKS:
            self.lines.append("")
        if tag == "h1":
            self.in_heading = False
        if tag == "a":
            self.open_link = None

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        if self.silent:
            return
        self.lines[-1] += data
        if self.in_heading:
            self.heading += data
        if self.open_link is not None:
            self.open_link.append(data)


def _flat(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def parse(url: str | None, html: str | None) -> tuple:
    """(title, content, raw_date, attachments, links) of a page; a heading stands in for a title that is not there."""
    page = _Page(url or "")
    try:
        page.feed(html or "")
        page.close()
    except (AssertionError, ValueError):  # markup that the tokeniser gives up on: what came before stays
        pass
    content = "\n".join(filter(None, map(_flat, page.lines)))
    web = [(u, _flat("".join(name))) for u, name in page.links if u.startswith(("http://", "https://"))]
    files = [{"name": name or u.rsplit("/", 1)[-1], "url": u} for u, name in web if u.split("?", 1)[0].split("#", 1)[0].lower().endswith(FILES)]
    return _flat(page.title) or _flat(page.heading) or None, content, page.date, files, list(dict.fromkeys(u for u, _ in web))


def board_posts(pages: DataFrame, source: str) -> DataFrame:
    """Posts of `pages` (page_id, url, html): id, source, title, content, published_at, document_type, url, attachments,
    links. A page without a date that can be read is static; broken and empty pages give empty contents."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.struct([("name", pa.string()), ("url", pa.string())])), pa.list_(pa.string())]
        names = ["id", "url", "title", "content", "raw_date", "attachments", "links"]
        for b in batches:
            urls = b.column("url").to_pylist()
            got = [parse(u, h) for u, h in zip(urls, b.column("html").to_pylist())]
            cols = [b.column("id").to_pylist(), urls, *map(list, zip(*got))] if got else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    found = pages.select(F.col("page_id").cast("long").alias("id"), "url", "html").mapInArrow(task, POST)
    at = published(F.trim("raw_date"))
    return found.select("id", F.lit(source).alias("source"), "title", "content", at.alias("published_at"), F.when(at.isNull(), "static").otherwise("notice").alias("document_type"), "url", "attachments", "links")
