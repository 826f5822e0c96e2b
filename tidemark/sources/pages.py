"""Titles, paragraphs, links and dates of HTML pages, with the standard library's parser in Arrow batches.

A page is parsed once for all it has to give.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SKIPPED = frozenset(("script", "style", "template", "noscript"))


class Page(HTMLParser):
    """First heading, titles, the paragraphs inside given containers, links and the published time."""

    def __init__(self, containers: tuple[tuple[str, str | None], ...] = (("article", None),)):
        super().__init__(convert_charrefs=True)
        self.containers = containers
        self.stack: list[tuple[str, frozenset]] = []
        self.inside = 0
        self.h1 = self.og_title = self.title = self.time = ""
        self.paragraphs: list[str] = []
        self.links: list[str] = []
        self._open: dict[str, list[str]] = {}

    def _is_container(self, tag: str, classes: frozenset) -> bool:
        return any((t is None or t == tag) and (c is None or c in classes) for t, c in self.containers)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        classes = frozenset((a.get("class") or "").split())
        if tag == "p":
            self._end_text("p")
        if tag not in _VOID:
            self.stack.append((tag, classes))
            self.inside += self._is_container(tag, classes)
        if tag in ("h1", "title") or (tag == "p" and self.inside):
            self._open.setdefault(tag, [])
        if tag == "a" and (href := (a.get("href") or "").strip()):
            self.links.append(href)
        if tag == "meta" and a.get("property") == "og:title" and a.get("content") and not self.og_title:
            self.og_title = a["content"].strip()
        if not self.time:
            if tag == "time" and a.get("datetime"):
                self.time = a["datetime"]
            elif tag == "meta" and a.get("property") == "article:published_time":
                self.time = a.get("content") or ""

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._end_text(tag)
        if any(t == tag for t, _ in self.stack):
            while self.stack:
                t, classes = self.stack.pop()
                self.inside -= self._is_container(t, classes)
                if t != tag:
                    self._end_text(t)
                else:
                    break

    def _end_text(self, tag):
        parts = self._open.pop(tag, None)
        if parts is None:
            return
        text = " ".join(p for p in (x.strip() for x in parts) if p)
        if tag == "p":
            if text:
                self.paragraphs.append(text)
        elif text and not getattr(self, tag):
            setattr(self, tag, text)

    def parse_marked_section(self, i, report=1):
        """A section that is none of the known ones ends with its bracket, as in browsers, where the library's parser gives up."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i, report)

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] in _SKIPPED:
            return
        for parts in self._open.values():
            parts.append(data)


def _absolute(base_url: str, link: str) -> str:
    """A link that can't be read stays as it is written."""
    try:
        return urljoin(base_url, link)
    except ValueError:
        return link


def parse(html: str | None, containers=(("article", None),), base_url: str = "") -> dict:
    page = Page(containers)
    page.feed(html or "")
    page.close()
    for tag in list(page._open):
        page._end_text(tag)
    links = list(dict.fromkeys(_absolute(base_url, x) for x in page.links))
    return {"title": page.h1 or page.og_title or page.title, "body": "\n".join(page.paragraphs).strip(), "published": page.time, "links": links}


def parse_pages(df: DataFrame, html_column: str = "html", containers=(("article", None),), url_column: str | None = "url", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` and title, body, published and links of each page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            base = frame[url_column] if url_column else [""] * len(frame)
            found = pd.DataFrame([parse(h, containers, u or "") for h, u in zip(frame[html_column], base, strict=True)], columns=["title", "body", "published", "links"], index=frame.index)
            yield pd.concat([frame[list(keep)], found], axis=1)

    needed = list(dict.fromkeys([*keep, html_column, *([url_column] if url_column else [])]))
    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
    return df.select(*needed).mapInPandas(run, ", ".join([*fields, "title string, body string, published string, links array<string>"]))
