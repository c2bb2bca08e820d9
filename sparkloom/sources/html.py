"""Web pages to text blocks, links and metadata, with the standard library's parser in mapInPandas."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sites

# Fixed values.
SILENT = frozenset({"script", "style", "noscript", "template"})


class PageParser(HTMLParser):
    """All links of a page, and its metadata."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.links: list[tuple[str, str]] = []
        self.meta: dict[str, str] = {}
        self.title = ""
        self._in_title = False
        self._silent = 0
        self._anchor: list[str] | None = None
        self._html = ""

    @property
    def blocks(self) -> list[tuple[str, list[str]]]:
        """Texts of the innermost blocks outside navigation, with their links."""
        return list(sites.Page(self._html, "").blocks())

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = dict(attrs)
        if tag in SILENT:
            self._silent += 1
        elif tag == "meta":
            name = given.get("property") or given.get("name")
            if name and given.get("content"):
                self.meta.setdefault(name.lower(), given["content"])
        elif tag == "title":
            self._in_title = True
        if tag == "a" and given.get("href"):
            self._anchor = [given["href"], ""]

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self._silent = max(0, self._silent - 1)
        elif tag == "title":
            self._in_title = False
        elif tag == "a" and self._anchor:
            self.links.append((self._anchor[0], " ".join(self._anchor[1].split())))
            self._anchor = None

    def handle_data(self, data: str) -> None:
        if self._silent:
            return
        if self._in_title:
            self.title += data
        if self._anchor:
            self._anchor[1] += data


def parsed(html: str | None) -> PageParser:
    """Any string can be parsed; null is an empty page."""
    parser = PageParser()
    parser._html = html or ""
    parser.feed(sites.closed(parser._html))
    parser.close()
    return parser


def blocks(pages: DataFrame) -> DataFrame:
    """(page_id, pos, key, text, links): a page's distinct innermost blocks outside navigation, in order."""
    return sites.items(pages.select("page_id", F.lit("").alias("url"), "html")).select("page_id", "pos", "key", "text", "links")


def links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, anchor) of every link."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, n, *link) for i, html in zip(frame["page_id"], frame["html"]) for n, link in enumerate(parsed(html).links)]
            yield pd.DataFrame(rows, columns=["page_id", "pos", "href", "anchor"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, pos long, href string, anchor string")


def metadata(pages: DataFrame) -> DataFrame:
    """(page_id, title, site_name, description, image, is_article, has_offer): what a page says of itself."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for page_id, html in zip(frame["page_id"], frame["html"]):
                page, raw = parsed(html), html or ""
                scripts = " ".join(re.findall(r"(?is)<script[^>]*ld\+json[^>]*>(.*?)</script>", raw))
                offer = re.search(r'"@type"\s*:\s*(?:\[[^\]]*)?"(?:Offer|AggregateOffer)"', scripts) is not None
                rows.append((page_id, page.title.strip() or None, page.meta.get("og:site_name"), page.meta.get("og:description") or page.meta.get("description"), page.meta.get("og:image"), page.meta.get("og:type") == "article", offer))
            yield pd.DataFrame(rows, columns=["page_id", "title", "site_name", "description", "image", "is_article", "has_offer"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, title string, site_name string, description string, image string, is_article boolean, has_offer boolean")
