"""Raw pages: links, titles and tables by the standard parser in Arrow batches; URL parts in SQL."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def url_parts(url: Column) -> dict[str, Column]:
    get = lambda p: F.regexp_extract(url, p, 1)
    return {"scheme": get("^([a-z]+)://"), "host": get("^[a-z]+://([^/?#]+)"), "path": get("^[a-z]+://[^/?#]+([^?#]*)")}


def query_parameter(url: Column, name: str) -> Column:
    """The value of a parameter of a URL; null if it has none."""
    return F.nullif(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1), F.lit(""))


class Page(HTMLParser):
    """Title, links, and the rows of tables of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.links, self.rows, self._cell, self._in = "", [], [], None, None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a" and (href := dict(attrs).get("href")):
            self.links.append(href)
        elif tag == "title":
            self._in = "title"
        elif tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            self._cell = []

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self._in = None
        elif tag in ("td", "th") and self._cell is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append(" ".join("".join(self._cell).split()))
            self._cell = None

    def handle_data(self, data: str) -> None:
        if self._in == "title":
            self.title += data
        if self._cell is not None:
            self._cell.append(data)


def read_page(html: str | None) -> Page:
    page = Page()
    if html:
        page.feed(html)
        page.close()
    return page


def parse_pages(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, title, links, cells (rows of tables that have any); a page of any size is one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [read_page(h) for h in batch.column(1).to_pylist()]
            cells = [[r for r in p.rows if r] for p in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([" ".join(p.title.split()) for p in got], pa.string()), pa.array([p.links for p in got], pa.list_(pa.string())), pa.array(cells, pa.list_(pa.list_(pa.string())))], names=[key, "title", "links", "cells"])

    return pages.select(key, html).mapInArrow(run, f"{key} {dict(pages.dtypes)[key]}, title string, links array<string>, cells array<array<string>>")


def records(parsed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of tables as columns, where a row has as many cells; a header row of the same names is left out."""
    rows = parsed.select(key, F.posexplode("cells").alias("row", "c")).where((F.size("c") == len(columns)) & (F.col("c") != F.array(*map(F.lit, columns))))
    return rows.select(key, "row", *(F.col("c")[i].alias(n) for i, n in enumerate(columns)))
