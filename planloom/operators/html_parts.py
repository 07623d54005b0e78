"""Headings and tables of HTML pages, each page inside its own row."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.operators.segment import flatten_rows

PARTS = "headings array<struct<level:int,text:string>>, tables array<struct<cells:array<array<string>>>>"
_KINDS = [
    pa.list_(pa.struct([("level", pa.int32()), ("text", pa.string())])),
    pa.list_(pa.struct([("cells", pa.list_(pa.list_(pa.string())))])),
]
SILENT = {"script", "style", "template"}
LEVELS = {f"h{k}": k for k in range(1, 7)}
#: A span reaches no further than this, as browsers have it.
WIDEST = 1000


def _span(attrs: list[tuple[str, str | None]], name: str) -> int:
    given = (dict(attrs).get(name) or "").strip()
    return min(WIDEST, max(1, int(given))) if given.isascii() and given.isdigit() else 1


class _Table:
    """A grid under construction. `reach` says down to which row a cell from above covers a column."""

    def __init__(self):
        self.rows: list[list[str | None]] = []
        self.reach: list[int] = []
        self.cell: list[str] | None = None
        self.spans = (1, 1)

    def row(self) -> None:
        self.close()
        self.rows.append([])

    def open(self, across: int, down: int) -> None:
        self.close()
        if not self.rows:
            self.row()
        self.cell, self.spans = [], (across, down)

    def close(self) -> None:
        """Put the open cell into the first free place of its row; places it spans stay empty."""
        if self.cell is None:
            return
        text, (across, down) = " ".join("".join(self.cell).split()), self.spans
        self.cell = None
        here, row = len(self.rows) - 1, self.rows[-1]
        while len(row) < len(self.reach) and self.reach[len(row)] > here:
            row.append(None)
        for k in range(across):
            if len(row) == len(self.reach):
                self.reach.append(0)
            self.reach[len(row)] = max(self.reach[len(row)], here + down)
            row.append(text if not k else None)

    def grid(self) -> list[list[str | None]]:
        self.close()
        width = len(self.reach)
        return [r + [None] * (width - len(r)) for r in self.rows]


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.headings: list[tuple[int, str]] = []
        self.tables: list[list[list[str | None]]] = []
        self.open: list[_Table] = []
        self.heading: tuple[int, list[str]] | None = None
        self.silent = 0

    def end_heading(self) -> None:
        if self.heading is not None:
            text = " ".join("".join(self.heading[1]).split())
            if text:
                self.headings.append((self.heading[0], text))
            self.heading = None

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent += 1
        elif tag in LEVELS:
            self.end_heading()
            self.heading = (LEVELS[tag], [])
        elif tag == "table":
            self.open.append(_Table())
        elif self.open and tag == "tr":
            self.open[-1].row()
        elif self.open and tag in ("td", "th"):
            self.open[-1].open(_span(attrs, "colspan"), _span(attrs, "rowspan"))
        elif tag in ("br", "p", "div", "li"):
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in LEVELS:
            self.end_heading()
        elif self.open and tag in ("td", "th", "tr"):
            self.open[-1].close()
        elif self.open and tag == "table":
            self.tables.append(self.open.pop().grid())

    def handle_data(self, data):
        if self.silent:
            return
        if self.heading is not None:
            self.heading[1].append(data)
        if self.open and self.open[-1].cell is not None:
            self.open[-1].cell.append(data)

    def finish(self):
        self.close()
        self.end_heading()
        while self.open:
            self.tables.append(self.open.pop().grid())


def page_parts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, headings, tables) of every page row; nothing is shuffled.

    Headings are h1 to h6 with some text, white space as one space, in page order. A table is a grid: a cell
    stands in the first place that no cell above it covers, and the other places it spans are null, as are
    missing ones. Nested tables are tables of their own, listed before the outer one. Unclosed tags end
    with their row, table or page. Null and empty pages have neither; scripts and styles are no text.
    """
    def run(batches):
        for batch in batches:
            found = []
            for text in batch.column(1):
                page = _Page()
                page.feed(text.as_py() or "")
                page.finish()
                found.append(page)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([[{"level": n, "text": t} for n, t in p.headings] for p in found], _KINDS[0]),
                pa.array([[{"cells": g} for g in p.tables] for p in found], _KINDS[1]),
            ], names=[key, "headings", "tables"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, F.col(html).cast("string")).mapInArrow(run, f"{key} {kind}, {PARTS}")


def table_text(table: Column) -> Column:
    """A grid as lines, as tables of other formats are written."""
    return flatten_rows(table["cells"])
