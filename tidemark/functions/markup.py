"""HTML to text, and tables to Markdown."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SILENT = {"script", "style", "nav", "noscript", "template"}
_BREAKS = {"p", "br", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "title"}


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in _SILENT
        if tag in _BREAKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.silent = max(0, self.silent - (tag in _SILENT))
        if tag in _BREAKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)


def text_of(html: str | None) -> str | None:
    """The visible text, a line for each block."""
    if html is None:
        return None
    p = _Text()
    p.feed(html)
    p.close()
    lines = (" ".join(line.split()) for line in "".join(p.parts).split("\n"))
    return "\n".join(line for line in lines if line)


class _Table(HTMLParser):
    def __init__(self):
        super().__init__()
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append("".join(self.cell).strip())
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def table_of(html: str | None) -> tuple[list[str], list[list[str]]]:
    """(header, rows): the first row that has cells is the header."""
    p = _Table()
    p.feed(html or "")
    rows = [r for r in p.rows if r]
    return (rows[0], rows[1:]) if rows else ([], [])


def table_markdown(header: list[str], rows: list[list[str]]) -> str:
    """A Markdown table as wide as its header; short rows are filled up, what is too much is left out."""
    if not header:
        return ""
    line = lambda cells: "| " + " | ".join(cells) + " |"
    width = len(header)
    return "\n".join([line(header), line(["---"] * width), *(line((r + [""] * width)[:width]) for r in rows)])


def html_text(html: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(text_of)

    return run(html)


def html_table_markdown(html: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda h: table_markdown(*table_of(h)))

    return run(html)
