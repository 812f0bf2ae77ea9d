"""Tables of web pages, read tag by tag.

One pass over a page's tags keeps a stack of open tables, so nested tables,
cells that span rows or columns, and rows and cells that nobody closes come out
as a browser shows them.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>""", re.S | re.I)
_SPAN = re.compile(r"""\b(row|col)span\s*=\s*["']?\s*(\d+)""", re.I)
#: A cell spans so many columns and rows at most, as browsers have it.
MOST_COLUMNS, MOST_ROWS = 1000, 65_534


@dataclass
class _Table:
    number: int
    depth: int
    rows: list[list[str]] = field(default_factory=list)
    row: dict[int, str] | None = None
    cell: list[str] | None = None
    span: tuple[int, int] = (1, 1)
    #: Of columns that a cell of an earlier row reaches into: how many rows are left, and its text.
    below: dict[int, tuple[int, str]] = field(default_factory=dict)

    def close_cell(self) -> None:
        if self.cell is None:
            return
        text, at = " ".join(html.unescape("".join(self.cell)).split()), 0
        rows, columns = self.span
        while at in self.row or at in self.below:
            at += 1
        for c in range(at, at + columns):
            self.row[c] = text
            if rows > 1:
                self.below[c] = (rows, text)
        self.cell = None

    def close_row(self) -> None:
        if self.row is None:
            return
        self.close_cell()
        for c, (left, text) in list(self.below.items()):
            self.row.setdefault(c, text)
            if left > 1:
                self.below[c] = (left - 1, text)
            else:
                del self.below[c]
        if self.row:
            self.rows.append([self.row.get(c, "") for c in range(max(self.row) + 1)])
        self.row = None

    def open_cell(self, attributes: str) -> None:
        self.close_cell()
        if self.row is None:
            self.row = {}
        spans = {kind.lower(): int(n[:6]) for kind, n in _SPAN.findall(attributes)}
        rows = spans.get("row", 1)
        self.span = (min(rows or MOST_ROWS, MOST_ROWS), min(max(1, spans.get("col", 1)), MOST_COLUMNS))  # 0 rows: all that follow
        self.cell = []


def tables_of(page: str) -> list[_Table]:
    """The tables of a page in order of their beginnings."""
    found: list[_Table] = []
    open_: list[_Table] = []
    last = 0

    def text(upto: int) -> None:
        if open_ and open_[-1].cell is not None and upto > last:
            open_[-1].cell.append(page[last:upto])

    for m in _TAG.finditer(page):
        text(m.start())
        last = m.end()
        name = (m[3] or "").lower()
        if name == "table":
            if not m[2]:
                found.append(_Table(len(found), len(open_)))
                open_.append(found[-1])
            elif open_:
                open_.pop().close_row()
        elif open_ and name in ("tr", "td", "th"):
            t = open_[-1]
            if name == "tr":
                t.close_row()
                t.row = None if m[2] else {}
            elif m[2]:
                t.close_cell()
            else:
                t.open_cell(m[4])
        elif open_ and open_[-1].cell is not None and name in ("br", "p", "div", "li"):
            open_[-1].cell.append(" ")
    text(len(page))
    for t in open_:
        t.close_row()
    return found


_ROWS = pa.schema([("table_no", pa.int32()), ("depth", pa.int32()), ("row_no", pa.int32()), ("cells", pa.list_(pa.string()))])


def nested_table_rows(pages: DataFrame) -> DataFrame:
    """Rows of all tables of each page: (page_id, table_no, depth, row_no, cells array<string>), numbers from 0.

    ``pages`` has page_id and html; other columns are not used.  A table is
    numbered by where it begins, its depth counts the tables around it, and the
    text of a nested table is its own only.  A cell that spans rows or columns
    is repeated in each; a cell or row ends where the next one or its table
    does, at the latest with the page.  Tags inside cells are left out, entities
    resolved, runs of spaces made one.  Null or empty pages have no rows, and
    neither has a table without cells.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at, out = [], []
            for i, page in enumerate(batch.column(1)):
                for t in tables_of(page.as_py() or ""):
                    for k, cells in enumerate(t.rows):
                        at.append(i)
                        out.append((t.number, t.depth, k, cells))
            columns = [pa.array([o[c] for o in out], f.type) for c, f in enumerate(_ROWS)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=["page_id", *_ROWS.names])

    return pages.select("page_id", "html").mapInArrow(run, f"page_id {kind}, table_no int, depth int, row_no int, cells array<string>")
