"""Tables that patterns get wrong."""

import pytest

from veristry.operators.markup import nested_table_rows, tables_of

CASES = {
    "<table><tr><td>a<td>b<tr><td>c</table>": [(0, ["a", "b"]), (0, ["c"])],
    "<table><tr><td>a</td><td><table><tr><td>in</td></tr></table> out</td></tr></table>": [(0, ["a", "out"]), (1, ["in"])],
    "<TABLE><tr><th rowspan=2>a</th><td>b</td></tr><tr><td>c</td></tr><tr><td>d</td></tr></TABLE>": [(0, ["a", "b"]), (0, ["a", "c"]), (0, ["d"])],
    "<table><tr><td colspan='2'>a</td><td>b</td></tr></table>": [(0, ["a", "a", "b"])],
    "<table><tr><td>x</td><td rowspan=0>a</td></tr><tr><td>b</td></tr><tr><td>c</td></tr></table>": [(0, ["x", "a"]), (0, ["b", "a"]), (0, ["c", "a"])],
    "<table><tr><td rowspan=2 colspan=2>a</td><td>b</td></tr><tr><td>c</td></tr></table>": [(0, ["a", "a", "b"]), (0, ["a", "a", "c"])],
    '<table><tr><td title="a>b">x &amp; <b>y</b><br>z</td></tr></table>': [(0, ["x & y z"])],
    "<table><tr><td>a<!-- <td>no</td> --><script>'<td>no'</script></td></tr></table>": [(0, ["a"])],
    "<table><td>a</td></table>": [(0, ["a"])],
    "<table><tr><td>open": [(0, ["open"])],
    "<table><tr></tr></table>": [],
    "</table></tr><td>lost</td>": [],
    "no table": [],
    "": [],
    "<table><tr><td>a</td></tr></table><table><tr><td>b</td></tr></table>": [(0, ["a"]), (0, ["b"])],
    "<table><tr><td colspan=99999999>a</td></tr></table>": [(0, ["a"] * 1000)],
}


@pytest.mark.parametrize("page", CASES)
def test_tables(page):
    assert [(t.depth, r) for t in tables_of(page) for r in t.rows] == CASES[page]


def test_deep_and_long_pages():
    deep = "<table><tr><td>x" * 3000
    assert [t.depth for t in tables_of(deep)] == list(range(3000))
    long = "<table>" + "".join(f"<tr><td>{i}<td rowspan=3>r{i}" for i in range(30_000)) + "</table>"
    rows = tables_of(long)[0].rows
    assert len(rows) == 30_000 and rows[0] == ["0", "r0"] and rows[1][:3] == ["1", "r0", "r1"]


def test_rows_of_pages(spark):
    pages = [(i, page, "x") for i, page in enumerate(CASES)] + [(99, None, "x"), (None, "<table><td>n", "x"), (3, "<table><td>again", "x")]
    got = [(r.page_id, r.depth, list(r.cells)) for r in nested_table_rows(spark.createDataFrame(pages, "page_id long, html string, cells string")).collect()]
    want = [(i, d, r) for i, page in enumerate(CASES) for d, r in CASES[page]] + [(None, 0, ["n"]), (3, 0, ["again"])]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert nested_table_rows(spark.createDataFrame([], "page_id long, html string")).count() == 0
