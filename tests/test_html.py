"""Headings and tables of pages."""

from planloom.operators import html_parts
from pyspark.sql import functions as F


def parts(spark, *pages):
    frame = spark.createDataFrame(list(enumerate(pages)), "page int, html string")
    rows = html_parts.page_parts(frame, "page", "html").orderBy("page").collect()
    return [([(h.level, h.text) for h in r.headings], [t.cells for t in r.tables]) for r in rows]


def test_headings(spark):
    page = "<h1>One &amp; <b>two</b>\n three</h1><script><h2>no</h2></script><h2></h2><H3 class=x>Four<h4>Five</h4>"
    assert parts(spark, page, None, "", "<h1>open") == [([(1, "One & two three"), (3, "Four"), (4, "Five")], []), ([], []), ([], []), ([(1, "open")], [])]


def test_spans(spark):
    page = (
        "<table><thead><tr><th rowspan=2>A<th colspan=2>B</tr><tr><td>c<td>d</tr></thead>"
        "<tr><td colspan=x>e</td><td rowspan='3'>f<br>g</td></tr><tr><td>h</td><td>i</td></tr><tr></tr></table>"
    )
    assert parts(spark, page)[0][1] == [[
        ["A", "B", None], [None, "c", "d"], ["e", "f g", None], ["h", None, "i"], [None, None, None],
    ]]


def test_nested_and_broken_tables(spark):
    page = "<td>no table</td><table><tr><td>out<table><tr><td>in</table>side</td><td>x<table><td>no row"
    assert parts(spark, page)[0][1] == [[["in"]], [["no row"]], [["outside", "x"]]]
    assert parts(spark, "<table></table><table><tr><td colspan=100000>w</td></tr></table>")[0][1] == [[], [["w"] + [None] * 999]]


def test_long_pages_take_linear_time(spark):
    rows = "".join(f"<tr><td rowspan=2>{k}<td>x" for k in range(40_000))
    frame = spark.createDataFrame([(1, f"<table>{rows}"), (2, "<table>" * 3_000)], "page int, html string")
    sizes = html_parts.page_parts(frame, "page", "html").select("page", F.size("tables").alias("n"), F.size(F.get("tables", F.lit(0))["cells"]).alias("m"))
    assert sorted(tuple(r) for r in sizes.collect()) == [(1, 1, 40_000), (2, 3_000, 0)]
