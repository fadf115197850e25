"""Passes over trees against outlines written by hand, and node numbers against the parser's."""

import pytest

from pyspark.sql import functions as F

from codexlake.operators import documents as dc
from codexlake.operators import rewrite as rw
from codexlake.plans import tree_queries as tq


def tree_of(spark, *sources):
    return dc.html_nodes(spark.createDataFrame([*enumerate(sources)], "page_id long, html string"), runs=True)


def outline(nodes):
    """page -> lines of tag, or text in quotes, indented by depth, in document order."""
    out = {}
    for r in sorted(nodes.collect(), key=lambda r: (r.page_id, r.pre)):
        out.setdefault(r.page_id, []).append(" " * r.depth + (repr(r.text) if r.tag == "#text" else r.tag + "".join(f" {k}={v}" for k, v in sorted((r.attrs or {}).items()))))
    return out


def run(spark, step, *sources):
    return outline(rw.numbered(step(rw.opened(tree_of(spark, *sources)))))


def test_numbers_are_the_parsers(spark):
    nodes = tree_of(spark, "<div><p>a<b>c</b>d</p><ul><li>x</li><li>y</li></ul></div>", "<p>one</p><p>two</p>", "", "text only")
    columns = ["page_id", "node_id", "parent_id", "pre", "post", "depth", "ord", "tag", "text"]
    assert sorted(map(tuple, rw.numbered(rw.opened(nodes)).select(*columns).collect()), key=str) == sorted(map(tuple, nodes.select(*columns).collect()), key=str)


def test_merged_runs(spark):
    got = run(spark, rw.merged_runs, "<p>a<!-- c -->b&amp;<br>c<!-- --><!-- -->d</p>")
    assert got[0] == ["p", " 'ab&'", " br", " 'cd'"]


def test_fused_lists(spark):
    got = run(spark, rw.fused_lists, "<div><ul><li>a</li></ul> <ul></ul><ul><li>b</li><li>c</li></ul><ol><li>d</li></ol><p>x</p><ol><li>e</li></ol></div>")
    assert got[0] == ["div", " ul", "  li", "   'a'", "  li", "   'b'", "  li", "   'c'", " ol", "  li", "   'd'", " p", "  'x'", " ol", "  li", "   'e'"]


@pytest.mark.parametrize("source, want", [
    ("<div><span id=s class=c>a<p>b</p>c<p>d</p></span></div>", ["div", " span class=c id=s", "  'a'", " p", "  'b'", " span class=c", "  'c'", " p", "  'd'"]),
    ("<div><b id=s><p>b</p>c</b></div>", ["div", " p id=s", "  'b'", " b", "  'c'"]),
    ("<div>x<em>a<b>b<p>c</p>d</b>e</em>y</div>", ["div", " 'x'", " em", "  'a'", "  b", "   'b'", " p", "  'c'", " em", "  b", "   'd'", "  'e'", " 'y'"]),
    ("<div><a href=u id=k>t<p>b<i>c</i></p></a></div>", ["div", " a href=u id=k", "  't'", " p", "  a href=u", "   'b'", "   i", "    'c'"]),
    ("<div><b>plain</b></div>", ["div", " b", "  'plain'"]),
])
def test_lifted_blocks(spark, source, want):
    assert run(spark, rw.lifted_blocks, source)[0] == want


def test_wrapped_runs(spark):
    got = run(spark, rw.wrapped_runs, "<div>a<b>b</b><p>c</p>d</div>", "<div>a<b>b</b></div>", "<ul>x<li>y<p>z</p></li></ul>")
    assert got[0] == ["div", " div", "  'a'", "  b", "   'b'", " p", "  'c'", " div", "  'd'"] and got[1] == ["div", " 'a'", " b", "  'b'"]
    assert got[2] == ["ul", " 'x'", " li", "  div", "   'y'", "  p", "   'z'"]


def test_normal_tables(spark):
    got = run(spark, rw.normal_tables, "<table><tr><td>1</td></tr><tr><th>h</th><th>i</th></tr><colgroup></colgroup><tr><th>x</th><td>2</td></tr></table>", "<table></table>", "<table><tbody><colgroup></colgroup><tr><td>1</td></tr></tbody></table>")
    assert got[0] == ["table", " colgroup", " thead", "  tr", "   th", "    'h'", "   th", "    'i'", " tbody", "  tr", "   td", "    '1'", "  tr", "   th", "    'x'", "   td", "    '2'"]
    assert got[1] == ["table", " tbody"] and got[2] == ["table", " colgroup", " tbody", "  tr", "   td", "    '1'"]


def test_pruned(spark):
    got = run(spark, rw.pruned, "<body><div><span></span><section> </section></div><div id=a></div><p></p><div class=k><i></i></div><img></body>", "<div><div></div></div>")
    assert got == {0: ["body", " div id=a", " p", " div class=k", " img"]}


def test_all_passes(spark):
    nodes = tree_of(spark, "<div><ul><li>a</li></ul><ul><li>b</li></ul><p>x<!-- -->y<b>bold<div></div><p>inner</p></b></p><table><tr><th>h</th></tr></table></div>")
    assert outline(rw.optimized(nodes))[0] == ["div", " ul", "  li", "   'a'", "  li", "   'b'", " p", "  div", "   'xy'", "   b", "    'bold'", "  p", "   'inner'", " table", "  thead", "   tr", "    th", "     'h'"]
    assert rw.optimized(nodes.limit(0)).count() == 0


def test_numbers_take_one_exchange(spark):
    """Rows that are dealt by page are numbered where they are, without rounds of jobs over levels."""
    plan = rw.numbered(rw.opened(tree_of(spark, "<div><p>a</p></div>")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_lifted_blocks_without_rounds(spark, monkeypatch):
    """Deep chains on many pages take no checkpoint and no job of their own; the nearest of nested links counts, once."""
    depth = 40
    rows = [("r", None, 0, "div", {}, "")] + [(f"b{k}", f"b{k - 1}" if k else "r", k + 1, "b", {"id": f"i{k}"}, "") for k in range(depth)]
    rows += [("t", f"b{depth - 1}", 100, "#text", {}, "x"), ("p", f"b{depth - 1}", 101, "p", {}, ""), ("pt", "p", 102, "#text", {}, "y"), ("u", f"b{depth - 1}", 103, "#text", {}, "z")]
    rows += [("a", "r", 200, "a", {"href": "1"}, ""), ("d", "a", 201, "div", {}, ""), ("e", "d", 202, "a", {"href": "2"}, ""), ("q", "e", 203, "p", {}, ""), ("qt", "q", 204, "#text", {}, "w")]
    tree = spark.createDataFrame(rows, "node string, parent string, at long, tag string, attrs map<string,string>, text string").withColumn("at", F.array("at")).crossJoin(spark.range(7).withColumnRenamed("id", "page_id")).select(*rw.COLUMNS)
    monkeypatch.setattr(type(tree), "checkpoint", lambda *_: 1 / 0)
    found = rw.numbered(rw.lifted_blocks(tree))
    assert found.count() == 7 * (1 + 2 * depth + 2 + 2 + 4)
    got = [(r.depth, r.tag, r.attrs.get("id"), r.attrs.get("href"), r.text) for r in found.where("page_id = 6").orderBy("pre").collect()]
    first, second = ([(k + 1, "b", f"i{k}" if whole else None, None, "") for k in range(depth)] for whole in (True, False))
    assert got == [(0, "div", None, None, ""), *first, (depth + 1, "#text", None, None, "x"), (1, "p", None, None, ""), (2, "#text", None, None, "y"), *second, (depth + 1, "#text", None, None, "z"), (1, "div", None, None, ""), (2, "p", None, None, ""), (3, "a", None, "2", ""), (4, "#text", None, None, "w")]


def test_packed_pages_take_one_exchange_and_one_sort(spark):
    """Orders become tables, and these node rows, where the lines were dealt and sorted; the nodes are neither exchanged nor sorted again."""
    plan = tq.normal_tables(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("Exchange "), plan.count("Sort ["), plan.count("MapInArrow")) == (1, 1, 1)


def test_table_sections_of_packed_and_of_single_rows(spark):
    """Nested tables, a column group in a section, groups after the first, pages over many batches; rows of a page come in any number of lists."""
    page = "<table><tbody><colgroup></colgroup><tr><td><table><tr><th>h</th></tr><colgroup id=x></colgroup><colgroup id=y></colgroup><tr><td>d</td></tr></table></td></tr></tbody></table>"
    tree = rw.opened(tree_of(spark, *[page, "", "<table></table><p>x</p>"] * 50))
    packed = tree.groupBy("page_id", F.crc32("node") % 3).agg(F.collect_list(F.struct(*rw.COLUMNS[1:])).alias("nodes")).select("page_id", "nodes")
    want = ["table", " colgroup", " tbody", "  tr", "   td", "    table", "     colgroup id=x", "     thead", "      tr", "       th", "        'h'", "     tbody", "      tr", "       td", "        'd'", "     colgroup id=y"]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 7)
    try:
        for rows in (rw.numbered(rw.normal_tables(tree)), rw.numbered(tree, rw.table_sections), rw.numbered(packed, rw.table_sections)):
            got = outline(rows)
            assert len(got) == 100 and got[147] == want and got[149] == ["table", " tbody", "p", " 'x'"]
    finally:
        spark.conf.set(key, before)
