"""Sections, selectors, inherited values, spans and levels against what is written by hand or brute force."""

import random

from pyspark.sql import functions as F

from codexlake.functions import text as fn
from codexlake.operators import documents as dc
from codexlake.operators import pages as pg
from codexlake.operators import sections as se
from codexlake.operators import sequence as sq
from codexlake.operators import trees as tr


def test_section_bodies(spark):
    html = """<body><p>before</p><div><h1>One</h1><p>a<br>b <i>c</i></p><pre>x = 1</pre><ul><li>i<ul><li>ii</li></ul></li><li> </li><li>j</li></ul></div><h3>Deep</h3><table><tr><th>h</th><th>k</th></tr><tr><td>1</td><td></td></tr></table>
    <h2>Two</h2><hr><img src="p.png"><img><dl><dt>t</dt><dd>d</dd></dl><blockquote><p>q</p></blockquote><h1> </h1><h1>End</h1></body>"""
    nodes = dc.html_nodes(spark.createDataFrame([(1, html)], "page_id long, html string"), runs=True)
    rows = sorted(se.section_bodies(nodes).collect(), key=lambda r: (r.section or 0, r.place))
    title = {r.section: r.title for r in rows}
    assert [(r.title, title.get(r.parent), r.place, r.kind, r.items or r.text) for r in rows] == [
        (None, None, 1, "paragraph", "before"), ("One", None, 0, "heading", "One"), ("One", None, 1, "paragraph", "a b c"), ("One", None, 2, "code", "x = 1"), ("One", None, 3, "list", ["iii", "j"]),
        ("Deep", "One", 0, "heading", "Deep"), ("Deep", "One", 1, "table", ["h | k", "1 | "]), ("Two", "One", 0, "heading", "Two"), ("Two", "One", 1, "rule", ""), ("Two", "One", 2, "image", "p.png"), ("Two", "One", 3, "list", ["t", "d"]), ("Two", "One", 4, "quote", "q"), ("End", None, 0, "heading", "End"),
    ]
    assert se.section_bodies(nodes.limit(0)).count() == 0


def test_selectors_and_inheritance(spark):
    html = '<body id=top><div class="a b"><p>1<span><em>2</em></span></p></div><p class=b><em>3</em></p></body>'
    nodes = dc.html_nodes(spark.createDataFrame([(1, html), (2, "<p><em>x</em></p>")], "page_id long, html string"))
    selectors = spark.createDataFrame([(1, 1, False, "div", None, None), (1, 2, True, "p", None, None), (1, 3, False, "em", None, None), (2, 1, False, None, "b", None), (2, 2, True, "em", None, None), (3, 1, False, "p", "b", None), (4, 1, False, None, None, "top"), (5, 1, False, "p", None, None), (5, 2, True, "em", None, None)], "rule int, step int, child boolean, tag string, class string, id string")
    tags = {(r.page_id, r.node_id): r.tag for r in nodes.collect()}
    found = tr.selected(nodes, selectors)
    assert sorted((r.rule, r.page_id, r.node_id, tags[r.page_id, r.node_id]) for r in found.collect()) == [(1, 1, 4, "em"), (2, 1, 6, "em"), (3, 1, 5, "p"), (4, 1, 0, "body"), (5, 1, 6, "em"), (5, 2, 1, "em")]
    declarations = spark.createDataFrame([(1, 1, 1, "color", "one", False), (4, 1, 2, "color", "four", False), (2, 1, 3, "color", "two", False), (5, 1, 4, "color", "five", False), (3, 1, 5, "margin", "m", False), (5, 0, 6, "font", "f", True), (2, 1, 7, "font", "g", True)], "rule int, origin int, ord int, property string, value string, important boolean")
    got = {(r.page_id, r.node_id, r.property): (r.value, r.own) for r in tr.inherited(nodes, tr.winners(found, selectors, declarations), ("color",)).collect()}
    assert got == {(1, 0, "color"): ("four", True), (1, 1, "color"): ("four", False), (1, 2, "color"): ("four", False), (1, 3, "color"): ("four", False), (1, 4, "color"): ("one", True), (1, 5, "color"): ("four", False), (1, 6, "color"): ("two", True), (2, 1, "color"): ("five", True), (1, 5, "margin"): ("m", True), (1, 6, "font"): ("f", True), (2, 1, "font"): ("f", True)}


def test_inherited_through_a_deep_chain(spark):
    nodes = spark.createDataFrame([(1, i, i - 1 if i else None) for i in range(200)], "page_id long, node_id int, parent_id int")
    declared = spark.createDataFrame([(1, 0, "p", "root"), (1, 150, "p", "late")], "page_id long, node_id int, property string, value string")
    got = {r.node_id: r.value for r in tr.inherited(nodes, declared, ("p",)).collect()}
    assert got == {i: "root" if i < 150 else "late" for i in range(200)}


def test_dyadic_cover():
    for a in range(0, 40):
        for b in range(a, 70):
            cover = sq.dyadic_cover(a, b)
            places = sorted(x for level, k in cover for x in range(k << level, (k + 1) << level))
            assert places == [*range(a, b + 1)] and len(cover) <= 2 * (b - a + 1).bit_length()


def test_tightest_span_against_all_pairs(spark):
    r = random.Random(1)
    spans = [(r.choice([1, 2, None]), k, *(r.choice([r.randrange(60), r.randrange(-3, 100_000)]) if k % 9 else 5, r.randrange(9)), *((None, None) if r.random() < 0.2 else (r.randrange(200_000), r.randrange(9)))) for k in range(300)]
    points = [(r.choice([1, 2, 3, None]), k, r.randrange(100), r.randrange(9), None, r.choice([None, 8])) for k in range(200)] + [(1, 900, None, 1, None, None)]
    schema = "book int, {} long, es long, os long, ee long, oe long"
    got = {x.note: x.hl for x in sq.tightest_span(spark.createDataFrame(points, schema.format("note")), spark.createDataFrame(spans, schema.format("hl")), "book", "note", "hl").collect()}
    want = {}
    for b, k, es, os_, ee, oe in points:
        s, e = (es, os_), (es if ee is None else ee, os_ if oe is None else oe)
        fits = [] if es is None or b is None else [((y[0] - x[0], y[1] - x[1]), h) for c, h, *v in spans if c == b for x, y in [((v[0], v[1]), (v[0] if v[2] is None else v[2], v[1] if v[3] is None else v[3]))] if x <= s and e <= y]
        want[k] = min(fits)[1] if fits else None
    assert got == want
    empty = spark.createDataFrame([], schema.format("hl"))
    assert {x.hl for x in sq.tightest_span(spark.createDataFrame(points, schema.format("note")), empty, "book", "note", "hl").collect()} == {None}


def test_levels_without_a_cap(spark):
    ladder = [(1, k, k) for k in range(70)] + [(1, 70, 3), (1, 71, None), (1, 72, 3), (2, 0, 9), (2, 1, 8)]
    df = spark.createDataFrame(ladder, "g int, at int, level int").repartition(7)
    got = {(r.g, r.at): r.parent for r in sq.parents_by_level(df, "g", "at", "level", "at").collect()}
    assert got == {(1, k): k - 1 if k else None for k in range(70)} | {(1, 70): 2, (1, 71): None, (1, 72): 2, (2, 0): None, (2, 1): None}
    assert pg.depth_and_count(spark.createDataFrame([(1, k, k - 1 if k else None) for k in range(70)] + [(2, 1, 2), (2, 2, 1)], "book int, entry int, parent int"), "book", "entry", "parent").orderBy("book").collect() == [(1, 70, 70), (2, 2, None)]
    rows = spark.createDataFrame([(1, k, "  " * k + "x") for k in range(12)] + [(2, k, "  y") for k in range(4)], "g int, at int, label string")
    got = {(r.g, r.at): (r.parent, r.label) for r in pg.nested_by_indent(rows, "g", "at", "label").collect()}
    assert got == {(1, k): (k - 1 if k else None, "x") for k in range(12)} | {(2, k): (None, "  y") for k in range(4)}


def test_digit_runs_of_any_length(spark):
    names = ["a1" + "0" * 24, "a2" + "0" * 20, "a" + "0" * 30 + "3", "a12", "a2", "a", "b1", "2", "10", "", "a2b10", "a2b9"]
    got = [r.s for r in spark.createDataFrame([(s,) for s in names], "s string").orderBy(fn.natural_key(F.col("s"))).collect()]
    assert got == ["", "2", "10", "a", "a2", "a2b9", "a2b10", "a" + "0" * 30 + "3", "a12", "a2" + "0" * 20, "a1" + "0" * 24, "b1"]


def test_titles_with_an_open_reference(spark):
    """A heading that is cut inside a reference keeps what is written."""
    nodes = dc.html_nodes(spark.createDataFrame([(1, "<body><h1>x&amp;&amp</h1><p>y</p></body>")], "page_id long, html string"), runs=True)
    assert {r.title for r in se.section_bodies(nodes).collect()} == {"x&&amp"}


def test_texts_end_without_blanks(spark):
    """Blanks of any width at the ends are no text, inside they stand; a line tabulation is no white space."""
    html = "<body><h1>\u3000One\u00a0two\u2003</h1><p> \u00a0\n </p><p>a\x0bb \u00a0</p><ul><li>\u3000</li><li>\u00a0i</li><li>j\x1fk</li></ul></body>"
    nodes = dc.html_nodes(spark.createDataFrame([(1, html)], "page_id long, html string"), runs=True)
    rows = sorted(se.section_bodies(nodes).collect(), key=lambda r: r.place)
    assert [(r.title, r.kind, r.items or r.text) for r in rows] == [("One\u00a0two", "heading", "One\u00a0two"), ("One\u00a0two", "paragraph", "a\x0bb"), ("One\u00a0two", "list", ["i", "j\x1fk"])]


def test_sections_read_pages_once(spark):
    nodes = dc.html_nodes(spark.createDataFrame([(1, "<h1>x</h1><p>y</p>")], "page_id long, html string"), runs=True)
    plan = se.section_bodies(nodes)._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("MapInArrow"), plan.count("Exchange "), plan.count("Join")) == (1, 1, 0)


def most_joined(spark, df) -> int:
    """The most rows that a join gave while df was collected."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    df.collect()
    most = 0
    for k in range(before, store.executionsCount()):
        execution = store.executionsList().apply(k).executionId()
        values, nodes = store.executionMetrics(execution), store.planGraph(execution).allNodes()
        for i in range(nodes.size()):
            if "Join" in nodes.apply(i).name():
                metrics = nodes.apply(i).metrics()
                for m in (metrics.apply(j) for j in range(metrics.size())):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


def test_tightest_span_makes_no_pairs(spark):
    """Nested spans around all points: each point is held by half of them, and one row of each kind answers."""
    n = 400
    spans = spark.range(n).selectExpr("1 AS book", "id AS hl", "if(id % 2 = 0, 500, 500 - id) AS es", "if(id % 2 = 0, 500 - id, 3) AS os", "if(id % 2 = 0, 500, 500 + id) AS ee", "if(id % 2 = 0, 600 + id, 3) AS oe")
    points = spark.range(n).selectExpr("1 AS book", "id AS note", "500L AS es", "500 + id % 50 AS os", "CAST(NULL AS LONG) AS ee", "CAST(NULL AS LONG) AS oe")
    found = sq.tightest_span(points, spans, "book", "note", "hl")
    assert {r.hl for r in found.collect()} == {0}
    assert n <= most_joined(spark, found) <= 2 * n
