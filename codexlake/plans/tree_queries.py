"""Passes over trees, sections with bodies, selectors and inherited styles; trees are pages or are derived from other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codexlake.operators import documents as dc
from codexlake.operators import graph as gr
from codexlake.operators import rewrite as rw
from codexlake.operators import sections as se
from codexlake.operators import sequence as sq
from codexlake.operators import trees as tr
from codexlake.operators import volumes as vo
from codexlake.plans.document_queries import NODES
from codexlake.plans.registry import query, read
from codexlake.plans.stream_queries import _folder as shared_folder
from codexlake.sources import archives as ar

#: Line items in one order per order: the children of a tree's root.
LINES = "WITH l AS (SELECT l_orderkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i, l_returnflag AS flag, l_linestatus AS status, l_quantity AS q FROM lineitem)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines dealt by page_id; what is named before the window stays known as dealt behind it."""
    w = Window.partitionBy("page_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "page_id").withColumn("i", F.row_number().over(w))
    return rows.select("page_id", F.col("i").cast("long").alias("i"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_quantity").alias("q"))


def _node(name: str, parent: str | None, at: tuple, tag: str, text: str = "''", attrs: str = "CAST(map() AS map<string, string>)", where: str = "true"):
    """What lines that `where` holds for give as a node; name, parent and all else are SQL, at the places of the path."""
    fields = F.expr(name).alias("node"), F.expr(parent or "CAST(NULL AS STRING)").alias("parent"), F.array(*(F.expr(str(a)).cast("long") for a in at)).alias("at"), F.expr(tag).alias("tag"), F.expr(attrs).alias("attrs"), F.expr(text).alias("text")
    return F.when(F.expr(where), F.struct(*fields))


def _root(tag: str):
    return _node("'r'", None, (0,), f"'{tag}'", where="i = 1")


def _packed(lines: DataFrame, *nodes) -> DataFrame:
    """Rows (page_id, nodes), where the lines are: an order's first line brings what the order has once."""
    return lines.select("page_id", F.array_compact(F.array(*nodes)).alias("nodes"))


def _tree(lines: DataFrame, *nodes) -> DataFrame:
    """Tree rows of the same."""
    return _packed(lines, *nodes).select("page_id", F.explode("nodes").alias("_n")).select("page_id", "_n.*")


def _outline(tree: DataFrame, *passes: rw.PagePass) -> DataFrame:
    """(page_id, at, depth, tag, text): the order and the depths of nodes, which make up a tree."""
    return rw.numbered(tree, *passes).select("page_id", (F.col("node_id") + 1).cast("long").alias("at"), "depth", "tag", "text")


@query(LINES + """, n AS (SELECT *, status = 'O' AS t, sum((status = 'F')::INTEGER) OVER (PARTITION BY page_id ORDER BY i) AS run FROM l),
o AS (SELECT page_id, 0 AS i, 0 AS depth, 'p' AS tag, '' AS text FROM l GROUP BY page_id UNION ALL SELECT page_id, i, 1, 'br', '' FROM n WHERE NOT t UNION ALL SELECT page_id, min(i), 1, '#text', string_agg(i || ';', '' ORDER BY i) FROM n WHERE t GROUP BY page_id, run)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS "at", depth, tag, text FROM o""")
def merged_runs(spark, sf_dir):
    tree = _tree(_lines(spark, sf_dir), _root("p"), _node("CAST(i AS STRING)", "'r'", ("i",), "if(status = 'O', '#text', 'br')", "if(status = 'O', concat(i, ';'), '')"))
    return _outline(rw.merged_runs(tree))


@query(LINES + """, n AS (SELECT *, CASE flag WHEN 'A' THEN 'ul' WHEN 'R' THEN 'ol' ELSE 'p' END AS tag FROM l), g AS (SELECT *, tag <> 'p' AND coalesce(lag(tag) OVER (PARTITION BY page_id ORDER BY i) = tag, false) AS goes FROM n),
o AS (SELECT page_id, 0 AS i, 0 AS k, 0 AS depth, 'div' AS tag, '' AS text FROM l GROUP BY page_id UNION ALL SELECT page_id, i, 0, 1, tag, '' FROM g WHERE NOT goes UNION ALL SELECT page_id, i, 1, 2, 'li', i || '' FROM g WHERE tag <> 'p')
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i, k) AS "at", depth, tag, text FROM o""")
def fused_lists(spark, sf_dir):
    lists = _node("CAST(i AS STRING)", "'r'", ("i",), "CASE flag WHEN 'A' THEN 'ul' WHEN 'R' THEN 'ol' ELSE 'p' END")
    return _outline(rw.fused_lists(_tree(_lines(spark, sf_dir), _root("div"), lists, _node("concat(i, '.li')", "CAST(i AS STRING)", ("i",), "'li'", "CAST(i AS STRING)", where="flag <> 'N'"))))


@query(LINES + """, n AS (SELECT *, flag <> 'R' AS inl FROM l), m AS (SELECT page_id, bool_or(inl) AND bool_or(NOT inl) AS mixed FROM n GROUP BY 1), g AS (SELECT n.*, mixed, inl AND NOT coalesce(lag(inl) OVER (PARTITION BY n.page_id ORDER BY i), false) AS starts FROM n JOIN m USING (page_id)),
o AS (SELECT page_id, 0 AS i, 0 AS k, 0 AS depth, 'div' AS tag, '' AS text FROM m UNION ALL SELECT page_id, i, 0, 1, 'div', '' FROM g WHERE mixed AND starts UNION ALL SELECT page_id, i, 1, CASE WHEN mixed AND inl THEN 2 ELSE 1 END, CASE flag WHEN 'A' THEN 'b' WHEN 'N' THEN 'i' ELSE 'p' END, i || '' FROM g)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i, k) AS "at", depth, tag, text FROM o""")
def wrapped_runs(spark, sf_dir):
    return _outline(rw.wrapped_runs(_tree(_lines(spark, sf_dir), _root("div"), _node("CAST(i AS STRING)", "'r'", ("i",), "CASE flag WHEN 'A' THEN 'b' WHEN 'N' THEN 'i' ELSE 'p' END", "CAST(i AS STRING)"))))


@query(LINES + """, p AS (SELECT page_id, page_id % 3 = 0 AS has FROM l GROUP BY 1), o AS (
SELECT page_id, [0] AS k, 0 AS depth, 'table' AS tag, '' AS text FROM p UNION ALL SELECT page_id, [1], 1, 'colgroup', '' FROM p WHERE page_id % 2 = 0
UNION ALL SELECT page_id, [2], 1, 'tbody', '' FROM p WHERE has UNION ALL SELECT DISTINCT page_id, CASE WHEN flag = 'A' AND status = 'F' THEN [2] ELSE [3] END, 1, CASE WHEN flag = 'A' AND status = 'F' THEN 'thead' ELSE 'tbody' END, '' FROM l WHERE page_id % 3 <> 0
UNION ALL SELECT page_id, [CASE WHEN page_id % 3 <> 0 AND NOT (flag = 'A' AND status = 'F') THEN 3 ELSE 2 END, i, 0], 2, 'tr', '' FROM l
UNION ALL SELECT page_id, [CASE WHEN page_id % 3 <> 0 AND NOT (flag = 'A' AND status = 'F') THEN 3 ELSE 2 END, i, 1], 3, CASE WHEN flag = 'A' THEN 'th' ELSE 'td' END, i || 'a' FROM l
UNION ALL SELECT page_id, [CASE WHEN page_id % 3 <> 0 AND NOT (flag = 'A' AND status = 'F') THEN 3 ELSE 2 END, i, 2], 3, CASE WHEN status = 'F' THEN 'th' ELSE 'td' END, i || 'b' FROM l)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) AS "at", depth, tag, text FROM o""")
def normal_tables(spark, sf_dir):
    """An order is a table, a line a row of two cells; every third has a body, every second a column group at its end."""
    third = "if(page_id % 3 = 0, 'body', 'r')"
    tree = _packed(
        _lines(spark, sf_dir), _root("table"), _node("'body'", "'r'", (1,), "'tbody'", where="i = 1 AND page_id % 3 = 0"), _node("'cols'", third, (9_999,), "'colgroup'", where="i = 1 AND page_id % 2 = 0"),
        _node("CAST(i AS STRING)", third, ("i",), "'tr'"), _node("concat(i, '.a')", "CAST(i AS STRING)", (1,), "if(flag = 'A', 'th', 'td')", "concat(i, 'a')"), _node("concat(i, '.b')", "CAST(i AS STRING)", (2,), "if(status = 'F', 'th', 'td')", "concat(i, 'b')"),
    )
    return _outline(tree, rw.table_sections)


@query(LINES + """, n AS (SELECT *, flag = 'R' AS said, status = 'F' AND q > 25 AS named FROM l), o AS (SELECT page_id, 0 AS i, 0 AS k, 0 AS depth, 'body' AS tag, '' AS text FROM l GROUP BY page_id
UNION ALL SELECT page_id, i, 0, 1, 'section', '' FROM n WHERE said OR named UNION ALL SELECT page_id, i, 1, 2, 'div', '' FROM n WHERE said UNION ALL SELECT page_id, i, 2, 3, 'span', i || '' FROM n WHERE said)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i, k) AS "at", depth, tag, text FROM o""")
def pruned_boxes(spark, sf_dir):
    """A section, a box in it and a span in that for each line; some spans have text, some sections an id."""
    section = _node("CAST(i AS STRING)", "'r'", ("i",), "'section'", attrs="if(status = 'F' AND q > 25, map('id', CAST(i AS STRING)), CAST(map() AS map<string, string>))")
    return _outline(rw.pruned(_tree(_lines(spark, sf_dir), _root("body"), section, _node("concat(i, '.d')", "CAST(i AS STRING)", (1,), "'div'"), _node("concat(i, '.s')", "concat(i, '.d')", (1,), "'span'", "if(flag = 'R', CAST(i AS STRING), '')"))))


@query(LINES + """, n AS (SELECT *, flag = 'R' AS blk, coalesce(sum((flag = 'R')::INTEGER) OVER (PARTITION BY page_id ORDER BY i), 0) AS f FROM l), m AS (SELECT page_id, bool_or(blk) AS some, bool_or(NOT blk) AS any_run, min_by(blk, i) AS first_blk FROM n GROUP BY 1),
o AS (SELECT page_id, 0 AS i, 0 AS k, 0 AS depth, 'div' AS tag, '' AS text FROM m
UNION ALL SELECT n.page_id, min(i), 1, 1, 'em', '' FROM n WHERE NOT blk GROUP BY n.page_id, f UNION ALL SELECT n.page_id, min(i), 2, 2, 'b', '' FROM n WHERE NOT blk GROUP BY n.page_id, f
UNION ALL SELECT page_id, i, 3, CASE WHEN blk THEN 1 ELSE 3 END, CASE WHEN blk THEN 'p' ELSE 'code' END, i || '' FROM n)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i, k) AS "at", depth, tag, text FROM o""")
def lifted_blocks(spark, sf_dir):
    """Lines in a b in an em: some are blocks, which part both."""
    return _outline(rw.lifted_blocks(_tree(_lines(spark, sf_dir), _root("div"), _node("'em'", "'r'", (0,), "'em'", where="i = 1"), _node("'b'", "'em'", (0,), "'b'", where="i = 1"), _node("CAST(i AS STRING)", "'b'", ("i",), "if(flag = 'R', 'p', 'code')", "CAST(i AS STRING)"))))


@query(NODES + """, b AS (SELECT n.page_id, n.node_id, EXISTS (SELECT 1 FROM nodes p WHERE p.page_id = n.page_id AND p.tag = 'p' AND list_contains(p.anc, n.node_id)) AS holds FROM nodes n WHERE n.tag = 'b'),
c AS (SELECT n.page_id, n.node_id, n.tag, len(n.anc) - (SELECT count(*) FROM b WHERE b.page_id = n.page_id AND list_contains(n.anc, b.node_id)) AS d, CASE n.tag WHEN 'b' THEN n.node_id WHEN 'br' THEN n.anc[-1] END AS run FROM nodes n),
o AS (SELECT c.page_id, c.node_id AS i, 1 AS k, c.tag, (d + (c.tag = 'br' AND b.node_id IS NOT NULL)::INTEGER + coalesce(b.holds, false)::INTEGER)::INTEGER AS depth FROM c LEFT JOIN b ON b.page_id = c.page_id AND b.node_id = c.run
  UNION ALL SELECT c.page_id, c.node_id, 0, 'div', d::INTEGER FROM c JOIN b USING (page_id, node_id) WHERE holds)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i, k) AS "at", depth, tag FROM o""")
def tree_passes(spark, sf_dir):
    """All passes over the pages, whose bold runs are never closed and so hold paragraphs; elements only."""
    nodes = rw.optimized(dc.html_nodes(read(spark, sf_dir, "pages"), runs=True)).where("tag <> '#text'")
    return nodes.select("page_id", F.row_number().over(Window.partitionBy("page_id").orderBy("pre")).cast("long").alias("at"), "depth", "tag")


@query(NODES + r""", own_blocks AS (SELECT page_id, node_id, CASE tag WHEN 'h1' THEN 'heading' WHEN 'p' THEN 'paragraph' ELSE 'list' END AS kind FROM nodes n WHERE tag IN ('h1', 'p', 'ul') AND NOT EXISTS (SELECT 1 FROM nodes a WHERE a.page_id = n.page_id AND list_contains(n.anc, a.node_id) AND a.tag IN ('h1', 'p', 'ul', 'b', 'li', 'a'))),
t AS (SELECT b.page_id, b.node_id, b.kind, trim(regexp_replace(string_agg(CASE WHEN n.tag = 'br' THEN ' ' ELSE n.said END, '' ORDER BY n.node_id), '\s+', ' ', 'g')) AS text FROM own_blocks b JOIN nodes n ON n.page_id = b.page_id AND (n.node_id = b.node_id OR list_contains(n.anc, b.node_id)) GROUP BY 1, 2, 3),
items AS (SELECT b.page_id, b.node_id, list(trim(regexp_replace(a.said, '\s+', ' ', 'g')) ORDER BY a.node_id) AS items FROM own_blocks b JOIN nodes a ON a.page_id = b.page_id AND a.tag = 'a' AND list_contains(a.anc, b.node_id) WHERE b.kind = 'list' AND trim(a.said) <> '' GROUP BY 1, 2),
o AS (SELECT t.*, items, last_value(CASE WHEN kind = 'heading' THEN t.node_id END IGNORE NULLS) OVER (PARTITION BY t.page_id ORDER BY t.node_id) AS sec FROM t LEFT JOIN items USING (page_id, node_id) WHERE CASE WHEN kind = 'list' THEN items IS NOT NULL ELSE text <> '' END)
SELECT o.page_id, o.sec AS section, h.text AS title, (row_number() OVER (PARTITION BY o.page_id, o.sec ORDER BY o.node_id) - CASE WHEN o.sec IS NULL THEN 0 ELSE 1 END)::INTEGER AS place, o.kind, CASE WHEN o.kind <> 'list' THEN o.text END AS text, CASE WHEN o.kind = 'list' THEN o.items END AS items FROM o LEFT JOIN t h ON h.page_id = o.page_id AND h.node_id = o.sec""")
def section_bodies(spark, sf_dir):
    """Blocks in their sections; sections are named by their heading's number among elements."""
    found = se.section_bodies(dc.html_nodes(read(spark, sf_dir, "pages"), runs=True))
    return found.select("page_id", F.col("number").alias("section"), "title", "place", "kind", "text", "items")


#: rule, step, child, tag, class, id
SELECTORS = [(1, 1, False, "body", None, None), (2, 1, False, "article", None, None), (2, 2, False, "p", None, None), (3, 1, False, "nav", None, None), (3, 2, True, "ul", None, None), (4, 1, False, "nav", None, None), (4, 2, False, None, None, None), (5, 1, False, None, "ad", None), (6, 1, False, "p", None, None), (6, 2, True, "b", None, None), (6, 3, True, "p", None, None), (7, 1, False, "ul", None, None), (7, 2, True, "a", None, None)]
#: rule, origin, ord, property, value, important
DECLARATIONS = [(1, 1, 1, "color", "black", False), (1, 1, 2, "margin", "8px", False), (2, 1, 3, "color", "gray", False), (3, 1, 4, "list-style", "none", False), (4, 1, 5, "color", "blue", False), (5, 0, 6, "color", "red", True), (5, 1, 7, "margin", "0", False), (6, 1, 8, "color", "green", False), (7, 1, 9, "color", "never", False)]


@query(NODES + """, up AS (SELECT n.page_id, n.node_id, a.node_id AS anc_id, a.tag AS atag, list_position(n.anc, a.node_id) AS d, len(n.anc) AS depth FROM nodes n JOIN nodes a ON a.page_id = n.page_id AND list_contains(n.anc, a.node_id)),
m AS (SELECT page_id, node_id, 1 AS rule FROM nodes WHERE tag = 'body' UNION ALL SELECT DISTINCT n.page_id, n.node_id, 2 FROM nodes n JOIN up u USING (page_id, node_id) WHERE n.tag = 'p' AND u.atag = 'article'
UNION ALL SELECT n.page_id, n.node_id, 3 FROM nodes n JOIN up u USING (page_id, node_id) WHERE n.tag = 'ul' AND u.atag = 'nav' AND u.d = u.depth UNION ALL SELECT DISTINCT page_id, node_id, 4 FROM up WHERE atag = 'nav' UNION ALL SELECT page_id, node_id, 5 FROM nodes WHERE class = 'ad'
UNION ALL SELECT n.page_id, n.node_id, 6 FROM nodes n JOIN up b ON b.page_id = n.page_id AND b.node_id = n.node_id AND b.d = b.depth AND b.atag = 'b' JOIN up p ON p.page_id = n.page_id AND p.node_id = n.node_id AND p.d = p.depth - 1 AND p.atag = 'p' WHERE n.tag = 'p'),
r(rule, weight, ord, property, value, important) AS (VALUES (1, 1, 1, 'color', 'black', 0), (1, 1, 2, 'margin', '8px', 0), (2, 2, 3, 'color', 'gray', 0), (3, 2, 4, 'list-style', 'none', 0), (4, 1, 5, 'color', 'blue', 0), (5, 100, 6, 'color', 'red', 1), (5, 100, 7, 'margin', '0', 0), (6, 3, 8, 'color', 'green', 0)),
d AS (SELECT page_id, node_id, property, arg_max(value, important * 1000000 + weight * 1000 + ord) AS value FROM m JOIN r USING (rule) GROUP BY ALL),
h AS (SELECT n.page_id, n.node_id, p.property, d.value AS own, (SELECT arg_max(x.value, u.d) FROM up u JOIN d x ON x.page_id = u.page_id AND x.node_id = u.anc_id AND x.property = p.property WHERE u.page_id = n.page_id AND u.node_id = n.node_id) AS above FROM nodes n CROSS JOIN (VALUES ('color'), ('list-style')) p(property) LEFT JOIN d ON d.page_id = n.page_id AND d.node_id = n.node_id AND d.property = p.property)
SELECT page_id, node_id, property, coalesce(own, above) AS value, own IS NOT NULL AS own FROM h WHERE coalesce(own, above) IS NOT NULL UNION ALL SELECT page_id, node_id, property, value, true FROM d WHERE property = 'margin'""")
def style_inherited(spark, sf_dir):
    """Selectors with descendants and children over the pages, the winning declarations, and what nodes inherit."""
    nodes = dc.html_nodes(read(spark, sf_dir, "pages"))
    selectors = spark.createDataFrame(SELECTORS, "rule int, step int, child boolean, tag string, class string, id string")
    declarations = spark.createDataFrame(DECLARATIONS, "rule int, origin int, ord int, property string, value string, important boolean")
    return tr.inherited(nodes, tr.winners(tr.selected(nodes, selectors), selectors, declarations), ("color", "list-style"))


@query("""
WITH h AS (SELECT l_orderkey % 40 AS book, l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id, l_partkey % 500 AS es, l_suppkey % 90 AS os, CASE WHEN l_returnflag <> 'N' THEN l_partkey % 500 + l_quantity::BIGINT % 7 * (l_linenumber - 1) END AS ee, CASE WHEN l_linestatus = 'O' THEN l_suppkey % 90 + l_linenumber * 3 END AS oe FROM lineitem WHERE l_discount > 0.02),
n AS (SELECT o_orderkey AS note, o_orderkey % 40 AS book, o_custkey % 500 AS es, o_orderkey % 97 AS os FROM orders),
m AS (SELECT n.note, h.id, coalesce(ee, h.es) - h.es AS we, coalesce(oe, h.os) - h.os AS wo FROM n JOIN h ON h.book = n.book AND (h.es, h.os) <= (n.es, n.os) AND (n.es, n.os) <= (coalesce(ee, h.es), coalesce(oe, h.os)))
SELECT n.book, n.note, (SELECT arg_min(id, (we, wo, id)) FROM m WHERE m.note = n.note) AS highlight FROM n
""")
def note_attachments(spark, sf_dir):
    """Notes and the tightest highlight around each, by element and offset."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = read(spark, sf_dir, "lineitem").where("l_discount > 0.02").withColumn("id", F.col("l_orderkey") * 1000 + F.row_number().over(w))
    spans = rows.select((F.col("l_orderkey") % 40).alias("book"), "id", (F.col("l_partkey") % 500).alias("es"), (F.col("l_suppkey") % 90).alias("os"), F.expr("CASE WHEN l_returnflag <> 'N' THEN l_partkey % 500 + CAST(l_quantity AS BIGINT) % 7 * (l_linenumber - 1) END").alias("ee"), F.expr("CASE WHEN l_linestatus = 'O' THEN l_suppkey % 90 + l_linenumber * 3 END").alias("oe"))
    notes = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("note"), (F.col("o_orderkey") % 40).alias("book"), (F.col("o_custkey") % 500).alias("es"), (F.col("o_orderkey") % 97).alias("os"), F.lit(None).cast("long").alias("ee"), F.lit(None).cast("long").alias("oe"))
    return sq.tightest_span(notes, spans, "book", "note", "id").withColumnRenamed("id", "highlight")


# -- collections and reading orders ----------------------------------------------------------------------------------

#: Users as collections: events are documents; an opening needs two of three kinds of evidence.
COLLECTION = """WITH d AS (SELECT user_id AS book, event_id AS ord, 'd' || event_id AS path, (event_type = 'signup')::INTEGER + (value > 50)::INTEGER + (event_id % 4 = 0)::INTEGER >= 2 AS opens FROM events),
v AS (SELECT book, ord, path, CASE WHEN sum(opens::INTEGER) OVER (PARTITION BY book) < 2 THEN 1 ELSE greatest(sum(opens::INTEGER) OVER (PARTITION BY book ORDER BY ord), 1) END::BIGINT AS volume FROM d)"""


def _collection(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Documents with their volumes, references among documents, sheets, fonts and images, and the files that there are."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("book"), F.col("event_id").alias("ord"), "event_type", "value")
    kinds = {"label": F.col("event_type") == "signup", "rights": F.col("value") > 50, "contents": F.col("ord") % 4 == 0}
    evidence = e.select("book", "ord", F.explode(F.array_compact(F.array(*(F.when(c, k) for k, c in kinds.items())))).alias("kind"))
    documents = vo.voted_cuts(e.select("book", "ord", F.concat(F.lit("d"), "ord").alias("path")), evidence, "book", "ord")
    books = e.select("book").distinct()
    name = lambda letter, n: F.concat(F.lit(letter), n)
    n = books.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(39))))
    own = e.select("book", name("d", F.col("ord")).alias("src"), F.explode(F.array(name("r", F.col("ord") % 40), name("d", F.col("ord") + 7))).alias("dst"))
    more = n.where("n % 3 <> 0").select("book", name("r", F.col("n")).alias("src"), name("r", (F.col("n") * 3 + 1) % 47).alias("dst"))
    files = n.select("book", name("r", F.col("n")).alias("path")).unionByName(documents.select("book", "path"))
    return documents, own.unionByName(more), files


@query(COLLECTION + """, g AS (SELECT DISTINCT book, volume, 'r' || (ord % 40) AS path FROM v), e AS (SELECT 'r' || n AS src, 'r' || ((n * 3 + 1) % 47) AS dst FROM range(40) t(n) WHERE n % 3 <> 0 AND (n * 3 + 1) % 47 < 40),
c AS (WITH RECURSIVE w AS (SELECT book, volume, path FROM g UNION SELECT w.book, w.volume, e.dst FROM w JOIN e ON e.src = w.path) SELECT * FROM w),
m AS (SELECT book, path, count(*) > 1 AS many FROM c GROUP BY 1, 2), u AS (SELECT c.book, c.volume, count(*) AS resources, count(*) FILTER (many) AS shared FROM c JOIN m USING (book, path) GROUP BY 1, 2)
SELECT v.book, v.volume, min(ord) AS first, max(ord) AS last, count(*) AS documents, max(resources) AS resources, max(shared) AS shared FROM v JOIN u ON u.book = v.book AND u.volume = v.volume GROUP BY 1, 2""")
def volume_closure(spark, sf_dir):
    """Volumes of the collections, with what their documents reach through sheets and fonts."""
    return vo.volume_resources(*_collection(spark, sf_dir), "book", "ord")


#: Conversations as books: turns are a spine, the navigation names two of three of them by their text.
SPINE = """WITH d AS (SELECT conv_id AS book, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, text, 'f' || right('0' || ((turn * 7) % 10), 2) AS file FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY CASE WHEN book % 4 = 0 THEN '' ELSE left(text, 3) END, turn) AS place FROM d WHERE turn % 3 <> 1)"""


def _spine(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("at"), "text", F.concat(F.lit("d"), F.col("turn")).alias("id"))
    docs = c.withColumn("file", F.concat(F.lit("f"), F.lpad((F.col("at") * 7 % 10).cast("string"), 2, "0")))
    key = F.when(F.col("book") % 4 == 0, "").otherwise(F.left("text", F.lit(3)))
    named = c.where("at % 3 <> 1").select("book", F.row_number().over(Window.partitionBy("book").orderBy(key, "at")).alias("place"), "id", F.left("text", F.lit(5)).alias("label"))
    return docs, named


@query(SPINE + """, a AS (SELECT d.book, d.turn, d.pos, last_value(n.place IGNORE NULLS) OVER (PARTITION BY d.book ORDER BY d.pos ROWS UNBOUNDED PRECEDING) AS anchor FROM d LEFT JOIN n USING (book, turn))
SELECT book, 'd' || turn AS id, pos::INTEGER AS "at", (row_number() OVER (PARTITION BY book ORDER BY anchor NULLS FIRST, pos) - 1)::INTEGER AS proposed FROM a""")
def spine_order(spark, sf_dir):
    return vo.repaired_order(*_spine(spark, sf_dir), "book")


@query(SPINE + """, a AS (SELECT d.*, last_value(n.place IGNORE NULLS) OVER (PARTITION BY d.book ORDER BY d.pos ROWS UNBOUNDED PRECEDING) AS anchor, 'd' || d.turn AS id FROM d LEFT JOIN n USING (book, turn)),
p AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY anchor NULLS FIRST, pos) - 1 AS proposed, id < lag(id) OVER (PARTITION BY book ORDER BY pos) AS i, file < lag(file) OVER (PARTITION BY book ORDER BY pos) AS f FROM a),
x AS (SELECT book, place, left(text, 5) AS label, lead(pos) OVER (PARTITION BY book ORDER BY place) < pos AS fell FROM n), y AS (SELECT book, count(*) FILTER (fell) AS descents, arg_min(label, place) FILTER (fell) AS said FROM x GROUP BY 1)
SELECT p.book, coalesce(max(descents), 0) AS descents, CASE WHEN max(descents) > 0 THEN count(*) FILTER (pos <> proposed) ELSE 0 END AS moved, count(*) >= 3 AND (NOT bool_or(coalesce(i, false)) OR NOT bool_or(coalesce(f, false))) AS machine_sorted, max(said) AS first_out_of_order FROM p LEFT JOIN y ON y.book = p.book GROUP BY p.book""")
def spine_misordering(spark, sf_dir):
    return vo.misordering(*_spine(spark, sf_dir), "book")


@query("""
WITH l AS (SELECT l_suppkey % 50 AS book, l_partkey % 90 AS src, (l_orderkey * 7 + l_linenumber) % 90 AS dst, l_quantity::BIGINT AS pos FROM lineitem), e AS (SELECT book, src, dst, min(pos) AS pos FROM l WHERE src <> dst GROUP BY 1, 2, 3)
SELECT x.book, x.src AS reference, x.dst AS note, CASE WHEN x.pos = y.pos THEN 'unordered' ELSE 'ordered' END AS kind FROM e x JOIN e y ON x.book = y.book AND x.src = y.dst AND x.dst = y.src WHERE x.pos < y.pos OR (x.pos = y.pos AND x.src < x.dst)
""")
def note_references(spark, sf_dir):
    """Anchors that point to one another, told apart as reference and note by their order."""
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("book"), (F.col("l_partkey") % 90).alias("src"), ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 90).alias("dst"), F.col("l_quantity").cast("long").alias("at"))
    return gr.note_pairs(rows, "book")


# -- e-books ---------------------------------------------------------------------------------------------------------


@query("SELECT page_id % 40 || '.epub' AS archive, (row_number() OVER (PARTITION BY page_id % 40 ORDER BY page_id))::INTEGER AS spine, 'OEBPS/c' || lpad(page_id::VARCHAR, 8, '0') || '.xhtml' AS path, md5(html) AS html FROM pages")
def books_written_and_read(spark, sf_dir):
    """Pages as e-books in the shared folder, and their chapters read back from the archives in reading order."""
    pages = read(spark, sf_dir, "pages").select((F.col("page_id") % 40).alias("book"), "page_id", "html", "url")
    at = f"{shared_folder(spark)}/books"
    ar.write_archives(ar.book_members(pages, "book", "page_id", "html", "url"), at)
    found = ar.chapters(spark, at, glob="*.epub")
    return found.select("archive", (F.col("spine") + 1).alias("spine"), "path", F.md5(F.col("html").cast("binary")).alias("html"))
