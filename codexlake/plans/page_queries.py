"""Queries of links, chapters, contents, positions and comparisons, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexlake.operators import documents as dc
from codexlake.operators import pages as pg
from codexlake.plans.registry import query, read

_HREFS = r"regexp_extract_all(html, '<a\b[^>]*?\bhref\s*=\s*[\"'']([^\"'']*)[\"'']', 1)"

# -- links -----------------------------------------------------------------------------------------------------------

_LINKED = rf"""
WITH p AS (SELECT page_id, {_HREFS} AS l, html FROM pages), owners AS (SELECT l[1] AS path, min(page_id) AS target FROM p WHERE len(l) > 0 GROUP BY 1),
e AS (SELECT page_id, ord, CASE ord % 5 WHEN 0 THEN 'http://x' || href WHEN 1 THEN '#h1' WHEN 2 THEN href || '#table' WHEN 3 THEN substr(href, 2) || '#nav' ELSE href END AS href, href AS own, l1 FROM (SELECT page_id, l[1] AS l1, unnest(l) AS href, generate_subscripts(l, 1) - 1 AS ord FROM p)),
t AS (SELECT e.*, CASE ord % 5 WHEN 1 THEN a.target ELSE b.target END AS t FROM e LEFT JOIN owners a ON a.path = e.l1 LEFT JOIN owners b ON b.path = e.own),
r AS (SELECT page_id, ord, href, CASE WHEN ord % 5 = 0 THEN 'external' WHEN t IS NULL OR ord % 5 = 2 THEN 'broken' WHEN ord % 5 = 4 THEN 'chapter' ELSE 'internal' END AS kind, t FROM t)
"""


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages, whose path is their first link's; ids are the names of a page's elements."""
    pages = read(spark, sf_dir, "pages")
    hrefs = dc.links(F.col("html"))
    rows = pages.select("page_id", F.get(hrefs, 0).alias("path"), F.posexplode(hrefs).alias("ord", "own"))
    k = F.col("ord") % 5
    href = F.when(k == 0, F.concat(F.lit("http://x"), "own")).when(k == 1, "#h1").when(k == 2, F.concat("own", F.lit("#table"))).when(k == 3, F.concat(F.expr("substr(own, 2)"), F.lit("#nav"))).otherwise(F.col("own"))
    links = rows.select("page_id", "path", "ord", href.alias("href"))
    targets = rows.where("ord = 0").groupBy(F.col("path").alias("target_path")).agg(F.min("page_id").alias("target"))
    anchors = pages.select(F.col("page_id").alias("target"), F.explode(F.array_distinct(dc.open_tags(F.col("html")))).alias("id"))
    return pg.resolved_links(links, targets, anchors)


@query(_LINKED + "SELECT page_id, ord, href, kind, CASE WHEN kind IN ('chapter', 'internal') THEN t END AS target FROM r")
def link_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir)


@query(_LINKED + "SELECT t AS target, count(*) AS n, count(DISTINCT page_id) AS pages FROM r WHERE kind IN ('chapter', 'internal') GROUP BY 1")
def link_backrefs(spark, sf_dir):
    """How often each page is pointed at, and from how many pages."""
    per = _resolved(spark, sf_dir).where("target IS NOT NULL").groupBy("target", "page_id").agg(F.count("*").alias("n"))
    return per.groupBy("target").agg(F.sum("n").alias("n"), F.count("*").alias("pages"))


# -- chapters --------------------------------------------------------------------------------------------------------


@query(r"""
WITH h AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN '<body><img src="c.png"><p> <image href="d.png"/></p><img src="c.png"></body>' ELSE replace(html, '<h1>', '<img src="a' || page_id % 3 || '.png"><ruby>漢<rp>(</rp><rt>かん</rt></ruby><h1>') END AS html FROM pages),
t AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<head\b.*?</head\s*>|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<rt\b.*?</rt\s*>|<rp\b.*?</rp\s*>|<!--.*?-->', '', 'g'), '(?s)<[^>]*>', '', 'g'), '[\n\r]', '', 'g') AS t FROM h)
SELECT page_id, length(trim(regexp_replace(replace(replace(replace(replace(t, '&middot;', '·'), '&copy;', '©'), '&quot;', chr(34)), '&amp;', '&'), '\s+', ' ', 'g'))) AS text_chars, true AS has_image, page_id % 7 = 0 AS image_only, CASE WHEN page_id % 7 = 0 THEN 'c.png,d.png' ELSE 'a' || page_id % 3 || '.png' END AS images FROM t
""")
def chapter_summary(spark, sf_dir):
    """What each page holds; an image and a reading are put in, and some pages are images alone."""
    marked = F.replace("html", F.lit("<h1>"), F.concat(F.lit('<img src="a'), (F.col("page_id") % 3).cast("string"), F.lit('.png"><ruby>漢<rp>(</rp><rt>かん</rt></ruby><h1>')))
    html = F.when(F.col("page_id") % 7 == 0, '<body><img src="c.png"><p> <image href="d.png"/></p><img src="c.png"></body>').otherwise(marked)
    s = pg.summary(html)
    return read(spark, sf_dir, "pages").select("page_id", *(s[k].alias(k) for k in ("text_chars", "has_image", "image_only")), F.array_join(s["images"], ",").alias("images"))


@query(r"""
SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<head\b.*?</head\s*>|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<nav\b.*?</nav\s*>|<footer\b.*?</footer\s*>|<!--.*?-->', '', 'g'), '(?i)<br\b[^>]*>', ' ', 'g'), '(?s)<[^>]*>', '', 'g'), '\s+', ' ', 'g'))) AS digest FROM pages
""")
def text_collection(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.md5(pg.collected_text(F.col("html"), ("nav", "footer")).cast("binary")).alias("digest"))


@query(r"""
WITH RECURSIVE t AS (SELECT doc_id, text, lower(replace(text, 'İ', 'I')) AS low FROM documents), h AS (SELECT doc_id, 0 AS hit, strpos(low, 'éré') AS "at" FROM t WHERE contains(low, 'éré')
UNION ALL SELECT h.doc_id, h.hit + 1, "at" + 2 + strpos(substr(low, "at" + 3), 'éré') FROM h JOIN t ON t.doc_id = h.doc_id WHERE strpos(substr(low, "at" + 3), 'éré') > 0)
SELECT h.doc_id, hit, "at"::INTEGER AS "at", regexp_extract(substr(text, 1, "at"::BIGINT - 1), '[^\n]{0,32}$') AS before, substr(text, "at"::BIGINT, 3) AS found, regexp_extract(substr(text, "at"::BIGINT + 3), '^[^\n]{0,32}') AS after FROM h JOIN t ON t.doc_id = h.doc_id
""")
def chapter_search(spark, sf_dir):
    return pg.find(read(spark, sf_dir, "documents"), "ÉrÉ", "doc_id", "text")


# -- contents --------------------------------------------------------------------------------------------------------


@query("""
WITH r AS (SELECT conv_id, turn, length(text) % 3 AS i, text FROM conversations), g AS (SELECT *, min(i) OVER (PARTITION BY conv_id) AS base FROM r), d AS (SELECT *, count(*) FILTER (i > base) OVER (PARTITION BY conv_id) AS deep FROM g)
SELECT conv_id, turn, CASE WHEN deep >= 3 THEN (SELECT max(p.turn) FROM r p WHERE p.conv_id = d.conv_id AND p.turn < d.turn AND p.i < d.i) END AS parent, CASE WHEN deep >= 3 THEN 'x' || left(text, 5) ELSE repeat('  ', i) || 'x' || left(text, 5) END AS label FROM d
""")
def nest_by_indent(spark, sf_dir):
    label = F.concat(F.repeat(F.lit("  "), F.length("text") % 3), F.lit("x"), F.left("text", F.lit(5)))
    return pg.nested_by_indent(read(spark, sf_dir, "conversations").select("conv_id", "turn", label.alias("label")), "conv_id", "turn", "label").select("conv_id", "turn", "parent", "label")


def _books(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Conversations as books: turns are documents; some turns are declared, some linked from a contents page, some have headings."""
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), "turn", F.concat(F.lit("d"), "turn").alias("target"), F.left("text", F.lit(8)).alias("label"))
    entry = lambda d, label: d.select("book", F.col("turn").alias("ord"), label.alias("label"), "target")
    front = F.when((F.col("book") % 2 == 0) & (F.col("turn") == 0), F.concat(F.lit("Cover "), "label")).otherwise(F.col("label"))
    return entry(c.where("turn % 3 = 0"), front), entry(c.where("book % 3 = 0 AND turn % 2 = 1"), F.concat(F.lit("L"), "label")), entry(c.where("turn % 2 = 0"), F.concat(F.lit("H"), "label")), c.select("book", "target", F.col("turn").cast("long").alias("pos"))


@query("""
WITH c AS (SELECT conv_id AS book, turn, 'd' || turn AS target, left(text, 8) AS label FROM conversations), a AS (SELECT book, turn, CASE WHEN book % 2 = 0 AND turn = 0 THEN 'Cover ' || label ELSE label END AS label, target FROM c WHERE turn % 3 = 0),
l AS (SELECT book, turn, 'L' || label AS label, target FROM c WHERE book % 3 = 0 AND turn % 2 = 1), h AS (SELECT book, turn, 'H' || label AS label, target FROM c WHERE turn % 2 = 0),
u AS (SELECT book, CASE WHEN (SELECT count(*) FROM l WHERE l.book = b.book) >= 3 THEN 'l' WHEN (SELECT count(*) FROM a WHERE a.book = b.book AND NOT starts_with(label, 'Cover ')) >= 3 THEN '' WHEN (SELECT count(*) FROM h WHERE h.book = b.book) >= 3 THEN 'h' ELSE '' END AS use FROM (SELECT DISTINCT book FROM c) b),
x AS (SELECT *, 0 AS side FROM a UNION ALL SELECT l.*, 1 FROM l JOIN u USING (book) WHERE use = 'l' UNION ALL SELECT h.*, 1 FROM h JOIN u USING (book) WHERE use = 'h')
SELECT book, row_number() OVER (PARTITION BY book ORDER BY turn, side)::INTEGER AS place, label, target, side, NULL::INTEGER AS parent FROM x WHERE side = 0 OR NOT EXISTS (SELECT 1 FROM a WHERE a.book = x.book AND a.target = x.target)
""")
def toc_repair(spark, sf_dir):
    return pg.repaired_contents(*_books(spark, sf_dir), "book")


@query("""
WITH RECURSIVE r AS (SELECT conv_id, turn, 1 + length(text) % 4 AS level FROM conversations), e AS (SELECT conv_id, turn, (SELECT max(p.turn) FROM r p WHERE p.conv_id = r.conv_id AND p.turn < r.turn AND p.level < r.level) AS parent FROM r),
w AS (SELECT conv_id, turn, 1 AS d FROM e WHERE parent IS NULL UNION ALL SELECT e.conv_id, e.turn, d + 1 FROM w JOIN e ON e.conv_id = w.conv_id AND e.parent = w.turn)
SELECT conv_id, count(*) AS n, max(d) AS depth FROM w GROUP BY 1
""")
def toc_depth(spark, sf_dir):
    from codexlake.operators import sequence as sq

    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", (1 + F.length("text") % 4).alias("level"))
    return pg.depth_and_count(sq.parents_by_level(rows, "conv_id", "turn", "level", "turn"), "conv_id", "turn", "parent").select("conv_id", "n", "depth")


@query(r"""
WITH c AS (SELECT DISTINCT page_id, unnest(flatten(list_transform(regexp_extract_all(html, 'class="([^"]*)"', 1), lambda x: string_split(x, ' ')))) AS name FROM pages)
SELECT page_id, '.' || n AS selector FROM pages, (VALUES ('ad'), ('note'), ('lead')) v(n) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.page_id = pages.page_id AND c.name = n)
""")
def unused_rules(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    css = F.lit(".ad{color:red} p.note{margin:0} .lead{display:block}")
    rules = pages.select("page_id", F.explode(F.regexp_extract_all(css, F.lit(r"\.([a-zA-Z][a-zA-Z0-9_-]*)\s*\{"), F.lit(1))).alias("name")).withColumn("selector", F.concat(F.lit("."), "name"))
    used = pages.select("page_id", F.explode(F.flatten(F.transform(F.regexp_extract_all("html", F.lit('class="([^"]*)"'), F.lit(1)), lambda x: F.split(x, " ")))).alias("name"))
    return pg.unused_rules(rules, used)


# -- positions -------------------------------------------------------------------------------------------------------

_AXIS = "SELECT conv_id, turn, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pid FROM conversations"


def _axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codexlake.operators import sequence as sq

    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "text", sq.running_axis(F.length("text"), "conv_id", ["turn"]).alias("pid"))


@query(f"""
WITH b AS ({_AXIS}), a AS (SELECT conv_id, turn, pid + 7 * turn AS pid FROM b), s AS (SELECT conv_id, turn AS id, turn AS eid, 3 AS off, turn AS to_eid, 5 AS to_off FROM b),
x AS (SELECT s.*, b.pid + 3 AS p0, a.pid + 5 AS p1, (SELECT greatest(count(*), 1) FROM b q WHERE q.conv_id = s.conv_id AND q.pid <= b.pid + 3) AS l0, (SELECT greatest(count(*), 1) FROM a q WHERE q.conv_id = s.conv_id AND q.pid <= a.pid + 5) AS l1 FROM s JOIN b ON b.conv_id = s.conv_id AND b.turn = s.eid JOIN a ON a.conv_id = s.conv_id AND a.turn = s.to_eid),
y AS (SELECT *, CASE id % 3 WHEN 0 THEN l0 WHEN 1 THEN p0 ELSE -5 END AS stored FROM x)
SELECT conv_id, id, CASE WHEN stored = l0 THEN l1 WHEN stored = p0 THEN p1 ELSE stored END AS linear_pos FROM y
""")
def position_rescale(spark, sf_dir):
    """Positions move from one build to another on the scale they were written on; page numbers stay."""
    b = _axis(spark, sf_dir).withColumnRenamed("turn", "eid")
    before, after = b.select("conv_id", "eid", "pid"), b.select("conv_id", "eid", (F.col("pid") + 7 * F.col("eid")).alias("pid"))
    k = F.col("eid") % 3
    saved = b.select("conv_id", F.col("eid").alias("id"), "eid", F.lit(3).alias("off"), F.col("eid").alias("to_eid"), F.lit(5).alias("to_off"), F.when(k == 0, F.col("eid") + 1).when(k == 1, F.col("pid") + 3).otherwise(-5).alias("linear_pos"))
    starts = lambda d: d.select("conv_id", F.col("pid").alias("at"))
    return pg.rescaled(saved, before, after, starts(before), starts(after), "conv_id")


@query("""
WITH n AS (SELECT conv_id, turn AS id, CASE turn % 4 WHEN 0 THEN 'highlight' WHEN 1 THEN 'note' WHEN 2 THEN 'bookmark' ELSE 'ink' END AS kind, turn AS a, 2 AS off_a, CASE WHEN turn % 4 = 1 THEN turn ELSE turn + 1 END AS b, CASE WHEN conv_id % 5 = 0 AND turn % 4 = 1 THEN 2 ELSE 9 END AS off_b FROM conversations)
SELECT n.conv_id, id, kind, CASE WHEN kind = 'bookmark' THEN c.text WHEN kind = 'note' AND off_b = 2 OR kind = 'ink' THEN '' WHEN kind = 'note' THEN substr(c.text, 3, 8) ELSE substr(c.text, 3) || coalesce(left(d.text, 10), '') END AS text
FROM n JOIN conversations c ON c.conv_id = n.conv_id AND c.turn = a LEFT JOIN conversations d ON d.conv_id = n.conv_id AND d.turn = a + 1
""")
def annotation_text(spark, sf_dir):
    c, k = read(spark, sf_dir, "conversations"), F.col("turn") % 4
    kind = F.when(k == 0, "highlight").when(k == 1, "note").when(k == 2, "bookmark").otherwise("ink")
    notes = c.select("conv_id", F.col("turn").alias("id"), kind.alias("kind"), F.col("turn").alias("a"), F.lit(2).alias("off_a"), F.when(k == 1, F.col("turn")).otherwise(F.col("turn") + 1).alias("b"), F.when((F.col("conv_id") % 5 == 0) & (k == 1), 2).otherwise(9).alias("off_b"))
    return pg.annotation_text(c, notes, "conv_id", "turn", "text")


@query("SELECT user_id, count(*) AS n, bool_and(coalesce(v >= before, true)) AS ordered FROM (SELECT user_id, v, lag(v) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM (SELECT user_id, event_id, CASE WHEN user_id % 2 = 0 THEN event_id ELSE value END AS v FROM events)) GROUP BY 1")
def monotone_positions(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("v", F.when(F.col("user_id") % 2 == 0, F.col("event_id").cast("double")).otherwise(F.col("value")))
    return pg.monotone(rows, "user_id", "event_id", "v")


@query(f"""
WITH b AS ({_AXIS}), q AS (SELECT event_id, event_id % 100 AS conv_id, event_id % 700 AS "at" FROM events), m AS (SELECT q.event_id, q.conv_id, "at", max(b.turn) AS turn FROM q JOIN b ON b.conv_id = q.conv_id AND b.pid <= "at" GROUP BY ALL)
SELECT event_id, m.turn AS eid, "at" - b.pid AS off, substr(b.text, ("at" - b.pid + 1)::BIGINT, 12) AS slice FROM m JOIN b ON b.conv_id = m.conv_id AND b.turn = m.turn
""")
def position_query(spark, sf_dir):
    """The element and offset of points on the reading axis, and the text that starts there."""
    from codexlake.operators import sequence as sq

    axis = _axis(spark, sf_dir)
    points = read(spark, sf_dir, "events").select((F.col("event_id") % 100).alias("conv_id"), (F.col("event_id") % 700).alias("pid"), "event_id")
    found = sq.as_of(points, axis.select("conv_id", "pid", "turn"), "conv_id", "pid", "turn").where("turn IS NOT NULL").withColumnRenamed("pid", "at")
    out = found.join(axis, ["conv_id", "turn"])
    off = F.col("at") - F.col("pid")
    return out.select("event_id", F.col("turn").alias("eid"), off.alias("off"), F.substring("text", off + 1, F.lit(12)).alias("slice"))


# -- comparisons -----------------------------------------------------------------------------------------------------


@query("""
SELECT p_partkey, p_size IN (1, 7, 50) AS eq, p_size <> 1 OR p_size <> 7 AS ne, p_size < 50 AS lt, p_size = 1 AS value_eq, p_size > 1 AS value_gt, false AS value_none, p_brand IN ('Brand#12', '7') AS text_eq FROM part
""")
def sequence_comparisons(spark, sf_dir):
    """General comparisons hold for some pair, value comparisons for the first two; numbers as numbers."""
    size, some = F.array(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(".0 "))), F.array(F.lit("1"), F.lit("7"), F.lit("50"))
    none = F.array().cast("array<string>")
    return read(spark, sf_dir, "part").select(
        "p_partkey", pg.compared(size, some, "=").alias("eq"), pg.compared(size, F.array(F.lit("1"), F.lit("7")), "!=").alias("ne"), pg.compared(size, some, "<").alias("lt"), pg.compared(size, some, "=", general=False).alias("value_eq"),
        pg.compared(size, some, ">", general=False).alias("value_gt"), pg.compared(none, some, "=", general=False).alias("value_none"), pg.compared(F.array("p_brand"), F.array(F.lit("Brand#12"), F.lit("7")), "=").alias("text_eq"),
    )
