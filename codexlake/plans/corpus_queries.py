"""More document and catalogue queries: positions, spans of text, styles, summaries, mutations, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codexlake.functions import text as fn
from codexlake.operators import documents as dc
from codexlake.operators import graph as gr
from codexlake.operators import positions as ps
from codexlake.operators import reconcile as rc
from codexlake.operators import sequence as sq
from codexlake.plans.registry import query, read

# -- scans and listings ----------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey IN (7, 100, 4242)")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").where(F.col("o_orderkey").isin(7, 100, 4242)).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT event_type, 'k' AS path, 'BIGINT' AS kind, count(*) AS n, max((props->>'k')::BIGINT) AS top FROM events WHERE props->>'k' IS NOT NULL GROUP BY 1")
def dynamic_paths(spark, sf_dir):
    """A store of dynamic values as path rows: kinds, counts and the greatest value of each path."""
    return ps.variant_paths(read(spark, sf_dir, "events"), "event_type", "props")


@query("SELECT event_type AS kind, count(*) AS n, sum(strlen(props))::BIGINT AS bytes FROM events GROUP BY 1")
def part_listing(spark, sf_dir):
    from codexlake.sources.files import listing

    return listing(read(spark, sf_dir, "events").withColumnRenamed("event_type", "kind"), "kind", "props")


@query("""
WITH a AS (SELECT DISTINCT p_brand AS w FROM part WHERE p_size % 2 = 0 UNION SELECT DISTINCT p_type FROM part WHERE p_size % 2 = 1), d AS (SELECT w, dense_rank() OVER (ORDER BY w) AS id FROM a)
SELECT p.p_partkey, d.id FROM part p JOIN d ON d.w = CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_type END
""")
def merged_dictionaries(spark, sf_dir):
    """Two tables with dictionaries of their own come under one."""
    part = read(spark, sf_dir, "part")
    rows = part.select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_type")).alias("w"))
    return rows.join(ps.dictionary(rows, "w"), "w").select("p_partkey", "id")


# -- positions and spans ---------------------------------------------------------------------------------------------


@query("""
WITH a AS (SELECT user_id, event_id AS off, event_id * 2 AS pos FROM events WHERE event_type = 'signup'), q AS (SELECT user_id, event_id AS off FROM events WHERE event_type = 'error')
SELECT q.off AS event_id, a.pos + q.off - a.off AS pos FROM q ASOF LEFT JOIN a ON a.user_id = q.user_id AND q.off >= a.off
""")
def position_extrapolate(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    anchors = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("off"), (F.col("event_id") * 2).alias("pos"))
    asked = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("off"), "event_id")
    return sq.as_of(asked, anchors, "user_id", "off", "pos").select("event_id", (F.col("pos") + F.col("off") - F.col("pos_at")).alias("pos"))


@query("""
WITH s AS (SELECT conv_id, 0 AS a, 10 AS off_a, 1 AS b, 20 AS off_b FROM conversations GROUP BY 1)
SELECT s.conv_id, string_agg(CASE WHEN turn = a THEN substr(text, off_a + 1) WHEN turn = b THEN substr(text, 1, off_b) ELSE text END, '' ORDER BY turn) AS text FROM s JOIN conversations c ON c.conv_id = s.conv_id AND c.turn BETWEEN a AND b GROUP BY 1
""")
def span_text(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    spans = c.select("conv_id").distinct().select("conv_id", F.lit(0).alias("a"), F.lit(10).alias("off_a"), F.lit(1).alias("b"), F.lit(20).alias("off_b"))
    return ps.span_text(c, spans, "conv_id", "turn", "text")


@query("""
WITH a AS (SELECT conv_id, turn, text FROM conversations WHERE turn % 2 = 0), b AS (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE turn % 2 = 1)
SELECT a.conv_id, count(b.turn) AS surviving, count(*) FILTER (a.text = b.text) AS same, count(*) AS total FROM a LEFT JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn GROUP BY 1
""")
def keyed_survival(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    a, b = c.where("turn % 2 = 0").select("conv_id", "turn", "text"), c.where("turn % 2 = 1").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("other"))
    both = a.join(b, ["conv_id", "turn"], "left")
    return both.groupBy("conv_id").agg(F.count("other").alias("surviving"), F.count_if(F.col("text") == F.col("other")).alias("same"), F.count("*").alias("total"))


@query("SELECT user_id, count(*) FILTER (moved) AS emitted, count(*) AS n FROM (SELECT user_id, coalesce(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 10, true) AS moved FROM events) GROUP BY 1")
def moved_enough(spark, sf_dir):
    """Values that moved by 10 or more since the one before are worth telling."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    moved = F.coalesce(F.abs(F.col("value") - F.lag("value").over(w)) >= 10, F.lit(True))
    return read(spark, sf_dir, "events").select("user_id", moved.alias("moved")).groupBy("user_id").agg(F.count_if("moved").alias("emitted"), F.count("*").alias("n"))


@query("SELECT event_id, event_type FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type")
def state_changes(spark, sf_dir):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return read(spark, sf_dir, "events").withColumn("before", before).where(~F.col("before").eqNullSafe(F.col("event_type"))).select("event_id", "event_type")


# -- names -----------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, list(n2.n_name ORDER BY n2.n_nationkey) AS names FROM customer JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN nation n2 ON n1.n_regionkey = n2.n_regionkey GROUP BY 1")
def names_of_person(spark, sf_dir):
    """All names of the class that a credited name belongs to; classes are gathered once, before they meet the credits."""
    people, n = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), read(spark, sf_dir, "nation")
    classes = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("c"))
    classes = classes.select("n_regionkey", F.transform("c", lambda x: x["n_name"]).alias("names"))
    return people.join(n, people.c_nationkey == n.n_nationkey).join(classes, "n_regionkey").select("c_custkey", "names")


@query("SELECT c_custkey, row_number() OVER (ORDER BY lower(c_mktsegment), c_custkey) AS place, array_to_string([c_name, upper(c_mktsegment)], ' & ') AS author FROM customer")
def nocase_order(spark, sf_dir):
    rows = read(spark, sf_dir, "customer")
    author = F.array_join(F.transform(F.array(F.array("c_name", F.lit("other")), F.array(F.upper("c_mktsegment"))), lambda x: F.get(x, 0)), " & ")
    return rows.select("c_custkey", F.row_number().over(Window.orderBy(F.lower("c_mktsegment"), "c_custkey")).cast("long").alias("place"), author.alias("author"))


@query("SELECT page_id, regexp_matches(d, '^[0-9]{4}(-(0[1-9]|1[0-2])(-(0[1-9]|[12][0-9]|3[01]))?)?$') AND (length(d) < 10 OR try_cast(d AS DATE) IS NOT NULL) AS valid FROM (SELECT page_id, (1990 + page_id % 40) || CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN '-02' WHEN 2 THEN '-02-' || lpad((1 + page_id % 31)::VARCHAR, 2, '0') ELSE '-13' END AS d FROM pages)")
def date_forms(spark, sf_dir):
    year = (1990 + F.col("page_id") % 40).cast("string")
    day = F.lpad((1 + F.col("page_id") % 31).cast("string"), 2, "0")
    date = F.concat(year, F.when(F.col("page_id") % 4 == 0, "").when(F.col("page_id") % 4 == 1, "-02").when(F.col("page_id") % 4 == 2, F.concat(F.lit("-02-"), day)).otherwise("-13"))
    return read(spark, sf_dir, "pages").select("page_id", ps.valid_date(date).alias("valid"))


@query(r"SELECT doc_id, len(r) AS n, coalesce(r[1], '') AS first FROM (SELECT doc_id, regexp_extract_all(text, '([A-Z][a-z]+)', 1) AS r FROM documents)")
def base_and_reading(spark, sf_dir):
    """base《reading》 pairs; the text's capitalised words stand in for bases."""
    text = F.regexp_replace("text", "([A-Z][a-z]+)", "｜$1《x》")
    pairs = ps.ruby_pairs(text)
    return read(spark, sf_dir, "documents").select("doc_id", F.size(pairs).cast("long").alias("n"), F.coalesce(F.get(pairs, 0)["base"], F.lit("")).alias("first"))


@query("SELECT page_id, url_decode(regexp_extract(replace(url, 'page=', 'page=%C3%A9%2B'), 'page=([^&#]*)', 1)) AS page FROM pages")
def percent_decoded(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", ps.percent_decode(F.regexp_extract(F.replace("url", F.lit("page="), F.lit("page=%C3%A9%2B")), "page=([^&#]*)", 1)).alias("page"))


# -- pages -----------------------------------------------------------------------------------------------------------


@query(r"""
WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<style[^>]*>(.*?)</style', 1)) AS css FROM pages), p AS (SELECT page_id, lower(trim(unnest(regexp_extract_all(css, '([a-zA-Z-]+)\s*:[^;{}]+[;}]', 1)))) AS property FROM s)
SELECT property, count(*) AS seen, property IN ('margin', 'color', 'display') AS supported FROM p GROUP BY 1
""")
def css_property_usage(spark, sf_dir):
    return ps.css_usage(read(spark, sf_dir, "pages"), "html", ("margin", "color", "display"))


@query(r"""
WITH c AS (SELECT DISTINCT page_id, unnest(flatten(list_transform(regexp_extract_all(html, 'class="([^"]*)"', 1), lambda x: string_split(x, ' ')))) AS name FROM pages)
SELECT page_id, name FROM c WHERE NOT EXISTS (SELECT 1 FROM (SELECT page_id, unnest(regexp_extract_all(html, '\.([a-zA-Z][a-zA-Z0-9_-]*)\s*\{', 1)) AS name FROM pages) r WHERE r.page_id = c.page_id AND r.name = c.name)
""")
def classes_without_rule(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    used = pages.select("page_id", F.explode(F.flatten(F.transform(F.regexp_extract_all("html", F.lit('class="([^"]*)"'), F.lit(1)), lambda x: F.split(x, " ")))).alias("name")).distinct()
    rules = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"\.([a-zA-Z][a-zA-Z0-9_-]*)\s*\{"), F.lit(1))).alias("name")).distinct()
    return used.join(rules, ["page_id", "name"], "left_anti")


@query("SELECT source, coalesce(arg_max(lang, (n, lang)) FILTER (lang <> 'en'), 'en') AS dominant, sum(n)::BIGINT AS n FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY 1")
def dominant_value(spark, sf_dir):
    """The most cited language that is not the default; the default where there is none."""
    n = read(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return n.groupBy("source").agg(F.coalesce(F.max_by(F.when(F.col("lang") != "en", F.col("lang")), F.when(F.col("lang") != "en", F.struct("n", "lang"))), F.lit("en")).alias("dominant"), F.sum("n").alias("n"))


@query(r"""
WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h([1-6])\b', 1))::INTEGER AS level, generate_subscripts(regexp_extract_all(html, '(?is)<h([1-6])\b', 1), 1) - 1 AS ord FROM pages)
SELECT page_id, ord, level, (SELECT max(p.ord) FROM h p WHERE p.page_id = h.page_id AND p.ord < h.ord AND p.level < h.level) AS parent FROM h
""")
def section_tree(spark, sf_dir):
    heads = read(spark, sf_dir, "pages").select("page_id", F.posexplode(dc.headings(F.col("html"))).alias("ord", "h")).select("page_id", F.col("ord").cast("long").alias("ord"), F.col("h.level").alias("level"))
    return sq.parents_by_level(heads, "page_id", "ord", "level", "ord").select("page_id", "ord", "level", "parent")


@query("""
WITH e AS (SELECT DISTINCT user_id AS a, (event_id * 7) % 150 AS b FROM events)
SELECT x.a, x.b FROM e x JOIN e y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b
""")
def reciprocal_links(spark, sf_dir):
    edges = read(spark, sf_dir, "events").select(F.col("user_id").alias("src"), ((F.col("event_id") * 7) % 150).alias("dst"))
    return gr.reciprocal(edges, "src", "dst")


# -- mutations and batches -------------------------------------------------------------------------------------------


@query("SELECT 'orders' AS t, count(*) AS n FROM orders WHERE o_custkey % 7 > 0 UNION ALL SELECT 'lines', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 7 > 0 UNION ALL SELECT 'people', count(*) FROM customer WHERE c_custkey % 7 > 0")
def cascading_delete(spark, sf_dir):
    """People leave, and with them their orders and lines."""
    people, orders, lines = (read(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    gone = people.where("c_custkey % 7 = 0").select("c_custkey")
    gone_orders = orders.join(gone, orders.o_custkey == gone.c_custkey, "left_semi").select("o_orderkey")
    left = {"people": people.join(gone, "c_custkey", "left_anti"), "orders": orders.join(gone_orders, "o_orderkey", "left_anti"), "lines": lines.join(gone_orders, lines.l_orderkey == gone_orders.o_orderkey, "left_anti")}
    counts = [d.agg(F.count("*").alias("n")).select(F.lit(t).alias("t"), "n") for t, d in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("SELECT key, event_id FROM (SELECT user_id || '/' || event_type AS key, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) WHERE r = 1")
def rekey_first_wins(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.concat_ws("/", "user_id", "event_type").alias("key"), "event_id")
    return rows.groupBy("key").agg(F.min("event_id").alias("event_id"))


@query("SELECT event_id * 2 AS id, 'highlight' AS kind FROM events WHERE event_type = 'click' UNION ALL SELECT event_id * 2 + 1, 'note' FROM events WHERE event_type = 'click'")
def split_rows(spark, sf_dir):
    rows = read(spark, sf_dir, "events").where("event_type = 'click'")
    parts = F.array(F.struct((F.col("event_id") * 2).alias("id"), F.lit("highlight").alias("kind")), F.struct((F.col("event_id") * 2 + 1).alias("id"), F.lit("note").alias("kind")))
    return rows.select(F.inline(parts))


@query("SELECT count(*) FILTER (c_custkey IS NOT NULL AND NOT dup) AS inserted, count(*) FILTER (c_custkey IS NOT NULL AND dup) AS duplicate, count(*) FILTER (c_custkey IS NULL) AS unresolved FROM (SELECT e.*, event_id % 4 = 0 AS dup FROM events e) LEFT JOIN customer ON c_custkey = user_id * 20")
def import_counters(spark, sf_dir):
    e, people = read(spark, sf_dir, "events").withColumn("owner", F.col("user_id") * 20), read(spark, sf_dir, "customer").select("c_custkey")
    rows, known, dup = e.join(people, e.owner == people.c_custkey, "left"), F.col("c_custkey").isNotNull(), F.col("event_id") % 4 == 0
    return rows.agg(F.count_if(known & ~dup).alias("inserted"), F.count_if(known & dup).alias("duplicate"), F.count_if(~known).alias("unresolved"))


@query("SELECT e.event_id, e.user_id * 20 AS owner FROM events e JOIN customer ON c_custkey = user_id * 20 WHERE event_type = 'view'")
def late_binding(spark, sf_dir):
    """Rows without an owner find theirs once it is there; each batch asks again for those that are left."""
    e, people = read(spark, sf_dir, "events").where("event_type = 'view'"), read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"))
    first, later = people.where("owner % 40 = 0"), people.where("owner % 40 > 0")
    wanted = e.select("event_id", (F.col("user_id") * 20).alias("owner"))
    bound = wanted.join(first, "owner")
    left = wanted.join(first, "owner", "left_anti")
    return bound.unionByName(left.join(later, "owner")).select("event_id", "owner")


@query("""
WITH RECURSIVE o AS (SELECT conv_id, turn, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
w AS (SELECT conv_id, r, size, 1 AS batch, size AS held FROM o WHERE r = 1 UNION ALL SELECT o.conv_id, o.r, o.size, CASE WHEN held + o.size > 500 THEN batch + 1 ELSE batch END, CASE WHEN held + o.size > 500 THEN o.size ELSE held + o.size END FROM w JOIN o ON o.conv_id = w.conv_id AND o.r = w.r + 1)
SELECT conv_id, batch::BIGINT AS batch, count(*) AS n, sum(size)::BIGINT AS size FROM w GROUP BY 1, 2
""")
def budget_batches(spark, sf_dir):
    """Items in order, in batches of at most 500; a larger item is alone in its batch."""
    return ps.budget_batches(read(spark, sf_dir, "conversations").withColumn("size", F.length("text")), "conv_id", "turn", "size", 500)


@query("SELECT key, tags FROM (SELECT c_custkey AS key, list_sort(list_distinct(list_filter([c_mktsegment, 'new', 'kept'], lambda x: x <> 'BUILDING'))) AS tags FROM customer)")
def edited_tags(spark, sf_dir):
    tags = rc.edit_tags(F.array("c_mktsegment"), F.array(F.lit("new"), F.lit("kept")), F.array(F.lit("BUILDING")))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.array_sort(tags).alias("tags"))


@query("SELECT c_custkey, lower(strip_accents(c_name)) AS name FROM customer")
def folded_names(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", F.translate(F.lower("c_name"), fn.MARKED, fn.PLAIN).alias("name"))
