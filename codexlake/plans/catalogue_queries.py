"""Catalogue queries over the star-schema tables: orders stand in for books, customers for people and jobs, parts for titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codexlake.functions import text as fn
from codexlake.operators import reconcile as rc
from codexlake.operators import selection as sel
from codexlake.plans.registry import query, read


@query("""
SELECT c_mktsegment AS segment, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done,
       count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS other
FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1
""")
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, people = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    status = F.col("o_orderstatus")
    return (
        orders.join(people, orders.o_custkey == people.c_custkey, "left")
        .groupBy(F.col("c_mktsegment").alias("segment"))
        .agg(F.count("*").alias("total"), F.count_if(status == "F").alias("done"), F.count_if(status == "O").alias("pending"), F.count_if(~status.isin("F", "O")).alias("other"))
    )


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND contains(lower(o_orderpriority), 'high') AND o_totalprice IS NOT NULL")
def select_conjunctive(spark, sf_dir):
    chosen = sel.Selection(contains={"o_orderpriority": "HIGH"}, equals={"o_orderstatus": "F"}, has=["o_totalprice"])
    return chosen.apply(read(spark, sf_dir, "orders")).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT p_partkey, p_brand FROM part WHERE starts_with(p_brand, 'Brand#1') OR starts_with(p_brand, 'Brand#23')")
def select_prefix_any(spark, sf_dir):
    return read(spark, sf_dir, "part").where(sel.any_prefix(F.col("p_brand"), ["Brand#1", "Brand#23"])).select("p_partkey", "p_brand")


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#12' OR p_type = 'Brand#12'")
def select_either_column(spark, sf_dir):
    return sel.Selection(either={("p_brand", "p_type"): "Brand#12"}).apply(read(spark, sf_dir, "part")).select("p_partkey")


@query(r"SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE '%#1_' ESCAPE '\' AND p_brand LIKE '%\#1%' ESCAPE '\'")
def like_escaped_suffix(spark, sf_dir):
    return read(spark, sf_dir, "part").where(F.col("p_brand").endswith("#1") | F.expr(r"p_brand LIKE '%#1_'")).where(F.col("p_brand").like("%" + fn.like_escaped("#1") + "%")).where(F.length(F.substring_index("p_brand", "#", -1)) == 2).select("p_partkey", "p_brand")


@query("SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '(?is)^.*m.?$') OR regexp_matches(p_type, '(?is)^s.*d.*$')")
def glob_ci(spark, sf_dir):
    t = F.col("p_type")
    return read(spark, sf_dir, "part").where(t.rlike(fn.glob_regex("*M?")) | t.rlike(fn.glob_regex("*m")) | t.rlike(fn.glob_regex("S*D*"))).select("p_partkey", "p_type")


@query("SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_mktsegment, '^[A-Z0-9]') AND length(c_mktsegment) = 10 AND c_mktsegment = upper(c_mktsegment)")
def shape_test(spark, sf_dir):
    s = F.col("c_mktsegment")
    return read(spark, sf_dir, "customer").where(s.rlike("^[A-Z0-9]") & (F.length(s) == 10) & (s == F.upper(s))).select("c_custkey", "c_name")


@query("SELECT c_custkey, coalesce(n, 0) AS n_orders, coalesce(last, 'none') AS last FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderstatus) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def left_join_default(spark, sf_dir):
    jobs = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderstatus").alias("last"))
    return read(spark, sf_dir, "customer").join(jobs, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("last", F.lit("none")).alias("last"))


@query("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49 AND l_returnflag = 'R')")
def semi_exists(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").where("l_quantity > 49 AND l_returnflag = 'R'").select(F.col("l_suppkey").alias("s_suppkey"))
    return read(spark, sf_dir, "supplier").join(lines, "s_suppkey", "left_semi").select("s_suppkey")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_orphans(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").join(orders, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("""
SELECT 'missing' AS side, count(*) AS n FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)
UNION ALL SELECT 'unlisted', count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE d.doc_id = l.doc_id)
""")
def manifest_both_ways(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels").select("doc_id")
    count = lambda a, b, side: a.join(b, "doc_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return count(labels, docs, "missing").unionByName(count(docs, labels, "unlisted"))


@query("SELECT DISTINCT lang, source FROM documents")
def distinct_pairs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("lang", "source").distinct()


@query("SELECT p_brand, p_type, p_size, count(*) AS n FROM part GROUP BY ALL HAVING count(*) < 2")
def having_few(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy("p_brand", "p_type", "p_size").agg(F.count("*").alias("n")).where("n < 2")


@query("SELECT coalesce(max(o_orderkey), 0) + 1 AS next_id, count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS in_flight FROM orders")
def next_id(spark, sf_dir):
    return read(spark, sf_dir, "orders").agg((F.coalesce(F.max("o_orderkey"), F.lit(0)) + 1).alias("next_id"), F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("in_flight"))


def _facets() -> dict:
    return {"lang": sel.facet_values(F.col("lang")), "source": sel.facet_values(F.col("source")), "length": sel.facet_values(F.when(F.col("n_chars") < 1000, "short").when(F.col("n_chars") < 5000, "middle"))}


@query("""
WITH d AS (SELECT lang, source, CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 5000 THEN 'middle' ELSE '—' END AS length FROM documents),
c AS (SELECT 'lang' AS facet, lang AS label, count(*) AS n FROM d WHERE source IN ('src1', 'src2') AND length IN ('short', '—') GROUP BY 2
UNION ALL SELECT 'source', source, count(*) FROM d WHERE lang IN ('en', 'xx') AND length IN ('short', '—') GROUP BY 2
UNION ALL SELECT 'length', length, count(*) FROM d WHERE lang IN ('en', 'xx') AND source IN ('src1', 'src2') GROUP BY 2
UNION ALL SELECT * FROM (VALUES ('lang', 'en', 0), ('lang', 'xx', 0), ('source', 'src1', 0), ('source', 'src2', 0), ('length', 'short', 0), ('length', '—', 0)))
SELECT facet, label, sum(n)::BIGINT AS n FROM c GROUP BY ALL
""")
def facet_counts(spark, sf_dir):
    chosen = {"lang": ["en", "xx"], "source": ["src1", "src2"], "length": ["short", "—"]}
    return sel.facet_counts(read(spark, sf_dir, "documents"), _facets(), chosen)


@query("""
SELECT label, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang NOT IN ('en', 'fr')) AS other
FROM (SELECT lang, CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 5000 THEN 'middle' ELSE '—' END AS label FROM documents) GROUP BY 1
""")
def availability(spark, sf_dir):
    lang = F.col("lang")
    return read(spark, sf_dir, "documents").select("lang", F.explode(_facets()["length"]).alias("label")).groupBy("label").agg(F.count_if(lang == "en").alias("en"), F.count_if(lang == "fr").alias("fr"), F.count_if(~lang.isin("en", "fr")).alias("other"))


@query(r"""
WITH k AS (SELECT DISTINCT p_brand, array_to_string(list_transform(regexp_extract_all(p_brand, '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(ltrim(x, '0'), 20, '0') ELSE x END), '') AS key FROM part)
SELECT p_brand, row_number() OVER (ORDER BY key, p_brand) AS at FROM k
""")
def natural_sort_rank(spark, sf_dir):
    brands = read(spark, sf_dir, "part").select("p_brand").distinct()
    return brands.select("p_brand", F.row_number().over(Window.orderBy(fn.natural_key(F.col("p_brand")), fn.leading_zeros(F.col("p_brand")), "p_brand")).cast("long").alias("at"))


@query("""
SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY v DESC NULLS LAST, c_custkey) AS down, row_number() OVER (PARTITION BY c_nationkey ORDER BY v ASC NULLS LAST, c_custkey) AS up
FROM (SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS v FROM customer)
""")
def missing_last(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").withColumn("v", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))
    place = lambda down: F.row_number().over(Window.partitionBy("c_nationkey").orderBy(sel.missing_last(F.col("v"), down), "c_custkey")).cast("long")
    return rows.select("c_custkey", place(True).alias("down"), place(False).alias("up"))


@query("SELECT p_partkey, p_brand || ' ' || CASE WHEN p_size % 5 = 0 THEN '99999999' ELSE lpad(cast(p_size * 10 AS VARCHAR), 8, '0') END AS series_key FROM part")
def series_order(spark, sf_dir):
    size = F.when(F.col("p_size") % 5 != 0, F.col("p_size").cast("double"))
    return read(spark, sf_dir, "part").select("p_partkey", sel.series_key(F.col("p_brand"), size).alias("series_key"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_partkey ELSE min(p_partkey) OVER (PARTITION BY CASE WHEN p_size % 4 <> 0 THEN p_brand END) END AS group_at FROM part")
def first_seen_groups(spark, sf_dir):
    rows = read(spark, sf_dir, "part").withColumn("series", F.when(F.col("p_size") % 4 != 0, F.col("p_brand")))
    return sel.first_seen(rows, "series", "p_partkey").select("p_partkey", "group_at")


@query("SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS r FROM part) WHERE r = 1")
def group_leads(spark, sf_dir):
    return sel.leads(read(spark, sf_dir, "part"), "p_brand", [F.col("p_size"), F.col("p_partkey")]).select("p_brand", "p_partkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
def topk(spark, sf_dir):
    return read(spark, sf_dir, "orders").orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("SELECT c.c_custkey, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE list_has_any([n.n_name, r.r_name], ['ASIA', 'NATION_1', 'BRAZIL', 'FRANCE', 'R1'])")
def credited_names(spark, sf_dir):
    people, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = people.join(n, people.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return rows.where(F.exists(F.array("n_name", "r_name"), lambda x: x.isin("ASIA", "NATION_1", "BRAZIL", "FRANCE", "R1"))).select("c_custkey", "n_name", "r_name")


# -- reconciliation --------------------------------------------------------------------------------------------------


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS digest, count(*) AS n FROM documents GROUP BY text")
def content_dedup(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("SELECT doc_id, sha256(lang || chr(0) || source || chr(0) || cast(n_chars AS VARCHAR) || chr(0)) AS key FROM documents")
def dedup_hash(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", fn.content_key(F.col("lang"), F.col("source"), F.col("n_chars")).alias("key"))


@query("""
WITH old AS (SELECT user_id, event_type FROM events WHERE event_id % 3 = 0), new AS (SELECT * FROM events WHERE event_id % 3 > 0)
SELECT user_id, event_type, arg_min(event_id, event_id) AS event_id FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.user_id = new.user_id AND old.event_type = new.event_type) GROUP BY 1, 2
""")
def insert_ignore(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return rc.insert_ignore(e.where("event_id % 3 = 0"), e.where("event_id % 3 > 0"), ["user_id", "event_type"], "event_id")


@query("""
WITH a AS (SELECT user_id, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN b.ts IS NULL OR (a.ts IS NOT NULL AND a.ts >= b.ts) THEN a.ts ELSE b.ts END AS ts, CASE WHEN b.ts IS NULL OR (a.ts IS NOT NULL AND a.ts >= b.ts) THEN a.value ELSE b.value END AS value
FROM a FULL JOIN b ON a.user_id = b.user_id
""")
def newest_wins_merge(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    side = lambda k: e.where(F.col("event_id") % 2 == k).groupBy("user_id").agg(F.max("ts").alias("ts"), F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    return rc.newest_wins(side(0), side(1), "user_id", "ts")


@query("SELECT event_id, user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events t WHERE t.event_type = 'error' AND t.event_id % 20 = 0 AND t.user_id = e.user_id) ")
def tombstone_filter(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return rc.without_tombstones(e, e.where("event_type = 'error' AND event_id % 20 = 0"), ["user_id"]).select("event_id", "user_id")


@query("""
WITH seen AS (SELECT user_id, event_type, max(ts) AS last_seen FROM events WHERE event_id % 5 = 0 GROUP BY 1, 2), present AS (SELECT user_id, event_type, max(ts) AS last_seen FROM events WHERE event_id % 5 > 0 GROUP BY 1, 2)
SELECT * FROM seen UNION ALL SELECT * FROM present p WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = p.user_id)
""")
def presence_refresh(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    state = lambda d: d.groupBy("user_id", "event_type").agg(F.max("ts").alias("last_seen"))
    return rc.refresh_presence(state(e.where("event_id % 5 > 0")), state(e.where("event_id % 5 = 0")), ["user_id"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'renamed' ELSE c_name END AS c_name, c_mktsegment FROM customer")
def sparse_patch(spark, sf_dir):
    people = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    changes = people.where("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "renamed").alias("c_name"))
    return rc.patch(people, changes, "c_custkey")


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'new' END ELSE c_mktsegment END AS c_mktsegment FROM customer")
def full_patch(spark, sf_dir):
    people = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    changes = people.where("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "new").alias("c_mktsegment"))
    return rc.patch(people, changes, "c_custkey", clear=True)


@query("SELECT event_id, CASE WHEN event_id % 4 = 1 THEN value + 1 ELSE value END AS value FROM events WHERE event_id % 4 <> 2")
def delta_over_base(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "value")
    delta = e.where("event_id % 4 IN (1, 2)").select("event_id", (F.col("value") + 1).alias("value"), (F.col("event_id") % 4 == 2).alias("deleted"))
    return rc.delta_over_base(e, delta, "event_id")


@query("""
WITH a AS (SELECT s_suppkey, lower(s_name) AS k1, substr(lower(s_name), 1, length(s_name) - 1) AS k2 FROM supplier), b AS (SELECT c_custkey, replace(lower(c_name), 'customer', 'supplier') AS k FROM customer),
e AS (SELECT s_suppkey, min(c_custkey) AS c1 FROM a JOIN b ON k1 = k GROUP BY 1), f AS (SELECT s_suppkey, min(c_custkey) AS c2 FROM a JOIN (SELECT c_custkey, substr(k, 1, length(k) - 1) AS kk FROM b) ON k2 = kk GROUP BY 1)
SELECT a.s_suppkey, coalesce(c1, c2) AS c_custkey, CASE WHEN c1 IS NOT NULL THEN 1 WHEN c2 IS NOT NULL THEN 2 END AS tier FROM a LEFT JOIN e ON a.s_suppkey = e.s_suppkey LEFT JOIN f ON a.s_suppkey = f.s_suppkey
""")
def tiered_match(spark, sf_dir):
    name, other = F.lower("s_name"), F.replace(F.lower("c_name"), F.lit("customer"), F.lit("supplier"))
    short = lambda c: F.substring(c, F.lit(1), F.length(c) - 1)
    return rc.tiered_match(read(spark, sf_dir, "supplier"), read(spark, sf_dir, "customer"), [(name, other), (short(name), short(other))], "s_suppkey", "c_custkey")


@query("""
WITH a AS (SELECT user_id, event_type, sum(value) > 100 AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), b AS (SELECT user_id, event_type, sum(value) > 100 AS v FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, CASE WHEN a.user_id IS NULL THEN 'added' WHEN b.user_id IS NULL THEN 'dropped' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'identical' ELSE 'changed' END AS outcome
FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type
""")
def keyed_full_diff(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    side = lambda k: e.where(F.col("event_id") % 2 == k).groupBy("user_id", "event_type").agg((F.sum("value") > 100).alias("v"))
    return rc.keyed_diff(side(0), side(1), ["user_id", "event_type"], "v")


@query("""
WITH a AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS at FROM events WHERE event_id % 3 = 0), b AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS at FROM events WHERE event_id % 3 = 1),
p AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, a.event_type AS x, b.event_type AS y FROM a FULL JOIN b ON a.user_id = b.user_id AND a.at = b.at)
SELECT user_id, outcome, count(*) AS n FROM (SELECT user_id, CASE WHEN count(x) OVER w = 0 THEN 'added' WHEN count(y) OVER w = 0 THEN 'dropped' WHEN x = y THEN 'identical' ELSE 'changed' END AS outcome FROM p WINDOW w AS (PARTITION BY user_id)) GROUP BY ALL
""")
def bag_pair_diff(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return rc.bag_diff(e.where("event_id % 3 = 0"), e.where("event_id % 3 = 1"), "user_id", "event_type", "event_id")


@query("""
WITH a AS (SELECT event_type, count(*) AS n, sum(strlen(props))::BIGINT AS b FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type, count(*) AS n, sum(strlen(props))::BIGINT AS b FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT coalesce(a.event_type, b.event_type) AS event_type, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b, coalesce(a.b, 0) AS bytes_a, coalesce(b.b, 0) AS bytes_b FROM a FULL JOIN b ON a.event_type = b.event_type
""")
def type_count_diff(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    odd = F.col("event_id") % 2 == 1  # one pass: each row counts for one side
    size = F.octet_length("props")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return e.groupBy("event_type").agg(F.count_if(~odd).alias("n_a"), F.count_if(odd).alias("n_b"), zero(F.sum(F.when(~odd, size))).alias("bytes_a"), zero(F.sum(F.when(odd, size))).alias("bytes_b"))


@query("SELECT p_partkey, p_brand, first_value(p_partkey) OVER w AS owner, row_number() OVER w = 1 AS kept FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey)")
def first_owner(spark, sf_dir):
    return rc.first_owner(read(spark, sf_dir, "part"), "p_brand", [F.col("p_size").desc(), F.col("p_partkey")], "p_partkey").select("p_partkey", "p_brand", "owner", "kept")


@query("SELECT p_type, owner, p_partkey FROM (SELECT p_type, p_partkey, first_value(p_partkey) OVER (PARTITION BY p_type ORDER BY p_retailprice, p_partkey) AS owner FROM part) WHERE owner <> p_partkey")
def owner_conflicts(spark, sf_dir):
    return rc.conflicts(rc.first_owner(read(spark, sf_dir, "part"), "p_type", [F.col("p_retailprice"), F.col("p_partkey")], "p_partkey"), "p_type", "p_partkey")


@query("""
SELECT c_custkey, list_distinct(list_filter(list_transform(string_split(lower(c_mktsegment || ', ,New,' || c_mktsegment), ','), lambda x: trim(x)), lambda x: x <> '')).list_sort() AS tags FROM customer
""")
def tags_canonical(spark, sf_dir):
    s = F.col("c_mktsegment")
    return read(spark, sf_dir, "customer").select("c_custkey", F.array_sort(fn.canonical_tags(F.split(F.concat(s, F.lit(", ,New,"), s), ","))).alias("tags"))


# -- plain analytics over the star schema ------------------------------------------------------------------------------


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice) AS sum_base_price, sum(l_extendedprice * (1 - l_discount)) AS sum_disc_price, avg(l_discount) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2
""")
def pricing_summary(spark, sf_dir):
    price = F.col("l_extendedprice")
    return read(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.sum(price).alias("sum_base_price"), F.sum(price * (1 - F.col("l_discount"))).alias("sum_disc_price"), F.avg("l_discount").alias("avg_disc"), F.count("*").alias("count_order"))


@query("""
SELECT n_name, sum(l_extendedprice * (1 - l_discount)) AS revenue, count(DISTINCT o_orderkey) AS orders
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag = 'R' GROUP BY 1
""")
def revenue_by_nation(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_extendedprice", "l_discount")
    orders, people, n = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), read(spark, sf_dir, "nation")
    # lines come down to one row per order before they meet the other tables; an order is then one row
    per_order = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    rows = per_order.join(orders, "o_orderkey").join(people, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.sum("revenue").alias("revenue"), F.count("*").alias("orders"))
