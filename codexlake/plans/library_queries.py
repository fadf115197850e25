"""Queries of library merges, sync batches, copies and migrations, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexlake.operators import library as lib
from codexlake.operators import reconcile as rc
from codexlake.plans.registry import query, read

_SIDES = """
WITH ours AS (SELECT o_orderkey AS sha, o_orderkey * 7 % 100 AS updated_at, 'own ' || o_orderstatus AS title, CASE WHEN o_orderkey % 4 = 0 THEN 'A' || o_orderkey ELSE '' END AS amazon_asin, 'f' || o_orderkey AS path FROM orders WHERE o_orderkey % 3 <> 1),
theirs AS (SELECT o_orderkey AS sha, o_orderkey * 11 % 100 AS updated_at, 'their ' || o_orderpriority AS title, CASE WHEN o_orderkey % 6 = 0 THEN 'B' || o_orderkey END AS amazon_asin, 't' || o_orderkey AS path FROM orders WHERE o_orderkey % 3 <> 0),
"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[lib.Library, lib.Library]:
    """Two libraries: orders as books, lines as annotations, parts as notebooks, events as positions."""
    key, lines, parts = F.col("o_orderkey"), read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    orders = read(spark, sf_dir, "orders")
    ours = orders.where(key % 3 != 1).select(key.alias("sha"), (key * 7 % 100).alias("updated_at"), F.concat(F.lit("own "), "o_orderstatus").alias("title"), F.when(key % 4 == 0, F.concat(F.lit("A"), key)).otherwise("").alias("amazon_asin"), F.concat(F.lit("f"), key).alias("path"))
    theirs = orders.where(key % 3 != 0).select(key.alias("sha"), (key * 11 % 100).alias("updated_at"), F.concat(F.lit("their "), "o_orderpriority").alias("title"), F.when(key % 6 == 0, F.concat(F.lit("B"), key)).alias("amazon_asin"), F.concat(F.lit("t"), key).alias("path"))
    note = lambda cond: lines.where(cond).select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("dedup_hash"), F.col("l_orderkey").alias("sha"), F.col("l_returnflag").alias("body"))
    book = lambda cond: parts.where(cond).select(F.concat(F.lit("nb"), "p_partkey").alias("uuid"), F.col("p_size").alias("pages"))
    gone = note("l_linenumber = 3").select(F.lit("annotation").alias("kind"), F.col("dedup_hash").alias("key")).unionByName(book("p_partkey % 10 = 7").select(F.lit("notebook").alias("kind"), F.col("uuid").alias("key")))
    place = lambda side: read(spark, sf_dir, "events").where(F.col("event_id") % 2 == side).select(F.col("user_id").alias("sha"), F.col("event_type").alias("source"), F.lit("dev").alias("device"), F.col("value").alias("at"), F.col("event_id").alias("moved_at"))
    return (
        {"books": ours, "annotations": note("l_linenumber < 3 AND l_orderkey % 3 <> 1"), "notebooks": book("p_partkey % 3 = 0"), "deletions": gone, "positions": lib.latest_positions(place(0), place(0))},
        {"books": theirs, "annotations": note("l_linenumber IN (2, 3, 4)"), "notebooks": book("p_partkey % 2 = 1"), "deletions": gone.limit(0), "positions": lib.latest_positions(place(1), place(1))},
    )


@query(_SIDES + """
m AS (SELECT coalesce(a.sha, b.sha) AS sha, a.sha IS NULL AS new, a.sha IS NOT NULL AND b.sha IS NOT NULL AND b.updated_at > a.updated_at AS later, a.updated_at AS ua, b.updated_at AS ub, a.title AS ta, b.title AS tb, a.amazon_asin AS xa, b.amazon_asin AS xb, a.path AS pa, b.path AS pb FROM ours a FULL JOIN theirs b ON a.sha = b.sha)
SELECT sha, CASE WHEN new OR later THEN ub ELSE ua END AS updated_at, CASE WHEN new OR later THEN tb ELSE ta END AS title, CASE WHEN new THEN xb WHEN later THEN coalesce(nullif(xa, ''), nullif(xb, '')) ELSE xa END AS amazon_asin, CASE WHEN new THEN pb ELSE pa END AS path FROM m
""")
def library_merge(spark, sf_dir):
    """The books of the merged library: newest metadata wins, files stay."""
    ours, theirs = _sides(spark, sf_dir)
    return lib.merge(ours, theirs, kept=("path",))[0]["books"]


@query(_SIDES + """
n AS (SELECT DISTINCT l_orderkey || '-' || l_linenumber AS h, l_orderkey AS sha FROM lineitem WHERE l_linenumber IN (2, 3, 4)), held AS (SELECT l_orderkey || '-' || l_linenumber AS h FROM lineitem WHERE l_linenumber < 3 AND l_orderkey % 3 <> 1),
gone AS (SELECT l_orderkey || '-' || l_linenumber AS h FROM lineitem WHERE l_linenumber = 3)
SELECT 'books_added' AS what, count(*) AS n FROM theirs b WHERE NOT EXISTS (SELECT 1 FROM ours a WHERE a.sha = b.sha) UNION ALL SELECT 'books_updated', count(*) FROM theirs b JOIN ours a ON a.sha = b.sha AND b.updated_at > a.updated_at
UNION ALL SELECT 'annotations_added', count(*) FROM n WHERE h NOT IN (SELECT h FROM held) AND h NOT IN (SELECT h FROM gone) AND sha IN (SELECT sha FROM theirs) UNION ALL SELECT 'notebooks_added', count(*) FROM part WHERE p_partkey % 2 = 1 AND p_partkey % 3 <> 0 AND p_partkey % 10 <> 7
""")
def library_merge_counters(spark, sf_dir):
    ours, theirs = _sides(spark, sf_dir)
    return lib.merge(ours, theirs)[1]


@query("SELECT user_id AS sha, event_type AS source, 'dev' AS device, arg_max(value, event_id) AS at, max(event_id) AS moved_at FROM events GROUP BY 1, 2")
def library_merge_positions(spark, sf_dir):
    ours, theirs = _sides(spark, sf_dir)
    return lib.merge(ours, theirs)[0]["positions"]


def _batch(spark: SparkSession, sf_dir: str) -> tuple[lib.Library, DataFrame]:
    """Customers are books, some of them not yet known; conversations are entries, their turns are notes."""
    people = read(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").cast("string").alias("sha8"), F.col("c_name").alias("sha"))
    turns = read(spark, sf_dir, "conversations")
    note = F.struct(F.md5(F.col("text").cast("binary")).alias("hash"), F.col("role").alias("body"))
    batch = turns.groupBy("conv_id").agg(F.collect_list(note).alias("notes"), F.max("turn").alias("position")).select(
        F.concat(F.lit("book_"), "conv_id").alias("stem"), F.concat(F.lit("p"), F.col("conv_id") % 7).alias("payload_sha"), F.when(F.col("conv_id") % 2 == 0, F.col("position")).alias("position"), F.lit(5).cast("long").alias("moved_at"), "notes")
    checks = people.where("cast(sha8 AS bigint) % 4 = 0").select("sha", F.lit("dev").alias("device"), F.concat(F.lit("p"), F.col("sha8").cast("long") % 7).alias("payload_sha"))
    old = turns.where("turn = 0").groupBy(F.md5(F.col("text").cast("binary")).alias("dedup_hash")).agg(F.min("conv_id").alias("c")).where("c % 3 = 0")
    old = old.select("dedup_hash", F.lit(None).cast("string").alias("sha"), F.lit("old").alias("body"), F.concat(F.lit("book_"), "c").alias("stem"))
    positions = people.select("sha", F.lit("device").alias("source"), F.lit("dev").alias("device"), F.lit(99).cast("long").alias("at"), (F.col("sha8").cast("long") % 10).alias("moved_at"))
    return {"books": people, "positions": positions, "checkpoints": checks, "annotations": old}, batch


_ENTRIES = """
WITH known AS (SELECT c_custkey AS id, c_name AS sha FROM customer WHERE c_custkey % 5 <> 0),
e AS (SELECT DISTINCT conv_id, CASE WHEN k.id IS NULL THEN 'unmatched' WHEN conv_id % 4 = 0 THEN 'unchanged' ELSE 'imported' END AS status, k.sha FROM conversations LEFT JOIN known k ON k.id = conv_id),
old AS (SELECT md5(text) AS h, min(conv_id) AS c FROM conversations WHERE turn = 0 GROUP BY 1 HAVING min(conv_id) % 3 = 0),
notes AS (SELECT 'book_' || c.conv_id AS stem, c.conv_id, md5(text) AS h, role, e.sha FROM conversations c JOIN e ON e.conv_id = c.conv_id AND e.status <> 'unchanged'),
new AS (SELECT h, min(stem) AS stem FROM notes WHERE h NOT IN (SELECT h FROM old) GROUP BY 1)
"""


@query(_ENTRIES + """
SELECT 'book_' || e.conv_id AS stem, status, coalesce(w.n, 0) AS inserted, coalesce(t.n, 0) - coalesce(w.n, 0) AS duplicate
FROM e LEFT JOIN (SELECT stem, count(*) AS n FROM new GROUP BY 1) w ON w.stem = 'book_' || e.conv_id LEFT JOIN (SELECT stem, count(*) AS n FROM notes GROUP BY 1) t ON t.stem = 'book_' || e.conv_id
""")
def sync_batch_report(spark, sf_dir):
    state, batch = _batch(spark, sf_dir)
    return lib.sync_batch(state, batch, "dev")[1]


@query(_ENTRIES + """
SELECT sha, count(*) AS n FROM (SELECT h, (SELECT k.sha FROM known k WHERE 'book_' || k.id = stem) AS sha FROM new UNION ALL SELECT h, (SELECT k.sha FROM known k WHERE k.id = c) FROM old) GROUP BY 1
""")
def sync_batch_annotations(spark, sf_dir):
    """Annotations of each book after a batch; those without a book stand under null."""
    state, batch = _batch(spark, sf_dir)
    return lib.sync_batch(state, batch, "dev")[0]["annotations"].groupBy("sha").agg(F.count("*").alias("n"))


@query("""
WITH b AS (SELECT conv_id, max(turn) AS p FROM conversations WHERE conv_id % 2 = 0 AND conv_id % 5 <> 0 GROUP BY 1)
SELECT c_name AS sha, 'device' AS source, 'dev' AS device, CASE WHEN p IS NOT NULL AND 5 > c_custkey % 10 THEN p ELSE 99 END AS at, CASE WHEN p IS NOT NULL THEN greatest(5, c_custkey % 10) ELSE c_custkey % 10 END AS moved_at FROM customer LEFT JOIN b ON conv_id = c_custkey WHERE c_custkey % 5 <> 0
""")
def sync_batch_positions(spark, sf_dir):
    state, batch = _batch(spark, sf_dir)
    return lib.sync_batch(state, batch, "dev")[0]["positions"]


@query("SELECT p_partkey, CASE WHEN p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) THEN 'copy' WHEN p_size % 2 = 0 THEN 'overwrite' ELSE 'skip' END AS action FROM part")
def copy_policy(spark, sf_dir):
    wanted = read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, "always").otherwise("once").alias("policy"))
    return lib.copies_due(wanted, read(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "policy").select("p_partkey", "action")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'unknown' END AS c_name, length(c_name)::BIGINT AS name_size, 'epub' AS source_format FROM customer")
def additive_migration(spark, sf_dir):
    """Columns of a later version are added and filled; values that are there stay."""
    old = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("c_name"), F.length("c_name").alias("_n"))
    return lib.migrated(old, {"c_name": ("string", "'unknown'"), "name_size": ("bigint", "_n"), "source_format": ("string", "'epub'")}).drop("_n")


@query("""
WITH f AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '.css' WHEN 1 THEN '.xhtml' WHEN 2 THEN '.jpg' ELSE '.bin' END AS e FROM events WHERE event_id % 3 > 0 OR event_id % 5 = 0)
SELECT CASE e WHEN '.css' THEN 'style' WHEN '.xhtml' THEN 'text' WHEN '.jpg' THEN 'image' ELSE 'other' END AS kind, count(*) AS n FROM f WHERE event_id % 3 > 0 GROUP BY 1
""")
def class_tally(spark, sf_dir):
    """Two sets of files by path: what one lacks or has otherwise, by kind."""
    e = read(spark, sf_dir, "events")
    end = F.get(F.array(*map(F.lit, (".css", ".xhtml", ".jpg", ".bin"))), (F.col("event_id") % 4).cast("int"))
    files = e.select(F.concat(F.lit("f"), "event_id", end).alias("path"), "event_id")
    a = files.where("event_id % 3 <> 1 OR event_id % 5 = 0").select("path", F.lit(1).alias("digest"))
    b = files.where("event_id % 3 > 0 OR event_id % 5 = 0").select("path", F.when(F.col("event_id") % 3 > 0, 2).otherwise(1).alias("digest"))
    found = rc.keyed_diff(a.join(b.select("path"), "path", "left_semi"), b, ["path"], "digest")
    return lib.class_tally(found, "path", {r"\.css$": "style", r"\.x?html$": "text", r"\.(?:jpe?g|png|gif|svg)$": "image"})
