"""Queries of names, value forms, predicates and orders, with the SQL that must give the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codexlake.functions import names as nm
from codexlake.functions import text as fn
from codexlake.operators import selection as sel
from codexlake.plans.registry import query, read

# -- forms of names and values ---------------------------------------------------------------------------------------

_SCRIPT = "['さくら', '桜のはな', 'plain', 'カナ mix', '', '漢字', 'ﾊﾝｶｸ']"


@query(f"SELECT c_custkey, t, regexp_matches(t, '[ぁ-ゟ゠-ヿｦ-ﾟ]') AND NOT regexp_matches(t, '[々㐀-䶿一-鿿豈-﫿]') AS kana FROM (SELECT c_custkey, ({_SCRIPT})[1 + c_custkey % 7] AS t FROM customer)")
def kana_dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.get(F.array(*map(F.lit, ("さくら", "桜のはな", "plain", "カナ mix", "", "漢字", "ﾊﾝｶｸ"))), (F.col("c_custkey") % 7).cast("int"))
    return read(spark, sf_dir, "customer").select("c_custkey", t.alias("t")).withColumn("kana", nm.kana_dominant(F.col("t")))


@query("""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ['太宰 治', '芥川 龍之介'] WHEN 1 THEN ['夏目 漱石', '森 鴎外', c_name] WHEN 2 THEN [c_name || ', Jr'] ELSE ['김 철수', '李 白', 'A, B'] END AS names FROM customer
""")
def unpacked_names(spark, sf_dir):
    k = F.col("c_custkey") % 4
    packed = F.when(k == 0, "太宰 治、芥川 龍之介").when(k == 1, F.concat(F.lit("夏目 漱石，森 鴎外、"), "c_name")).when(k == 2, F.concat("c_name", F.lit(", Jr"))).otherwise("김 철수, 李 白、A, B")
    return read(spark, sf_dir, "customer").select("c_custkey", nm.unpacked_names(packed).alias("names"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Customer of ' || upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) WHEN 1 THEN 'of ' || c_mktsegment ELSE '1984 ' END AS title FROM customer")
def calm_titles(spark, sf_dir):
    k = F.col("c_custkey") % 3
    title = F.when(k == 0, F.concat(F.lit("CUSTOMER OF "), F.upper("c_mktsegment"))).when(k == 1, F.concat(F.lit("of "), "c_mktsegment")).otherwise("1984 ")
    calm = F.when(k == 0, F.replace(nm.calm_title(title), F.lit(" Of "), F.lit(" of "))).otherwise(nm.calm_title(title))
    return read(spark, sf_dir, "customer").select("c_custkey", calm.alias("title"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN '【合本版】' ELSE trim(p_name) END AS series FROM part")
def series_names(spark, sf_dir):
    k, n = F.col("p_partkey") % 5, F.col("p_name")
    title = F.when(k == 0, F.concat(F.lit("【合本版】"), n, F.lit("　全3巻"))).when(k == 1, F.concat(n, F.lit(" (1-4)"))).when(k == 2, F.concat(n, F.lit(": Box Set"))).when(k == 3, n).otherwise("【合本版】")
    return read(spark, sf_dir, "part").select("p_partkey", nm.series_name(title).alias("series"))


@query("SELECT page_id, page_id % 6 IN (0, 2) AS front, page_id % 6 IN (1, 3, 5) AS marker FROM pages")
def label_kinds(spark, sf_dir):
    label = F.get(F.array(F.lit(" Table of Contents"), F.lit("第十二章"), F.lit("奥付"), F.lit(" ４２ "), F.lit("A long story"), F.concat(F.lit("Chapter "), "page_id")), (F.col("page_id") % 6).cast("int"))
    return read(spark, sf_dir, "pages").select("page_id", nm.front_matter(label).alias("front"), nm.chapter_marker(label).alias("marker"))


@query("SELECT doc_id, tag, doc_id % 5 <> 3 AS ok, doc_id % 2 = 0 AS uuid_ok FROM (SELECT doc_id, lang || ['-Latn', '-419', '-x-own', '-', '-1996-u-co-phonebk'][1 + doc_id % 5] AS tag FROM documents)")
def tag_and_uuid_forms(spark, sf_dir):
    tag = F.concat("lang", F.get(F.array(*map(F.lit, ("-Latn", "-419", "-x-own", "-", "-1996-u-co-phonebk"))), (F.col("doc_id") % 5).cast("int")))
    own = F.concat(F.lit("0123abcd-0123-4567-89AB-"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.when(F.col("doc_id") % 2 == 1, "g").otherwise(""))
    return read(spark, sf_dir, "documents").select("doc_id", tag.alias("tag"), nm.language_tag_ok(tag).alias("ok"), nm.uuid_ok(own).alias("uuid_ok"))


@query(r"""
SELECT l_orderkey, l_linenumber, try_cast(q AS DOUBLE) BETWEEN 1 AND 45 AND regexp_matches(q, '^[0-9]+$') AS quantity_ok, regexp_matches(p, '^[0-9]+([.][0-9]+)?$') AS price_ok, l_linenumber < 4 AS day_ok
FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity::BIGINT::VARCHAR ELSE (l_quantity::BIGINT + 0.5)::VARCHAR END AS q, (l_quantity::BIGINT)::VARCHAR || CASE WHEN l_linenumber = 1 THEN 'e2' ELSE '.25' END AS p FROM lineitem)
""")
def xsd_datatypes(spark, sf_dir):
    n = F.col("l_quantity").cast("long").cast("string")
    quantity = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" "), n, F.lit("\n"))).otherwise(F.concat(n, F.lit(".5")))
    day = F.concat(F.lit("1999-02-2"), F.when(F.col("l_linenumber") < 4, "8Z").otherwise("9"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", nm.xsd_ok(quantity, "integer", 1, 45).alias("quantity_ok"), nm.xsd_ok(F.concat(n, F.when(F.col("l_linenumber") == 1, "e2").otherwise(".25")), "decimal").alias("price_ok"), nm.xsd_ok(day, "date").alias("day_ok"))


@query("SELECT event_type, CASE WHEN event_type IN ('click', 'view') THEN 'rtl' ELSE 'ltr' END AS direction, CASE WHEN event_type = 'error' THEN 'epub' ELSE event_type END AS format, count(*) AS n FROM events GROUP BY 1")
def code_maps(spark, sf_dir):
    kind = F.when(F.col("event_type") != "error", F.concat("event_type", F.lit("_to_kfx")))
    mode = F.when(F.col("event_type").isin("click", "view"), "vertical-rl").otherwise("horizontal-tb")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", nm.page_direction(mode).alias("direction"), nm.source_format(kind).alias("format"), "n")


@query(r"""
WITH d AS (SELECT c_custkey, sha1('\x6b\xa7\xb8\x11\x9d\xad\x11\xd1\x80\xb4\x00\xc0\x4f\xd4\x30\xc8'::BLOB || encode(c_name)) AS h FROM customer)
SELECT c_custkey, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (strpos('0123456789abcdef', h[17]) - 1) % 4 + 1, 1) || h[18:20] || '-' || h[21:32] AS id FROM d
""")
def name_uuids(spark, sf_dir):
    """UUIDs of version 5 of customers' names; held against the standard library in the tests."""
    return read(spark, sf_dir, "customer").select("c_custkey", nm.name_uuid(uuid.NAMESPACE_URL.bytes, F.col("c_name")).alias("id"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment || ' ' || c_name WHEN 1 THEN c_name || ', Jr.' ELSE '太宰, 治' END AS name FROM customer")
def display_names(spark, sf_dir):
    k = F.col("c_custkey") % 3
    return read(spark, sf_dir, "customer").select("c_custkey", fn.display_name(F.when(k == 0, F.concat("c_name", F.lit(", "), "c_mktsegment")).when(k == 1, F.concat("c_name", F.lit(", Jr."))).otherwise("太宰, 治")).alias("name"))


@query(r"""
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN k || '|' || k2 ELSE k END AS key FROM (SELECT c_custkey,
regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') || CASE WHEN c_custkey % 2 = 0 THEN 'muller' ELSE 'miller' END AS k, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') || 'mueller' AS k2 FROM customer)
""")
def search_keys(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", fn.search_key(F.col("c_name"), F.when(F.col("c_custkey") % 2 == 0, "Müller").otherwise("Miller")).alias("key"))


# -- predicates ------------------------------------------------------------------------------------------------------


@query("""
SELECT p_partkey FROM part WHERE contains(regexp_replace(lower(p_name || p_brand || p_type), '[^a-z0-9]', '', 'g'), 'brand23') OR contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'brand 23')
""")
def search_any_field(spark, sf_dir):
    """The folded key holds the folded query, or the fields as they are hold it as it is."""
    fields = [F.col(c) for c in ("p_name", "p_brand", "p_type")]
    return read(spark, sf_dir, "part").where(sel.matches("Brand 23", fields)).select("p_partkey")


@query("""
SELECT p_partkey FROM part WHERE contains(regexp_replace(lower(p_name || p_brand || p_type), '[^a-z0-9]', '', 'g'), 'brand1') AND p_size IN (1, 2, 3, 4, 5) AND p_type IN ('STANDARD', 'ECONOMY', 'SMALL', 'LARGE', 'MEDIUM', 'PROMO')
""")
def visible_rows(spark, sf_dir):
    """What the search finds among what the chosen facets leave."""
    fields = [F.col(c) for c in ("p_name", "p_brand", "p_type")]
    chosen = sel.facet_match({"size": sel.facet_values(F.col("p_size").cast("string")), "type": sel.facet_values(F.col("p_type"))}, {"size": list("12345"), "type": ["STANDARD", "ECONOMY", "SMALL", "LARGE", "MEDIUM", "PROMO"]})
    return read(spark, sf_dir, "part").where(sel.matches("brand#1", fields) & chosen).select("p_partkey")


@query("SELECT user_id, count(*) AS n FROM events WHERE NOT coalesce(event_id % 3 = 0, false) GROUP BY 1")
def not_hidden(spark, sf_dir):
    return sel.shown(read(spark, sf_dir, "events").withColumn("hidden", F.when(F.col("event_id") % 3 > 0, F.lit(None)).otherwise(F.lit(True))), "hidden").groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'added' END AS added_at FROM customer")
def set_if_null(spark, sf_dir):
    held = F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).when(F.col("c_custkey") % 3 == 1, "")
    return read(spark, sf_dir, "customer").select("c_custkey", sel.filled(held, F.lit("added")).alias("added_at"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (3, 5, 8, 90)")
def select_ids(spark, sf_dir):
    return sel.Selection(ids=[3, 5, 8, 90], id_col="c_custkey").apply(read(spark, sf_dir, "customer")).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE list_contains([lower(c_mktsegment), 'all'], 'building')")
def select_tags(spark, sf_dir):
    people = read(spark, sf_dir, "customer").withColumn("tags", F.array(F.lower("c_mktsegment"), F.lit("all")))
    return sel.Selection(tags=["building"]).apply(people).select("c_custkey")


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return sel.duplicates(read(spark, sf_dir, "orders"), ["o_orderpriority"])


# -- orders ----------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY (p_size % 3 = 0), CASE WHEN p_size % 3 > 0 THEN p_size END, p_type, p_partkey) AS place FROM part")
def within_series(spark, sf_dir):
    """In a series the rows with a number come first, by number, then the others by the natural order of their titles."""
    index = F.when(F.col("p_size") % 3 > 0, F.col("p_size"))
    w = Window.partitionBy("p_brand").orderBy(*sel.series_position(index, F.col("p_type")), "p_partkey")
    return read(spark, sf_dir, "part").select("p_partkey", F.row_number().over(w).cast("long").alias("place"))


@query("SELECT tag, n, row_number() OVER (ORDER BY n DESC, tag) AS place FROM (SELECT lower(p_type) AS tag, count(*) AS n FROM part GROUP BY 1)")
def counts_descending(spark, sf_dir):
    """Few rows by construction: one for each tag."""
    return sel.ranked_counts(read(spark, sf_dir, "part").select(F.lower("p_type").alias("tag")), "tag")


_SORTS = {"name": "c_name", "segment": "c_mktsegment", "nation": "c_nationkey", "balance": "CASE WHEN c_acctbal >= 0 THEN c_acctbal END", "tail": "nullif(substr(c_name, 15), '')", "half": "CASE WHEN c_custkey % 2 = 0 THEN c_custkey END", "key": "c_custkey"}


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS sort, {down == 'DESC'} AS down, c_custkey, row_number() OVER (ORDER BY {e} {down} NULLS LAST, c_custkey) AS place FROM customer) WHERE place <= 5" for k, e in _SORTS.items() for down in ("DESC", "ASC")))
def sort_keys(spark, sf_dir):
    """The first five rows by each of seven keys, both ways; rows without the value come last either way. Each is a top-k, so no window holds the table."""
    people, out = read(spark, sf_dir, "customer"), []
    for k, e in _SORTS.items():
        for down in (True, False):
            top = people.select("c_custkey", F.expr(e).alias("_v")).orderBy(sel.missing_last(F.col("_v"), down), "c_custkey").limit(5)
            place = F.row_number().over(Window.orderBy(sel.missing_last(F.col("_v"), down), "c_custkey")).cast("long")  # five rows
            out.append(top.select(F.lit(k).alias("sort"), F.lit(down).alias("down"), "c_custkey", place.alias("place")))
    head = out[0]
    for x in out[1:]:
        head = head.unionByName(x)
    return head
