"""Document queries: texts, pages, sequences, graphs, findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codexlake.functions import text as fn
from codexlake.operators import documents as dc
from codexlake.operators import findings as fd
from codexlake.operators import graph as gr
from codexlake.operators import reconcile as rc
from codexlake.operators import sequence as sq
from codexlake.operators import trees as tr
from codexlake.plans.registry import query, read

#: The node rows of the pages in SQL: a walk over the tags that keeps the open elements. nodes: page_id, node_id, anc (ancestors, outermost first), tag, class, said.
_VOID = ", ".join(f"'{t}'" for t in sorted(dc.VOID))
NODES = rf"""
WITH RECURSIVE src AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)(<script\b[^>]*>).*?</script\s*>', '\1</script>', 'g') AS h FROM pages),
lists AS (SELECT page_id, regexp_extract_all(h, '<(/?[a-zA-Z][a-zA-Z0-9]*)[^>]*>[^<]*', 1) AS t, regexp_extract_all(h, '<(/?[a-zA-Z][a-zA-Z0-9]*)([^>]*)>[^<]*', 2) AS a, regexp_extract_all(h, '<(/?[a-zA-Z][a-zA-Z0-9]*)[^>]*>([^<]*)', 2) AS s FROM src),
walk AS (SELECT page_id, 0 AS i, []::INTEGER[] AS ids, []::VARCHAR[] AS names, 0 AS n, NULL::INTEGER[] AS anc, NULL::VARCHAR AS tag, NULL::VARCHAR AS class, NULL::VARCHAR AS said FROM lists
UNION ALL SELECT page_id, i, CASE WHEN begins THEN CASE WHEN x IN ({_VOID}) THEN ids ELSE ids || [n] END WHEN list_contains(names, x) THEN ids[1:keep] ELSE ids END, CASE WHEN begins THEN CASE WHEN x IN ({_VOID}) THEN names ELSE names || [x] END WHEN list_contains(names, x) THEN names[1:keep] ELSE names END,
n + begins::INTEGER, CASE WHEN begins THEN ids END, CASE WHEN begins THEN x END, regexp_extract(attrs, 'class="([^"]*)"', 1), txt
FROM (SELECT w.page_id, w.i + 1 AS i, w.ids, w.names, w.n, NOT starts_with(l.t[w.i + 1], '/') AS begins, lower(ltrim(l.t[w.i + 1], '/')) AS x, len(w.names) - list_position(list_reverse(w.names), lower(ltrim(l.t[w.i + 1], '/'))) AS keep, l.a[w.i + 1] AS attrs, l.s[w.i + 1] AS txt FROM walk w JOIN lists l ON l.page_id = w.page_id AND w.i < len(l.t))),
own AS (SELECT page_id, ids[-1] AS node_id, string_agg(replace(replace(replace(replace(said, '&middot;', '·'), '&copy;', '©'), '&quot;', chr(34)), '&amp;', '&'), '' ORDER BY i) AS said FROM walk WHERE i > 0 AND len(ids) > 0 AND names[-1] NOT IN ('script', 'style', 'rp') GROUP BY 1, 2),
nodes AS (SELECT w.page_id, w.n - 1 AS node_id, w.anc, w.tag, w.class, coalesce(o.said, '') AS said FROM walk w LEFT JOIN own o ON o.page_id = w.page_id AND o.node_id = w.n - 1 WHERE w.tag IS NOT NULL)
"""

# -- texts -----------------------------------------------------------------------------------------------------------


@query(r"SELECT lang, ch, count(*) AS n FROM (SELECT lang, unnest(string_split(regexp_replace(text, '[ \t\n\r]+', '', 'g'), '')) AS ch FROM documents) GROUP BY ALL")
def char_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.char_counts(read(spark, sf_dir, "documents"), "lang", "text")


@query(r"""
WITH c AS (SELECT doc_id % 2 AS side, unnest(string_split(regexp_replace(text, '[ \t\n\r]+', '', 'g'), '')) AS ch FROM documents), n AS (SELECT ch, count(*) FILTER (side = 0) AS n_a, count(*) FILTER (side = 1) AS n_b FROM c GROUP BY 1)
SELECT ch, n_a, n_b, greatest(n_a - n_b, 0) AS lost, greatest(n_b - n_a, 0) AS gained FROM n
""")
def char_multiset_diff(spark, sf_dir):
    counted = dc.char_counts(read(spark, sf_dir, "documents").select((F.col("doc_id") % 2).alias("side"), "text"), "side", "text")
    # one scan: the sides are columns of one grouping
    n = lambda side: F.sum(F.when(F.col("side") == side, F.col("n")).otherwise(0))
    return rc.bag_losses(counted.groupBy("ch").agg(n(0).alias("n_a"), n(1).alias("n_b")))


@query("""
WITH w AS (SELECT source, unnest(string_split(text, ' ')) AS w, doc_id % 2 AS side FROM documents), n AS (SELECT source, w, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM w GROUP BY 1, 2)
SELECT source, sum(a)::BIGINT AS total, sum(greatest(a - b, 0))::BIGINT AS dropped, CASE WHEN sum(a) = 0 THEN 1.0 ELSE (sum(a) - sum(greatest(a - b, 0))) / sum(a)::DOUBLE END AS ratio FROM n GROUP BY 1
""")
def preservation_ratio(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select("source", F.explode(F.split("text", " ")).alias("w"), (F.col("doc_id") % 2).alias("side"))
    n = words.groupBy("source", "w").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    n = n.groupBy("source").agg(F.sum("a").alias("total"), F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("dropped"))
    return n.select("source", "total", "dropped", rc.preservation(F.col("total"), F.col("dropped")).alias("ratio"))


_MARKS, _PLAIN = fn.MARKED, fn.PLAIN


@query(f"SELECT doc_id, length(k) AS n FROM (SELECT doc_id, regexp_replace(translate(lower(text), '{_MARKS}', '{_PLAIN}'), '[^a-z0-9]', '', 'g') AS k FROM documents) WHERE contains(k, 'laereou') OR contains(k, 'thehere')")
def canon_search(spark, sf_dir):
    keys = read(spark, sf_dir, "documents").select("doc_id", fn.fold(F.col("text")).alias("k"))
    return keys.where(F.col("k").contains("laereou") | F.col("k").contains("thehere")).select("doc_id", F.length("k").alias("n"))


@query("""
WITH RECURSIVE t AS (SELECT doc_id, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
h AS (SELECT doc_id, 0 AS hit, strpos(low, 'tion the') AS "at" FROM t WHERE contains(low, 'tion the')
UNION ALL SELECT h.doc_id, h.hit + 1, "at" + 7 + strpos(substr(low, "at" + 8), 'tion the') FROM h JOIN t ON t.doc_id = h.doc_id WHERE strpos(substr(low, "at" + 8), 'tion the') > 0)
SELECT h.doc_id, hit, "at"::INTEGER AS "at", substr(text, greatest("at" - 32, 1)::BIGINT, ("at" - greatest("at" - 32, 1))::BIGINT) AS before, substr(text, "at"::BIGINT, 8) AS found, substr(text, ("at" + 8)::BIGINT, 32) AS after FROM h JOIN t ON t.doc_id = h.doc_id
""")
def search_hits(spark, sf_dir):
    return dc.search_hits(read(spark, sf_dir, "documents"), "Tion The", "doc_id", "text")


@query(r"SELECT c_custkey, trim(regexp_replace(regexp_replace(c_name || '  (copy ' || c_custkey || ')', '\s*\([^()]*\)$', ''), '\s+', ' ', 'g')) AS title FROM customer")
def normal_titles(spark, sf_dir):
    name = F.concat("c_name", F.lit("  (copy "), F.col("c_custkey").cast("string"), F.lit(")"))
    return read(spark, sf_dir, "customer").select("c_custkey", fn.normal_title(fn.without_suffix(name)).alias("title"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'en' WHEN 'fr' THEN 'fr' WHEN 'de' THEN 'de' WHEN 'es' THEN 'es' END AS lang FROM documents")
def norm_language(spark, sf_dir):
    tag = F.when(F.col("lang") == "en", "EN_us").when(F.col("lang") == "fr", "fra-FR").when(F.col("lang") == "de", "ger").otherwise(F.col("lang"))
    return read(spark, sf_dir, "documents").select("doc_id", fn.normal_language(tag).alias("lang"))


@query("SELECT page_id, CASE WHEN url LIKE '#%' THEN 'fragment' WHEN regexp_matches(url, '(?i)^(https?|ftp)://') THEN 'external' ELSE 'chapter' END AS kind, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, coalesce(nullif(regexp_extract(url, '#(.*)$', 1), ''), '') AS fragment FROM pages")
def href_kinds(spark, sf_dir):
    url = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", fn.href_kind(url).alias("kind"), F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")).alias("host"), F.coalesce(F.try_parse_url(url, F.lit("REF")), F.lit("")).alias("fragment"))


@query("SELECT page_id, '/a/' || lower(substr(url, 9, 3)) || '/x.html' AS path FROM pages WHERE regexp_matches(url, '^https://[a-z]{3}')")
def resolve_paths(spark, sf_dir):
    part = F.lower(F.substring("url", 9, 3))
    href = F.concat(F.lit("../"), part, F.lit("/./y/../x.html"))
    return read(spark, sf_dir, "pages").where(F.col("url").rlike("^https://[a-z]{3}")).select("page_id", fn.resolve_path(F.lit("/a/b/c.html"), href).alias("path"))


@query(r"""
WITH d AS (SELECT doc_id, regexp_replace(text, '[ \t\n\r]+', '', 'g') AS x FROM documents)
SELECT doc_id, CASE WHEN x <> replace(x, 'ion', 'oin') THEN length(string_split(x, 'ion')[1]) + 1 END AS at FROM d
""")
def first_divergence(spark, sf_dir):
    """Each document against itself with one pair of letters turned round wherever it occurs; white space does not count."""
    t = F.regexp_replace("text", r"[ \t\n\r]+", "")
    return read(spark, sf_dir, "documents").select("doc_id", dc.first_divergence(t, F.replace(t, F.lit("ion"), F.lit("oin"))).alias("at")).select("doc_id", F.col("at").cast("long").alias("at"))


@query(r"""
WITH m AS (SELECT item_id, left(regexp_replace(text, '\s+', '', 'g'), 48) AS head FROM benchmark), d AS (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS b FROM documents),
h AS (SELECT item_id, doc_id, strpos(b, head) AS "at", CASE WHEN strpos(substr(b, strpos(b, head) + 1), head) > 0 THEN 2 ELSE 1 END AS n FROM m JOIN d ON contains(b, head)),
g AS (SELECT item_id, sum(n) AS n, min(doc_id) AS doc_id, min("at") AS "at" FROM h GROUP BY 1)
SELECT m.item_id, CASE WHEN n = 1 THEN 'found' WHEN n > 1 THEN 'ambiguous' ELSE 'absent' END AS status, CASE WHEN n = 1 THEN doc_id END AS doc_id, CASE WHEN n = 1 THEN "at" END AS "at" FROM m LEFT JOIN g ON m.item_id = g.item_id
""")
def reanchor_status(spark, sf_dir):
    return dc.reanchor(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"), "item_id", "text", "doc_id", "text")


@query(r"""
WITH m AS (SELECT doc_id, left(regexp_replace(text, '\s+', '', 'g'), 48) AS head, regexp_replace(CASE WHEN doc_id % 3 = 0 THEN 'New opening. ' || text ELSE text END, '\s+', '', 'g') AS b FROM documents WHERE length(regexp_replace(text, '\s+', '', 'g')) > 0),
c AS (SELECT x.doc_id, y.doc_id AS into_id, strpos(y.b, x.head) AS "at", CASE WHEN strpos(substr(y.b, strpos(y.b, x.head) + 1), x.head) > 0 THEN 2 ELSE 1 END AS n FROM m x JOIN m y ON contains(y.b, x.head)),
g AS (SELECT doc_id, sum(n) AS n, min((into_id, "at")) AS p FROM c GROUP BY 1)
SELECT m.doc_id AS mark, CASE WHEN doc_id % 3 <> 0 THEN 'intact' WHEN n = 1 THEN 'found' WHEN n > 1 THEN 'ambiguous' ELSE 'absent' END AS status, CASE WHEN doc_id % 3 <> 0 THEN doc_id WHEN n = 1 THEN p[1] END AS doc_id, CASE WHEN doc_id % 3 <> 0 THEN 1 WHEN n = 1 THEN p[2] END AS "at"
FROM m LEFT JOIN g USING (doc_id)
""")
def reanchor_rebuilt(spark, sf_dir):
    """A mark at the opening of each document, after every third document was rebuilt with words before it."""
    docs = read(spark, sf_dir, "documents").where(F.length(dc.bare(F.col("text"))) > 0)
    rebuilt = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("New opening. "), "text")).otherwise(F.col("text")).alias("text"))
    marks = docs.select(F.col("doc_id").alias("mark"), "text", F.col("doc_id").alias("was"), F.lit(1).alias("place"))
    return dc.reanchor(marks, rebuilt, "mark", "text", "doc_id", "text", stored=("was", "place"))


@query("SELECT doc_id, md5(lower(strip_accents(text))) AS folded, length(strip_accents(text)) AS n FROM documents")
def folded_documents(spark, sf_dir):
    """Whole texts without marks."""
    folded = read(spark, sf_dir, "documents").select("doc_id", fn.fold_any(F.col("text")).alias("folded"))
    return folded.select("doc_id", F.md5(F.col("folded").cast("binary")).alias("folded"), F.length("folded").cast("long").alias("n"))


# -- sequences -------------------------------------------------------------------------------------------------------


@query("SELECT user_id, count(*) FILTER (value < before) AS n, min(ts) FILTER (value < before) AS first_at FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) GROUP BY 1")
def descents(spark, sf_dir):
    return sq.descents(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")


@query("SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at FROM conversations")
def running_axis(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", sq.running_axis(F.length("text"), "conv_id", ["turn"]).alias("at"))


@query("SELECT l_orderkey, l_linenumber, lead(s) OVER (PARTITION BY l_orderkey ORDER BY s, e) - e AS gap FROM (SELECT l_orderkey, l_linenumber, l_linenumber * 10 AS s, l_linenumber * 10 + cast(l_quantity AS INTEGER) AS e FROM lineitem)")
def gap_check(spark, sf_dir):
    spans = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") * 10).alias("s"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int")).alias("e"))
    return sq.gaps(spans, "l_orderkey", "s", "e").select("l_orderkey", "l_linenumber", "gap")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS signup FROM events")
def carry_forward(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", sq.carried(F.when(F.col("event_type") == "signup", F.col("event_id")), "user_id", ["ts", "event_id"]).alias("signup"))


@query("SELECT user_id, island, count(*) AS n, min(ts) AS start FROM (SELECT user_id, ts, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM events) GROUP BY 1, 2")
def islands(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    rows = e.withColumn("island", sq.islands(F.col("event_type") == "purchase", "user_id", ["ts", "event_id"]))
    return rows.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("ts").alias("start"))


@query("SELECT e.event_id, greatest(count(b.ts), 1) AS location FROM events e LEFT JOIN (SELECT user_id, ts FROM events WHERE event_type = 'view') b ON b.user_id = e.user_id AND b.ts <= e.ts WHERE e.event_type <> 'view' GROUP BY 1")
def location_for(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return sq.location_of(e.where("event_type <> 'view'").drop("event_type"), e.where("event_type = 'view'").select("user_id", "ts"), "user_id", "ts").select("event_id", "location")


@query("SELECT e.event_id, b.value AS price, b.ts AS price_at FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON b.user_id = e.user_id AND e.ts >= b.ts")
def asof_resolve(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    clicks = e.where("event_type = 'click'").select("user_id", "ts", "event_id")
    prices = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("price"))
    return sq.as_of(clicks, prices, "user_id", "ts", "price").select("event_id", "price", "price_at")


@query("""
WITH p AS (SELECT event_id, user_id, floor(value * 10)::INTEGER AS "at" FROM events WHERE event_id % 2 = 0), i AS (SELECT event_id AS span_id, user_id, floor(value * 10)::INTEGER - event_id % 40 AS s, floor(value * 10)::INTEGER + event_id % 60 AS e FROM events WHERE event_id % 2 = 1)
SELECT p.event_id, arg_min(span_id, (e - s, span_id)) AS span_id FROM p LEFT JOIN i ON p.user_id = i.user_id AND s <= "at" AND "at" <= e GROUP BY 1
""")
def note_in_highlight(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    at = F.floor(F.col("value") * 10).cast("int")
    points = e.where("event_id % 2 = 0").select("user_id", at.alias("at"), "event_id")
    spans = e.where("event_id % 2 = 1").select("user_id", (at - F.col("event_id") % 40).alias("s"), (at + F.col("event_id") % 60).alias("e"), F.col("event_id").alias("span_id"))
    return sq.tightest_interval(points, spans, "user_id", "at", "s", "e", "span_id", "event_id", 128)


@query("""
WITH r AS (SELECT conv_id, turn, 1 + length(text) % 4 AS level FROM conversations)
SELECT conv_id, turn, level, (SELECT max(p.turn) FROM r p WHERE p.conv_id = r.conv_id AND p.turn < r.turn AND p.level < r.level) AS parent FROM r
""")
def nest_by_level(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", (1 + F.length("text") % 4).alias("level"))
    return sq.parents_by_level(rows, "conv_id", "turn", "level", "turn").select("conv_id", "turn", "level", "parent")


@query("""
WITH m AS (SELECT conv_id, turn AS k, turn * 2 AS ord FROM conversations WHERE turn % 2 = 0), x AS (SELECT conv_id, turn AS k, turn AS ord FROM conversations WHERE turn % 4 <> 2)
SELECT conv_id, k, row_number() OVER (PARTITION BY conv_id ORDER BY "at", side, place) AS place FROM (
SELECT conv_id, k, ord AS "at", 0 AS side, ord AS place FROM m UNION ALL
SELECT conv_id, k, "at", 1, ord FROM (SELECT x.conv_id, x.k, x.ord, m.ord AS own, coalesce(last_value(m.ord IGNORE NULLS) OVER (PARTITION BY x.conv_id ORDER BY x.ord ROWS UNBOUNDED PRECEDING), -1) AS "at" FROM x LEFT JOIN m ON m.conv_id = x.conv_id AND m.k = x.k) WHERE own IS NULL)
""")
def merge_ordered_lists(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("k"))
    main, extra = c.where("k % 2 = 0").withColumn("ord", F.col("k") * 2), c.where("k % 4 <> 2").withColumn("ord", F.col("k"))
    rows = sq.merged_order(main, extra, "conv_id", "k", "ord")
    return rows.select("conv_id", "k", F.row_number().over(Window.partitionBy("conv_id").orderBy("at", "side", "place")).cast("long").alias("place"))


# -- pages -----------------------------------------------------------------------------------------------------------

_BARE = r"regexp_replace(html, '(?is)<script\b.*?</script\s*>|<!--.*?-->', ' ', 'g')"


@query(rf"SELECT tag, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, lower(unnest(regexp_extract_all({_BARE}, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM pages) GROUP BY 1")
def tag_counts(spark, sf_dir):
    per_page = read(spark, sf_dir, "pages").select("page_id", F.explode(dc.open_tags(F.col("html"))).alias("tag")).groupBy("page_id", "tag").agg(F.count("*").alias("n"))
    return per_page.groupBy("tag").agg(F.sum("n").alias("n"), F.count("*").alias("pages"))


_GROUPS = " ".join(f"WHEN tag IN ({', '.join(repr(t) for t in tags)}) THEN '{name}'" for name, tags in dc.TAG_GROUPS.items())


@query(rf"SELECT kind, n, n / sum(n) OVER ()::DOUBLE AS ratio FROM (SELECT CASE {_GROUPS} ELSE 'other' END AS kind, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all({_BARE}, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM pages) GROUP BY 1)")
def tag_bucket_ratio(spark, sf_dir):
    kinds = read(spark, sf_dir, "pages").select(F.explode(dc.open_tags(F.col("html"))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).groupBy(dc.tag_group(F.col("tag")).alias("kind")).agg(F.sum("n").alias("n"))
    return kinds.crossJoin(kinds.agg(F.sum("n").alias("total"))).select("kind", "n", (F.col("n") / F.col("total")).alias("ratio"))


@query(r"SELECT level, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<h([1-6])\b', 1))::INTEGER AS level FROM pages) GROUP BY 1")
def heading_counts(spark, sf_dir):
    return read(spark, sf_dir, "pages").select(F.explode(F.transform(F.regexp_extract_all("html", F.lit(r"(?i)<h([1-6])\b"), F.lit(1)), lambda x: x.cast("int"))).alias("level")).groupBy("level").agg(F.count("*").alias("n"))


@query(r"SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)) AS title, nullif(regexp_extract(html, '(?i)<html[^>]*\blang=\"([^\"]*)\"', 1), '') AS lang FROM pages")
def html_title(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title", 1)).alias("title"), F.nullif(F.regexp_extract("html", r'(?i)<html[^>]*\blang="([^"]*)"', 1), F.lit("")).alias("lang"))


_LINKS = r"regexp_extract_all(html, '<a\b[^>]*?\bhref\s*=\s*[\"'']([^\"'']*)[\"'']', 1)"


@query(rf"SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest({_LINKS}) AS href FROM pages) GROUP BY ALL")
def link_extract(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.explode(dc.links(F.col("html"))).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query(rf"SELECT page_id, href FROM (SELECT DISTINCT page_id, unnest({_LINKS}) AS href FROM pages) l WHERE NOT EXISTS (SELECT 1 FROM (SELECT '/' || unnest(string_split(text, ' ')) AS t FROM documents) x WHERE x.t = l.href)")
def broken_links(spark, sf_dir):
    edges = read(spark, sf_dir, "pages").select("page_id", F.explode(dc.links(F.col("html"))).alias("href")).distinct()
    targets = read(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("t")).select(F.concat(F.lit("/"), "t").alias("t"))
    return gr.broken(edges, targets, "href", "t")


@query(rf"SELECT href, count(*) AS n, list_sort(list(DISTINCT page_id)) AS sources FROM (SELECT page_id, unnest({_LINKS}) AS href FROM pages) GROUP BY 1")
def reverse_links(spark, sf_dir):
    return gr.reverse(read(spark, sf_dir, "pages").select("page_id", F.explode(dc.links(F.col("html"))).alias("href")), "page_id", "href")


@query(r"""
WITH b AS (SELECT page_id, regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<rp\b.*?</rp\s*>|<!--.*?-->', ' ', 'g') AS h FROM pages)
SELECT page_id, sha256(t) AS digest, length(t) AS n FROM (SELECT page_id, trim(regexp_replace(regexp_replace(h, '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\f\r]+', ' ', 'g')) AS t FROM b)
""")
def visible_text(spark, sf_dir):
    t = read(spark, sf_dir, "pages").select("page_id", fn.visible_text(F.col("html")).alias("t"))
    return t.select("page_id", F.sha2(F.col("t").cast("binary"), 256).alias("digest"), F.length("t").alias("n"))


@query(r"SELECT page_id, len(h) AS n_headings, regexp_matches(html, '(?i)<img\b') AS has_image, regexp_matches(html, '(?i)<table\b') AS has_table, regexp_matches(html, '(?i)copyright|©') AS rights FROM (SELECT page_id, html, regexp_extract_all(html, '(?is)<h([1-6])\b[^>]*>.*?</h[1-6]\s*>', 0) AS h FROM pages)")
def page_features(spark, sf_dir):
    html = F.col("html")
    return read(spark, sf_dir, "pages").select("page_id", F.size(dc.headings(html)).cast("long").alias("n_headings"), html.rlike(r"(?i)<img\b").alias("has_image"), html.rlike(r"(?i)<table\b").alias("has_table"), html.rlike("(?i)copyright|©").alias("rights"))


@query(NODES + """SELECT tag, len(anc)::INTEGER AS depth, count(*) AS n, sum(length(said))::BIGINT AS chars FROM nodes GROUP BY ALL""")
def html_node_table(spark, sf_dir):
    """Node rows by tag and depth; held against the parser's own walk in the tests."""
    nodes = dc.html_nodes(read(spark, sf_dir, "pages"))
    return nodes.groupBy("tag", "depth").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(NODES + """SELECT p.page_id, a.node_id AS ctx, p.node_id, row_number() OVER (PARTITION BY p.page_id, a.node_id ORDER BY p.node_id)::INTEGER AS at FROM nodes p JOIN nodes a ON a.page_id = p.page_id AND a.tag = 'article' AND list_contains(p.anc, a.node_id) WHERE p.tag = 'p'""")
def axis_descendant(spark, sf_dir):
    """Paragraphs under each article, by position."""
    nodes = dc.html_nodes(read(spark, sf_dir, "pages"))
    found = dc.axis(nodes, nodes.where("tag = 'article'"), "descendant").where("tag = 'p'")
    return found.withColumn("at", dc.position()).select("page_id", "ctx", "node_id", "at")


@query(NODES + """SELECT * FROM (SELECT c.page_id, c.node_id AS ctx, b.node_id, row_number() OVER (PARTITION BY c.page_id, c.node_id ORDER BY b.node_id DESC)::INTEGER AS "at" FROM nodes c JOIN nodes b ON b.page_id = c.page_id AND b.anc[-1] IS NOT DISTINCT FROM c.anc[-1] AND b.node_id < c.node_id WHERE c.tag = 'p') WHERE "at" <= 2""")
def axis_preceding_sibling(spark, sf_dir):
    """The first two elements before each paragraph, counted outwards."""
    nodes = dc.html_nodes(read(spark, sf_dir, "pages"))
    found = dc.axis(nodes, nodes.where("tag = 'p'"), "preceding-sibling")
    return found.withColumn("at", dc.position(reverse=True)).where("at <= 2").select("page_id", "ctx", "node_id", "at")


@query(NODES + """SELECT DISTINCT d.page_id, d.node_id FROM nodes d WHERE d.tag IN ('a', 'p') AND EXISTS (SELECT 1 FROM nodes x WHERE x.page_id = d.page_id AND x.tag IN ('article', 'ul') AND list_contains(d.anc, x.node_id)) AND NOT EXISTS (SELECT 1 FROM nodes x WHERE x.page_id = d.page_id AND x.tag = 'nav' AND list_contains(d.anc, x.node_id))""")
def node_set_operations(spark, sf_dir):
    """Paragraphs and links in articles or lists, without those below navigation."""
    nodes = dc.html_nodes(read(spark, sf_dir, "pages"))
    # one parse and one join: which kinds of element hold a node
    some = nodes.where("tag IN ('article', 'ul', 'nav')")
    held = dc.axis(nodes.where("tag IN ('a', 'p')"), some, "descendant").join(some.select("page_id", F.col("node_id").alias("ctx"), F.col("tag").alias("by")), ["page_id", "ctx"])
    kinds = held.groupBy("page_id", "node_id").agg(F.bool_or(F.col("by") != "nav").alias("_in"), F.bool_or(F.col("by") == "nav").alias("_out"))
    return kinds.where("_in AND NOT _out").select("page_id", "node_id")


# -- graphs and findings ---------------------------------------------------------------------------------------------


@query("""
WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation UNION SELECT n_nationkey, (n_nationkey + 10) % 25 FROM nation WHERE n_regionkey < 2), w AS (SELECT 0 AS node, 0 AS depth UNION SELECT b, depth + 1 FROM w JOIN e ON a = node WHERE depth < 24)
SELECT node, min(depth) AS depth FROM w GROUP BY 1
""")
def reachability(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    edges = n.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("dst")).union(n.where("n_regionkey < 2").select("n_nationkey", (F.col("n_nationkey") + 10) % 25))
    return gr.reachable(edges, spark.createDataFrame([(0,)], "node int"))


@query("""
WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation), w AS (SELECT a AS start, b AS node, 1 AS n FROM e UNION SELECT start, b, n + 1 FROM w JOIN e ON a = node WHERE node <> start AND n < 26)
SELECT DISTINCT start AS node FROM w WHERE node = start
""")
def cycle_check(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    return gr.on_cycles(n.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("dst")))


@query("""
WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 6) % 25 AS b FROM nation), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w AS (SELECT a AS node, a AS other FROM u UNION SELECT w.node, u.b FROM w JOIN u ON u.a = w.other)
SELECT node, min(other) AS least FROM w GROUP BY 1
""")
def name_equivalence(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    return gr.equivalence_classes(n.select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") * 6) % 25).alias("b")))


@query("""
SELECT conv_id, CASE WHEN m > 0 THEN 'MISORDERED' WHEN f > 0 THEN 'FLATTENED' WHEN c > 2 THEN 'OK' WHEN e >= 5 AND e > l THEN 'SUSPECT' ELSE 'SPARSE' END AS verdict
FROM (SELECT conv_id, count(*) FILTER (length(text) < 60) AS m, count(*) FILTER (length(text) BETWEEN 60 AND 80) AS f, count(*) FILTER (role = 'user') AS c, max(length(text)) // 100 AS e, count(*) AS l FROM conversations GROUP BY 1)
""")
def toc_verdict(spark, sf_dir):
    size = F.length("text")
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count_if(size < 60).alias("m"), F.count_if(size.between(60, 80)).alias("f"), F.count_if(F.col("role") == "user").alias("c"), F.floor(F.max(size) / 100).alias("e"), F.count("*").alias("l"))
    return rows.select("conv_id", fd.toc_verdict(F.col("m"), F.col("f"), F.col("c"), F.col("e"), F.col("l")).alias("verdict"))


_RULES = [
    ("price", "error", "l_extendedprice <= 0", "price is not above 0"), ("discount", "warning", "l_discount > 0.08", "discount above 8 %"), ("quantity", "info", "l_quantity >= 49", "large quantity"), ("tax", "warning", "l_tax > 0.07 AND l_discount < 0.01", "tax without discount"),
]


def _line_findings(spark, sf_dir):
    rules = [fd.Rule(c, s, F.expr(e), m) for c, s, e, m in _RULES]
    return fd.findings(read(spark, sf_dir, "lineitem"), rules, F.concat_ws(":", "l_orderkey", "l_linenumber"))


_FINDINGS = " UNION ALL ".join(f"SELECT '{c}' AS check, '{s}' AS severity, l_orderkey || ':' || l_linenumber AS location, '{m}' AS message FROM lineitem WHERE {e}" for c, s, e, m in _RULES)


@query(_FINDINGS)
def findings_union(spark, sf_dir):
    return _line_findings(spark, sf_dir)


@query(f"SELECT severity, count(*) AS n FROM ({_FINDINGS}) GROUP BY 1")
def severity_counts(spark, sf_dir):
    return fd.severity_counts(_line_findings(spark, sf_dir))


@query("SELECT fired, count(*) AS n FROM (SELECT CASE WHEN l_quantity >= 45 THEN 'bulk' WHEN l_returnflag = 'R' THEN 'returned' WHEN l_discount = 0 THEN 'full price' END AS fired FROM lineitem) GROUP BY 1")
def first_rule_fires(spark, sf_dir):
    fired = fd.first_rule([(F.col("l_quantity") >= 45, "bulk"), (F.col("l_returnflag") == "R", "returned"), (F.col("l_discount") == 0, "full price")])
    return read(spark, sf_dir, "lineitem").groupBy(fired.alias("fired")).agg(F.count("*").alias("n"))


@query(NODES + """SELECT a.page_id, a.node_id, coalesce(bool_and(length(trim(p.said)) > 0), true) AS holds FROM nodes a LEFT JOIN nodes p ON p.page_id = a.page_id AND p.tag = 'p' AND list_contains(p.anc, a.node_id) WHERE a.tag = 'article' GROUP BY 1, 2""")
def every_paragraph_has_text(spark, sf_dir):
    """Articles all of whose paragraphs have text."""
    nodes = dc.html_nodes(read(spark, sf_dir, "pages"))
    articles = nodes.where("tag = 'article'")
    own = nodes.where("tag = 'p'").select("page_id", "node_id", (F.length(F.trim("text")) > 0).alias("said"))
    found = dc.axis(nodes, articles, "descendant").join(own, ["page_id", "node_id"])
    return tr.quantified(articles, found, F.col("said"), every=True)


@query(NODES + """SELECT tag, CASE WHEN class = 'ad' AND tag = 'div' THEN 'pink' WHEN class = 'ad' THEN 'red' WHEN tag = 'h1' THEN 'blue' WHEN tag = 'p' THEN 'grey' ELSE 'black' END AS value, count(*) AS n FROM nodes GROUP BY ALL""")
def style_cascade(spark, sf_dir):
    """What a small sheet of rules gives the elements of the pages, by tag."""
    rules = spark.createDataFrame([(None, None, None, 0, 0, "color", "black"), ("p", None, None, 1, 1, "color", "grey"), (None, "ad", None, 1, 2, "color", "red"), ("h1", None, None, 1, 3, "color", "blue"), ("div", "ad", None, 1, 4, "color", "pink")], "tag string, class string, id string, origin int, ord int, property string, value string")
    nodes = dc.html_nodes(read(spark, sf_dir, "pages"))
    return tr.cascade(nodes, rules).join(nodes.select("page_id", "node_id", "tag"), ["page_id", "node_id"]).groupBy("tag", "value").agg(F.count("*").alias("n"))


@query("""
SELECT c_custkey AS page_id, 0 AS table_id, x.* FROM customer, (VALUES (0, 0, 2, 1, true, 'k'), (0, 1, 1, 2, false, 'a'), (0, 3, 3, 1, false, 'z'), (1, 1, 1, 1, false, 'b'), (1, 2, 2, 1, false, 'c'), (2, 0, 1, 2, false, 'd'), (3, 0, 1, 1, false, 'e')) x("row", col, row_span, col_span, header, text) WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, 0, 0, 0, 1, 3, true, c_name FROM customer WHERE c_custkey % 2 = 1 UNION ALL SELECT c_custkey, 0, 1, 0, 1, 1, false, 'x' FROM customer WHERE c_custkey % 2 = 1
""")
def table_cells(spark, sf_dir):
    """Cells of tables whose spans push cells of later rows aside."""
    spans = '<table><tr><th rowspan="2">k</th><td colspan="2">a</td><td rowspan="3">z</td></tr><tr><td>b</td><td rowspan="2">c</td></tr><tr><td colspan="2">d</td></tr><tr><td>e</td></tr></table>'
    plain = F.concat(F.lit('<table><tr><th colspan="3">'), "c_name", F.lit("</th></tr><tr><td>x</td></tr></table>"))
    return tr.table_cells(dc.html_nodes(read(spark, sf_dir, "customer").select("c_custkey", "c_name").repartition(4 * spark.sparkContext.defaultParallelism, "c_custkey").select(F.col("c_custkey").alias("page_id"), F.when(F.col("c_custkey") % 2 == 0, spans).otherwise(plain).alias("html"))))


@query("""
WITH refs AS (SELECT 'customer' AS kind, o_custkey * 2 AS key FROM orders UNION ALL SELECT 'part', l_partkey + 100 FROM lineitem), t AS (SELECT 'customer' AS kind, c_custkey AS key FROM customer UNION ALL SELECT 'part', p_partkey FROM part)
SELECT kind, count(*) AS n FROM refs WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.kind = refs.kind AND t.key = refs.key) GROUP BY 1
""")
def dangling_references(spark, sf_dir):
    of = lambda t, kind, key: read(spark, sf_dir, t).select(F.lit(kind).alias("kind"), key.alias("key"))
    refs = of("orders", "customer", F.col("o_custkey") * 2).unionByName(of("lineitem", "part", F.col("l_partkey") + 100))
    return tr.dangling(refs, of("customer", "customer", F.col("c_custkey")).unionByName(of("part", "part", F.col("p_partkey"))))
