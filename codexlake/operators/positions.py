"""Positions and values: spans of text over elements, dynamic values as path rows, dictionaries, styles, dates, batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def span_text(elements: DataFrame, spans: DataFrame, key: str, order: str, text: str, keep: bool = False) -> DataFrame:
    """(key, text), with keep the spans' ends too, of spans (key, a, off_a, b, off_b): from off_a in element a up to off_b in element b."""
    rows = elements.select(key, order, F.col(text).alias("_text")).join(spans, key).where(F.col(order).between(F.col("a"), F.col("b")))
    part = F.when((F.col(order) == F.col("a")) & (F.col("a") == F.col("b")), F.substring("_text", F.col("off_a") + 1, F.col("off_b") - F.col("off_a")))
    part = part.when(F.col(order) == F.col("a"), F.substring("_text", F.col("off_a") + 1, F.length("_text"))).when(F.col(order) == F.col("b"), F.substring("_text", F.lit(1), F.col("off_b"))).otherwise(F.col("_text"))
    said = F.array_sort(F.collect_list(F.struct(F.col(order), part.alias("_part"))))
    return rows.groupBy(key, "a", "off_a", "b", "off_b").agg(said.alias("_said")).select(key, *(("a", "off_a", "b", "off_b") if keep else ()), F.array_join(F.transform("_said", lambda x: x["_part"]), "").alias(text))


def variant_paths(rows: DataFrame, group: str, json: str) -> DataFrame:
    """(group, path, kind, n, top) of the fields of JSON objects."""
    keys = F.explode(F.json_object_keys(json)).alias("path")
    value = F.try_variant_get(F.try_parse_json(json), "$", "map<string,variant>")
    fields = rows.where(F.col(json).isNotNull()).select(group, keys, value.alias("_v")).select(group, "path", F.element_at("_v", F.col("path")).alias("_x"))
    kinds = fields.select(group, "path", F.schema_of_variant("_x").alias("kind"), F.try_variant_get("_x", "$", "bigint").alias("_n"))
    return kinds.groupBy(group, "path", "kind").agg(F.count("*").alias("n"), F.max("_n").alias("top"))


def dictionary(rows: DataFrame, word: str) -> DataFrame:
    """(word, id): ids from 1 in the order of the words. Words are ranked in ranges, so no task holds the whole dictionary's order."""
    words = rows.select(word).distinct().where(F.col(word).isNotNull())
    sliced = words.withColumn("_slice", F.coalesce(F.ascii(F.col(word)), F.lit(0)))
    local = sliced.withColumn("_at", F.row_number().over(Window.partitionBy("_slice").orderBy(word)))
    before = sliced.groupBy("_slice").agg(F.count("*").alias("_n")).select("_slice", F.coalesce(F.sum("_n").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return local.join(before, "_slice").select(word, (F.col("_before") + F.col("_at")).cast("long").alias("id"))


def css_usage(pages: DataFrame, html: str, supported: Sequence[str]) -> DataFrame:
    """(property, seen, supported) of the properties in style elements."""
    css = F.regexp_extract_all(html, F.lit(r"(?is)<style[^>]*>(.*?)</style"), F.lit(1))
    names = F.flatten(F.transform(css, lambda x: F.regexp_extract_all(x, F.lit(r"([a-zA-Z-]+)\s*:[^;{}]+[;}]"), F.lit(1))))
    rows = pages.select(F.explode(F.transform(names, lambda x: F.lower(F.trim(x)))).alias("property"))
    return rows.groupBy("property").agg(F.count("*").alias("seen")).withColumn("supported", F.col("property").isin(*supported))


def valid_date(text: Column) -> Column:
    """Year, year and month, or a real day."""
    shape = text.rlike(r"^[0-9]{4}(-(0[1-9]|1[0-2])(-(0[1-9]|[12][0-9]|3[01]))?)?$")
    return shape & ((F.length(text) < 10) | F.try_to_date(text, "yyyy-MM-dd").isNotNull())


def ruby_pairs(text: Column) -> Column:
    """base《reading》 pairs: the base is what a bar marks, else the run of ideographs before the bracket."""
    found = F.regexp_extract_all(text, F.lit("(?:｜[^｜《》]+|[一-鿿々]+)《[^《》]+》"), F.lit(0))
    base = lambda x: F.regexp_replace(F.substring_index(x, "《", 1), "^｜", "")
    return F.transform(found, lambda x: F.struct(base(x).alias("base"), F.regexp_extract(x, "《([^《》]+)》", 1).alias("reading")))


def percent_decode(text: Column) -> Column:
    """%XX decoded; a plus stays a plus."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def budget_batches(rows: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """(group, batch, n, size): rows in order, closed when the next would go beyond the budget. Greedy, so a fold over each group's sizes."""
    sizes = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s")))).alias("_items"))
    empty = F.array().cast("array<struct<n:bigint,size:bigint>>")
    one = lambda x: F.array(F.struct(F.lit(1).cast("long").alias("n"), x["s"].alias("size")))
    last = lambda a: F.element_at(a, -1)
    grown = lambda a, x: F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct((last(a)["n"] + 1).alias("n"), (last(a)["size"] + x["s"]).alias("size"))))
    step = lambda a, x: F.when(F.size(a) == 0, one(x)).when(last(a)["size"] + x["s"] > budget, F.concat(a, one(x))).otherwise(grown(a, x))
    return sizes.select(group, F.posexplode(F.aggregate("_items", empty, step)).alias("_at", "_b")).select(group, (F.col("_at") + 1).cast("long").alias("batch"), "_b.n", "_b.size")
