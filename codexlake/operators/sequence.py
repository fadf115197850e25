"""Ordered data: descents, running axes, gaps, carried values, islands, as-of and interval lookups, nesting, merging.

As-of lookups are a union and a running last over each key, never a range join; interval lookups meet on buckets.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from codexlake.operators.graph import _kept


def descents(rows: DataFrame, group: str, order: Sequence[str], value: str) -> DataFrame:
    """(group, n, first_at): how often value falls below the one before, and the first place (of the first order column)."""
    w = Window.partitionBy(group).orderBy(*order)
    fell = rows.withColumn("_fell", F.col(value) < F.lag(value).over(w))
    return fell.groupBy(group).agg(F.count_if("_fell").alias("n"), F.min(F.when(F.col("_fell"), F.col(order[0]))).alias("first_at"))


def running_axis(size: Column, group: str, order: Sequence[str]) -> Column:
    """The sum of the sizes before a row."""
    return F.coalesce(F.sum(size).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def gaps(rows: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """rows with gap to the next span of the group: above 0 a hole, below 0 an overlap; null at the end."""
    return rows.withColumn("gap", F.lead(start).over(Window.partitionBy(group).orderBy(start, end)) - F.col(end))


def carried(value: Column, group: str, order: Sequence[str]) -> Column:
    """The last value that is not null, up to and with a row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def islands(starts: Column, group: str, order: Sequence[str]) -> Column:
    """The number of the island of a row: rows from one start to the next; 0 before the first."""
    return F.sum(F.when(starts, 1).otherwise(0)).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left with value and value_at of the last row of right at or before it, under one key."""
    own = [c for c in left.columns if c not in (key, at)]
    both = left.select(key, at, F.lit(1).alias("_side"), F.struct(*own).alias("_own"), F.lit(None).cast(right.schema[value].dataType).alias("_value"), F.lit(None).cast(right.schema[at].dataType).alias("_at"))
    marks = right.select(key, at, F.lit(0).alias("_side"), F.lit(None).cast(both.schema["_own"].dataType).alias("_own"), F.col(value).alias("_value"), F.col(at).alias("_at"))
    last = F.last(F.when(F.col("_side") == 0, F.struct("_value", "_at")), ignorenulls=True).over(Window.partitionBy(key).orderBy(at, "_side", "_value").rowsBetween(Window.unboundedPreceding, 0))
    found = both.unionByName(marks).withColumn("_last", last).where("_side = 1")
    return found.select(key, at, "_own.*", F.col("_last._value").alias(value), F.col("_last._at").alias(f"{value}_at"))


def location_of(left: DataFrame, boundaries: DataFrame, key: str, at: str) -> DataFrame:
    """left with location: the number of boundaries at or before it, 1 at least."""
    own = [c for c in left.columns if c not in (key, at)]
    rows = left.select(key, at, F.lit(1).alias("_side"), F.struct(*own).alias("_own"))
    marks = boundaries.select(key, at, F.lit(0).alias("_side"), F.lit(None).cast(rows.schema["_own"].dataType).alias("_own"))
    n = F.sum(F.when(F.col("_side") == 0, 1).otherwise(0)).over(Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0))
    return rows.unionByName(marks).withColumn("_n", n).where("_side = 1").select(key, at, "_own.*", F.greatest("_n", F.lit(1)).alias("location"))


def dyadic_cover(first: int, last: int) -> list[tuple[int, int]]:
    """The fewest blocks (level, number) of 2 ** level places that make up first to last: two for each level at most."""
    out, level = [], 0
    while first <= last:
        if first & 1:
            out.append((level, first))
            first += 1
        if first <= last and not last & 1:
            out.append((level, last))
            last -= 1
        first, last, level = first >> 1, last >> 1, level + 1
    return out


def tightest_span(points: DataFrame, spans: DataFrame, key: str, point_id: str, span_id: str) -> DataFrame:
    """(key, point_id, span_id): the narrowest span of the key that holds a point, by (elements, offset) tuples, least id on a tie; null if none does.

    points and spans have es, os, ee, oe: element and offset of start and end; an end that is null is the start. A span is
    what it holds of its first element, of its last one and the elements between; one in a single element is a run of
    offsets. Runs are filed under the blocks of their dyadic cover, whose number grows with the logarithm of their length,
    and of all that is filed alike the narrowest stays. A place meets that one row of each block that it lies in, and the
    narrowest of the starts before it and of the ends behind it in its element by running minima: points and the spans
    around them never make pairs. Only points that are ranges themselves meet the spans one by one.
    """
    whole = lambda d: d.withColumn("ee", F.coalesce("ee", "es")).withColumn("oe", F.coalesce("oe", "os")).where("es IS NOT NULL AND os IS NOT NULL")
    ends = ("es", "os", "ee", "oe")
    own = whole(spans).select(key, F.col(span_id).alias("_span"), *(F.col(c).cast("long").alias(c) for c in ends)).where(F.col(key).isNotNull() & F.expr("(es, os) <= (ee, oe)"))
    asked = whole(points).select(key, F.col(point_id).alias("_point"), *(F.col(c).cast("long").alias(c) for c in ends)).where(F.col(key).isNotNull())
    between, within, starts, stops = range(4)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for k, (es, os, ee, oe) in enumerate(zip(*(batch.column(c).to_pylist() for c in ends), strict=True)):
                if es == ee:
                    parts += [(k, within, es, level, block) for level, block in dyadic_cover(os, oe)]
                else:
                    parts += [(k, starts, es, 0, os), (k, stops, ee, 0, oe), *((k, between, 0, level, block) for level, block in dyadic_cover(es + 1, ee - 1))]
            row, kind, element, level, block = zip(*parts, strict=True) if parts else [()] * 5
            columns = [*batch.take(pa.array(row, pa.int64())).columns, pa.array(kind, pa.int32()), pa.array(element, pa.int64()), pa.array(level, pa.int32()), pa.array(block, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_kind", "_el", "_level", "_block"])

    slot = [key, "_kind", "_el", "_level", "_block"]
    kinds = [StructField("_kind", IntegerType()), StructField("_el", LongType()), StructField("_level", IntegerType()), StructField("_block", LongType())]
    width = F.struct((F.col("ee") - F.col("es")).alias("e"), (F.col("oe") - F.col("os")).alias("o"), F.col("_span").alias("i"))
    filed = _kept(own.mapInArrow(file, StructType([*own.schema.fields, *kinds])).groupBy(*slot).agg(F.min(width).alias("_w")))
    covers = filed.where(F.col("_kind").isin(between, within))
    used = {kind: [r[1] for r in rows] for kind, rows in groupby(sorted(covers.select("_kind", "_level").distinct().collect()), key=itemgetter(0))}
    place = asked.where("es = ee AND os = oe").select(key, F.col("es").alias("_pe"), F.col("os").alias("_po")).distinct()
    at = lambda rows, kind, element, value: rows.select(key, "_pe", "_po", F.lit(kind).alias("_kind"), element.cast("long").alias("_el"), F.explode(F.array(*map(F.lit, used.get(kind, []))).cast("array<int>")).alias("_level"), value.alias("_x")).withColumn("_block", F.expr("shiftright(_x, _level)")).drop("_x")
    elements = place.select(key, "_pe", F.lit(None).cast("long").alias("_po")).distinct()
    looked = at(elements, between, F.lit(0), F.col("_pe")).unionByName(at(place, within, F.col("_pe"), F.col("_po"))).join(covers, slot)
    none = F.lit(None).cast(filed.schema["_w"].dataType)
    mark = lambda rows, element, offset, first=none, last=none, held=none, asks=False: rows.select(key, F.col(element).alias("_pe"), F.col(offset).alias("_po"), first.alias("_first"), last.alias("_last"), held.alias("_held"), F.lit(asks).alias("_asks"))
    w, whole_element = F.col("_w"), F.col("_kind") == between
    marks = [
        mark(filed.where(F.col("_kind") == starts), "_el", "_block", first=w), mark(filed.where(F.col("_kind") == stops), "_el", "_block", last=w),
        # what holds a whole element starts before all of its offsets
        mark(looked, "_pe", "_po", first=F.when(whole_element, w), held=F.when(~whole_element, w)), mark(place, "_pe", "_po", asks=True),
    ]
    marks = reduce(DataFrame.unionByName, marks).groupBy(key, "_pe", "_po").agg(F.min("_first").alias("_first"), F.min("_last").alias("_last"), F.min("_held").alias("_held"), F.max("_asks").alias("_asks"))
    element = Window.partitionBy(key, "_pe")
    running = lambda order: element.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    found = marks.withColumn("_first", F.min("_first").over(running(F.asc_nulls_first("_po")))).withColumn("_last", F.min("_last").over(running(F.desc_nulls_last("_po"))))
    found = found.where("_asks").select(key, F.col("_pe").alias("es"), F.col("_po").alias("os"), F.least("_first", "_last", "_held").alias("_w")).where("_w IS NOT NULL")
    best = asked.where("es = ee AND os = oe").select(key, "_point", "es", "os").join(found, [key, "es", "os"]).select(key, "_point", "_w")
    ranges = asked.where("es <> ee OR os <> oe")
    if not ranges.isEmpty():
        best = best.unionByName(_held_ranges(ranges, own, key))
    best = best.groupBy(key, "_point").agg(F.min("_w").alias("_w")).select(key, F.col("_point").alias(point_id), F.col("_w.i").alias(span_id))
    return points.select(key, point_id).join(best, [key, point_id], "left")


def _held_ranges(ranges: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """(key, _point, _w) for each range and span that holds it: a span is filed under the blocks of its elements' dyadic cover, a range asks for the one block of each level that its start lies in."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cover = [dyadic_cover(a, b) for a, b in zip(batch.column("es").to_pylist(), batch.column("ee").to_pylist(), strict=True)]
            rows = batch.take(pa.array([k for k, c in enumerate(cover) for _ in c], pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([x for c in cover for x, _ in c], pa.int32()), pa.array([x for c in cover for _, x in c], pa.int64())], names=[*rows.schema.names, "_level", "_block"])

    deepest = spans.agg(F.max(F.col("ee") - F.col("es"))).first()[0]
    levels = list(range((deepest or 0).bit_length() + 1))
    filed = spans.mapInArrow(file, StructType([*spans.schema.fields, StructField("_level", IntegerType()), StructField("_block", LongType())]))
    filed = filed.select(key, "_level", "_block", F.struct("es", "os").alias("_s"), F.struct("ee", "oe").alias("_e"), F.struct((F.col("ee") - F.col("es")).alias("e"), (F.col("oe") - F.col("os")).alias("o"), F.col("_span").alias("i")).alias("_w"))
    asked = ranges.select(key, "_point", F.struct("es", "os").alias("_ps"), F.struct(F.col("ee").alias("es"), F.col("oe").alias("os")).alias("_pe"), F.explode(F.array(*map(F.lit, levels))).alias("_level")).withColumn("_block", F.expr("shiftright(_ps.es, _level)"))
    return asked.join(filed, [key, "_level", "_block"]).where((F.col("_s") <= F.col("_ps")) & (F.col("_pe") <= F.col("_e"))).select(key, "_point", "_w")


def tightest_interval(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, interval_id: str, point_id: str, bucket: int) -> DataFrame:
    """(point_id, interval_id): the narrowest interval of the key that holds the point, least id on a tie; null if none does.

    Intervals are laid over buckets of the axis and meet points bucket by bucket, so the join is an equality.
    """
    slot = lambda c: F.floor(F.col(c) / bucket)
    spread = intervals.select(key, start, end, interval_id, F.explode(F.sequence(slot(start), slot(end))).alias("_slot"))
    met = points.select(key, at, point_id, slot(at).alias("_slot")).join(spread, [key, "_slot"]).where((F.col(start) <= F.col(at)) & (F.col(at) <= F.col(end)))
    best = met.groupBy(point_id).agg(F.min_by(interval_id, F.struct(F.col(end) - F.col(start), F.col(interval_id))).alias(interval_id))
    return points.select(point_id).join(best, point_id, "left")


def parents_by_level(rows: DataFrame, group: str, order: str, level: str, row_id: str) -> DataFrame:
    """rows with parent: the nearest earlier row of a lower level, however many levels there are; a row without a level has none and is nobody's.

    One sweep over each group in order with a stack of open levels, which is all that a task holds.
    """
    kinds = pa.schema([("parent", to_arrow_type(rows.schema[row_id].dataType))])
    at = [rows.columns.index(c) for c in (group, level, row_id)]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stack = object(), []
        for batch in batches:
            out = []
            for key, depth, name in zip(*(batch.column(k).to_pylist() for k in at), strict=True):
                if key != now:
                    now, stack = key, []
                while stack and depth is not None and stack[-1][0] >= depth:
                    stack.pop()
                out.append(stack[-1][1] if stack and depth is not None else None)
                if depth is not None:
                    stack.append((depth, name))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kinds.types[0])], names=[*batch.schema.names, "parent"])

    schema = StructType([*rows.schema.fields, StructField("parent", rows.schema[row_id].dataType)])
    return rows.repartition(group).sortWithinPartitions(group, order).mapInArrow(sweep, schema)


def merged_order(main: DataFrame, extra: DataFrame, group: str, key: str, order: str) -> DataFrame:
    """main and the rows of extra whose key it lacks, each behind the nearest row before it (in extra's order) that main has: rows with at, side, place."""
    known = main.select(group, key, F.col(order).alias("_at"))
    placed = extra.join(known, [group, key], "left")
    carry = F.last("_at", ignorenulls=True).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    new = placed.withColumn("at", F.coalesce(carry, F.lit(-1))).where("_at IS NULL").select(group, key, "at", F.lit(1).alias("side"), F.col(order).alias("place"))
    return main.select(group, key, F.col(order).alias("at"), F.lit(0).alias("side"), F.col(order).alias("place")).unionByName(new)
