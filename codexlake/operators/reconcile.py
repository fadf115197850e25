"""Reconciliation: tiered matching, keyed and bag comparison, newest-wins merging, tombstones, presence, patches.

Plain Parquet has no transactions, so each function returns the new state of a table; writing it elsewhere and swapping
is the caller's part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tiered_match(left: DataFrame, right: DataFrame, tiers: Sequence[tuple[Column, Column]], left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id, tier): the match of the first tier that has one, least right id first; a row for each left id.

    Each tier is brought to one row per key before its join, so a common key does not multiply rows.
    """
    out = left
    for k, (a, b) in enumerate(tiers, 1):
        keys = right.select(b.alias(f"_k{k}"), F.col(right_id)).where(F.col(f"_k{k}").isNotNull()).groupBy(f"_k{k}").agg(F.min(right_id).alias(f"_r{k}"))
        out = out.withColumn("_key", a).join(keys, F.col("_key") == F.col(f"_k{k}"), "left").drop("_key", f"_k{k}")
    hits = [F.col(f"_r{k}") for k in range(1, len(tiers) + 1)]
    tier = F.coalesce(*(F.when(h.isNotNull(), k) for k, h in enumerate(hits, 1)))
    return out.select(left_id, F.coalesce(*hits).alias(right_id), tier.alias("tier"))


def keyed_diff(a: DataFrame, b: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """key and outcome (added, dropped, identical, changed) of a full comparison; value is compared null-safely."""
    x = a.select(*key, F.lit(1).alias("_a"), F.col(value).alias("_av"))
    y = b.select(*key, F.lit(1).alias("_b"), F.col(value).alias("_bv"))
    outcome = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "dropped").when(F.col("_av").eqNullSafe(F.col("_bv")), "identical").otherwise("changed")
    return x.join(y, list(key), "full").select(*key, outcome.alias("outcome"))


def bag_diff(a: DataFrame, b: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, outcome, n): rows under a key are paired by their order; keys of one side are added or dropped, unpaired rows of a shared key are changed."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    x, y = (d.select(key, F.col(value).alias(v), place.alias("at"), F.lit(1).alias(m)) for d, v, m in ((a, "_av", "_a"), (b, "_bv", "_b")))
    paired = x.join(y, [key, "at"], "full")
    sides = paired.groupBy(key).agg(F.max("_a").alias("_has_a"), F.max("_b").alias("_has_b"), F.count_if(F.col("_av").eqNullSafe(F.col("_bv")) & F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("identical"), F.count("*").alias("n"))
    kind = F.when(F.col("_has_a").isNull(), "added").when(F.col("_has_b").isNull(), "dropped")
    rows = F.when(kind.isNotNull(), F.array(F.struct(kind.alias("outcome"), F.col("n").alias("n")))).otherwise(F.array(F.struct(F.lit("identical").alias("outcome"), F.col("identical").alias("n")), F.struct(F.lit("changed").alias("outcome"), (F.col("n") - F.col("identical")).alias("n"))))
    return sides.select(key, F.inline(rows)).where("n > 0")


def multiset_diff(a: DataFrame, b: DataFrame, item: str, count: str | None = None) -> DataFrame:
    """(item, n_a, n_b, lost, gained) of two bags of items; count: a column with how often a row's item occurs, if rows are sums already."""
    n = F.col(count) if count else F.lit(1)
    side = lambda d, own: d.select(item, (n * own).alias("_a"), (n * (1 - own)).alias("_b"))
    both = side(a, 1).unionByName(side(b, 0)).groupBy(item).agg(F.sum("_a").alias("n_a"), F.sum("_b").alias("n_b"))  # one grouping; nulls meet
    return bag_losses(both)


def bag_losses(both: DataFrame) -> DataFrame:
    """Rows with n_a and n_b, and what the second bag lost and gained."""
    return both.select("*", F.greatest(F.col("n_a") - F.col("n_b"), F.lit(0)).alias("lost"), F.greatest(F.col("n_b") - F.col("n_a"), F.lit(0)).alias("gained"))


def preservation(total: Column, dropped: Column) -> Column:
    """Share kept; 1 where there was nothing."""
    return F.when(total == 0, F.lit(1.0)).otherwise((total - dropped) / total)


def newest_wins(ours: DataFrame, theirs: DataFrame, key: str, stamp: str) -> DataFrame:
    """One row for each key, the later stamp's; on a tie ours stays. Both tables have the same columns.

    A grouped max_by: no join, and partial on the map side.
    """
    rank = lambda d, own: d.withColumn("_own", F.lit(own))
    columns = [c for c in ours.columns if c != key]
    row = F.max_by(F.struct(*columns), F.struct(F.col(stamp), F.col("_own")))
    return rank(ours, 1).unionByName(rank(theirs, 0)).groupBy(key).agg(row.alias("_row")).select(key, "_row.*").select(*ours.columns)


def insert_ignore(table: DataFrame, rows: DataFrame, key: Sequence[str], order: str | None = None) -> DataFrame:
    """rows whose key is not in table, one for each key: what an insert that ignores conflicts appends."""
    new = rows.join(table.select(*key).distinct(), list(key), "left_anti")
    if order is None:
        return new.dropDuplicates(list(key))
    columns = [c for c in rows.columns if c not in key]
    return new.groupBy(*key).agg(F.min_by(F.struct(*columns), F.col(order)).alias("_row")).select(*key, "_row.*").select(*rows.columns)


def delta_over_base(base: DataFrame, delta: DataFrame, key: str, deleted: str = "deleted") -> DataFrame:
    """base with rows replaced or added by delta; rows that delta marks as deleted go."""
    columns = [c for c in base.columns if c != key]
    d = delta.select(key, F.lit(True).alias("_has"), F.col(deleted).alias("_gone"), F.struct(*columns).alias("_new"))
    out = base.select(key, F.struct(*columns).alias("_old")).join(d, key, "full").where(~F.coalesce("_gone", F.lit(False)))
    return out.select(key, F.when(F.col("_has"), F.col("_new")).otherwise(F.col("_old")).alias("_row")).select(key, "_row.*").select(*base.columns)


def without_tombstones(rows: DataFrame, tombstones: DataFrame, key: Sequence[str]) -> DataFrame:
    return rows.join(tombstones.select(*key).distinct(), list(key), "left_anti")


def refresh_presence(presence: DataFrame, seen: DataFrame, scope: Sequence[str]) -> DataFrame:
    """The rows of seen replace all rows of the scopes that seen speaks of."""
    return presence.join(seen.select(*scope).distinct(), list(scope), "left_anti").unionByName(seen)


def patch(rows: DataFrame, changes: DataFrame, key: str, clear: bool = False) -> DataFrame:
    """rows with values from changes by key. Nulls in changes keep a value, or with clear take it away."""
    columns = [c for c in changes.columns if c != key]
    new = changes.select(key, F.lit(True).alias("_has"), *(F.col(c).alias(f"_new_{c}") for c in columns))
    out = rows.join(new, key, "left")
    for c in columns:
        out = out.withColumn(c, F.when(F.col("_has"), F.col(f"_new_{c}")).otherwise(F.col(c)) if clear else F.coalesce(f"_new_{c}", c))
    return out.select(*rows.columns)


def edit_tags(tags: Column, add: Column, remove: Column) -> Column:
    """tags and add, without remove, in first-seen order."""
    return F.array_except(F.array_union(tags, add), remove)


def first_owner(rows: DataFrame, key: str, order: Sequence[Column], name: str) -> DataFrame:
    """rows with owner (the name of the first row of their key) and kept (whether that is they), so that all others are told as conflicts with it; a null key has no owner."""
    w = Window.partitionBy(key).orderBy(*order)
    known = F.col(key).isNotNull()
    return rows.withColumn("owner", F.when(known, F.first(name).over(w))).withColumn("kept", ~known | (F.row_number().over(w) == 1))


def conflicts(owned: DataFrame, key: str, name: str) -> DataFrame:
    """(key, owner, name): a row for each row of first_owner() that another one came before."""
    return owned.where("NOT kept").select(key, "owner", name)
