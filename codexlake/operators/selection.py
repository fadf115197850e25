"""Catalogue selection: conjunctive predicates, facets with leave-one-out counts, sorting, first-seen grouping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexlake.functions.text import fold, natural_key, search_key

NONE_LABEL = "—"


def any_prefix(c: Column, prefixes: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (c.startswith(p) for p in prefixes), F.lit(False))


def contains_fold(c: Column, text: str) -> Column:
    return F.contains(F.lower(c), F.lit(text.lower()))


@dataclass
class Selection:
    """Predicates that all must hold; those not set are left out. Nothing set is an error, as is an unknown id."""

    ids: Sequence[int] = ()
    prefixes: Sequence[str] = ()
    contains: Mapping[str, str] = field(default_factory=dict)
    equals: Mapping[str, object] = field(default_factory=dict)
    either: Mapping[tuple[str, str], object] = field(default_factory=dict)
    tags: Sequence[str] = ()
    has: Sequence[str] = ()
    missing: Sequence[str] = ()
    limit: int | None = None
    id_col: str = "id"
    hash_col: str = "sha256"
    tags_col: str = "tags"

    def predicates(self) -> list[Column]:
        out = []
        if self.ids:
            out.append(F.col(self.id_col).isin(*self.ids))
        if self.prefixes:
            out.append(any_prefix(F.col(self.hash_col), self.prefixes))
        out += [contains_fold(F.col(c), t) for c, t in self.contains.items()]
        out += [F.col(c) == v for c, v in self.equals.items()]
        out += [(F.col(a) == v) | (F.col(b) == v) for (a, b), v in self.either.items()]
        out += [F.array_contains(self.tags_col, t) for t in self.tags]
        out += [F.col(c).isNotNull() for c in self.has] + [F.col(c).isNull() for c in self.missing]
        return out

    def apply(self, books: DataFrame, order: Sequence[Column] = ()) -> DataFrame:
        found = self.predicates()
        if not found and self.limit is None:
            raise ValueError("a selection needs a predicate")
        if self.ids:
            known = {r[0] for r in books.where(F.col(self.id_col).isin(*self.ids)).select(self.id_col).distinct().collect()}  # as many rows as ids asked for
            if gone := set(self.ids) - known:
                raise ValueError(f"no such id: {sorted(gone)}")
        out = reduce(DataFrame.where, found, books)
        return out.orderBy(*order).limit(self.limit) if self.limit is not None else out.orderBy(*order) if order else out


def facet_values(c: Column, many: bool = False) -> Column:
    """The labels of a row under a facet: trimmed, distinct, a dash where there is none."""
    values = c if many else F.array(c)
    labels = F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))
    return F.when(labels.isNull() | (F.size(labels) == 0), F.array(F.lit(NONE_LABEL))).otherwise(labels)


def facet_match(facets: Mapping[str, Column], chosen: Mapping[str, Sequence[str]], skip: str | None = None) -> Column:
    """All facets with a choice, but for skip, have one of the chosen labels."""
    out = F.lit(True)
    for name, labels in chosen.items():
        if labels and name != skip:
            out = out & F.arrays_overlap(facets[name], F.array(*map(F.lit, labels)))
    return out


def facet_counts(books: DataFrame, facets: Mapping[str, Column], chosen: Mapping[str, Sequence[str]]) -> DataFrame:
    """(facet, label, n): rows under each label of each facet among those that match all other facets; chosen labels stay, at 0 too.

    One pass for all facets: a row gives its labels of each facet under which it counts.
    """
    def labelled(name: str):
        return lambda x: F.struct(F.lit(name).alias("facet"), x.alias("label"), F.lit(1).alias("n"))

    per = [F.when(facet_match(facets, chosen, skip=name), F.transform(values, labelled(name))) for name, values in facets.items()]
    counted = books.select(F.inline(F.flatten(F.array_compact(F.array(*per)))))
    kept = [(n, x, 0) for n, labels in chosen.items() for x in labels]
    if kept:
        counted = counted.unionByName(books.sparkSession.createDataFrame(kept, "facet string, label string, n int"))
    return counted.groupBy("facet", "label").agg(F.sum("n").alias("n"))


def facet_order(c: Column) -> list[Column]:
    """Natural order, the dash last."""
    return [(c == NONE_LABEL).asc(), natural_key(c).asc()]


def missing_last(c: Column, descending: bool = False) -> Column:
    return c.desc_nulls_last() if descending else c.asc_nulls_last()


def series_key(name: Column, index: Column) -> Column:
    """Series name and ten times the index, padded; without an index all nines."""
    at = F.when(index.isNull() | F.isnan(index), F.lit("99999999")).otherwise(F.lpad(F.round(index * 10).cast("long").cast("string"), 8, "0"))
    return F.concat(name, F.lit(" "), at)


def first_seen(rows: DataFrame, group: str, order: str) -> DataFrame:
    """rows with group_at, the place of the first row of their group; rows without a group stand alone."""
    return rows.withColumn("group_at", F.when(F.col(group).isNull(), F.col(order)).otherwise(F.min(order).over(Window.partitionBy(group))))


def leads(rows: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    """The first row of each group."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("_rank = 1").drop("_rank")


def matches(asked: str, fields: Sequence[Column], key: Column | None = None) -> Column:
    """Whether rows answer a search: their folded key holds the folded question, or their fields as they are, in lower case, hold it as it is; nothing asked finds all."""
    if not asked.strip():
        return F.lit(True)
    folded = search_key(*fields) if key is None else F.when(F.coalesce(key, F.lit("")) == "", fold(F.concat_ws(" ", *fields))).otherwise(key)
    in_key = folded.contains(fold(F.lit(asked))) & (fold(F.lit(asked)) != "")
    return in_key | F.lower(F.concat_ws(" ", *fields)).contains(asked.strip().lower())


def shown(rows: DataFrame, hidden: str) -> DataFrame:
    """Rows that are not hidden; a null hides nothing."""
    return rows.where(~F.coalesce(F.col(hidden), F.lit(False)))


def filled(value: Column, new: Column) -> Column:
    """new where there is no value or an empty one."""
    return F.coalesce(F.nullif(value, F.lit("")), new)


def has_tag(tags: Column, tag: str) -> Column:
    """Tags are kept trimmed and in lower case."""
    return F.array_contains(tags, tag.strip().lower())


def duplicates(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, n) of keys that more than one row has."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def series_position(index: Column, title: Column) -> list[Column]:
    """Order in a series: numbered rows first, by number, then by title in natural order."""
    return [index.isNull().asc(), index.asc_nulls_last(), natural_key(title).asc()]


def ranked_counts(rows: DataFrame, name: str) -> DataFrame:
    """(name, n, place): names by how often they occur, most first, names in order among equals. The ranking holds a row for each name."""
    n = rows.groupBy(name).agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), name)).cast("long"))
