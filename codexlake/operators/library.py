"""Whole libraries: merging another one in, and device batches; each is one composed plan over tables.

A library is a dict of DataFrames:

    books        sha, updated_at, and metadata columns, amazon_asin among them if there are such ids
    annotations  dedup_hash, sha, and more
    notebooks    uuid, and more
    deletions    kind ('annotation' or 'notebook'), key
    positions    sha, source, device, at, moved_at

Plain Parquet has no transactions: the functions return the new tables, and writing and swapping them is the caller's
part. Every step is an equality join or a grouping by a key of many values; no key gathers a library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Library = dict[str, DataFrame]


def merged_books(ours: DataFrame, theirs: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """Books with outcome: added, updated (theirs is later; `kept` columns stay ours, an empty amazon_asin is filled) or kept."""
    columns = [c for c in ours.columns if c != "sha"]
    a = ours.select("sha", F.struct(*columns).alias("_a"))
    b = theirs.select("sha", F.struct(*columns).alias("_b"))
    both = a.join(b, "sha", "full")
    later = F.col("_b.updated_at") > F.col("_a.updated_at")
    outcome = F.when(F.col("_a").isNull(), "added").when(F.coalesce(later, F.lit(False)), "updated").otherwise("kept")

    def value(c: str):
        mine, other = F.col(f"_a.{c}"), F.col(f"_b.{c}")
        if c == "amazon_asin":
            mixed = F.coalesce(F.nullif(mine, F.lit("")), F.nullif(other, F.lit("")))
            return F.when(F.col("outcome") == "added", other).when(F.col("outcome") == "updated", mixed).otherwise(mine)
        takes = ["added"] if c in kept else ["added", "updated"]
        return F.when(F.col("outcome").isin(*takes), other).otherwise(mine)

    return both.withColumn("outcome", outcome).select("sha", *(value(c).alias(c) for c in columns), "outcome")


def added(ours: DataFrame, theirs: DataFrame, key: str, deletions: DataFrame, kind: str) -> DataFrame:
    """Rows of theirs, one for each key, that ours has not and has not deleted."""
    gone = deletions.where(F.col("kind") == kind).select(F.col("key").alias(key))
    new = theirs.join(gone, key, "left_anti").join(ours.select(key), key, "left_anti")
    return new.dropDuplicates([key])


def latest_positions(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """One position for each (sha, source, device): the later one, ours on a tie."""
    both = ours.withColumn("_own", F.lit(1)).unionByName(theirs.withColumn("_own", F.lit(0)))
    return both.groupBy("sha", "source", "device").agg(F.max_by(F.struct("at", "moved_at"), F.struct("moved_at", "_own")).alias("_row")).select("sha", "source", "device", "_row.*")


def merge(ours: Library, theirs: Library, kept: tuple[str, ...] = ()) -> tuple[Library, DataFrame]:
    """The merged library and its counters (what, n)."""
    books = merged_books(ours["books"], theirs["books"], kept)
    notes = added(ours["annotations"], theirs["annotations"], "dedup_hash", ours["deletions"], "annotation")
    # an annotation comes only with its book; all of theirs are in the merged books
    notes = notes.join(theirs["books"].select("sha"), "sha", "left_semi")
    books_of = added(ours["notebooks"], theirs["notebooks"], "uuid", ours["deletions"], "notebook")
    out = {
        "books": books.drop("outcome"), "annotations": ours["annotations"].unionByName(notes), "notebooks": ours["notebooks"].unionByName(books_of),
        "deletions": ours["deletions"], "positions": latest_positions(ours["positions"], theirs["positions"]),
    }
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    counters = books.where("outcome <> 'kept'").groupBy(F.concat(F.lit("books_"), "outcome").alias("what")).agg(F.count("*").alias("n"))
    return out, counters.unionByName(count(notes, "annotations_added")).unionByName(count(books_of, "notebooks_added"))


def sync_batch(state: Library, batch: DataFrame, device: str) -> tuple[Library, DataFrame]:
    """A device's batch (stem, payload_sha, position, moved_at, notes array<struct<hash, body>>) into a library.

    state: books (sha8, sha), positions, checkpoints (sha, device, payload_sha), annotations (dedup_hash, sha, body) with
    unmatched ones under a null sha and their stem. Steps: match by the stem's hash; positions of all matched books;
    payloads that equal their checkpoint are passed over; new annotations are inserted; older orphans of now known books
    find them. Returns the new state and the report of each entry (stem, status, inserted, duplicate).
    """
    known = state["books"].select("sha8", "sha").groupBy("sha8").agg(F.min("sha").alias("sha"))
    entries = batch.withColumn("sha8", F.substring_index("stem", "_", -1)).join(known, "sha8", "left")
    mine = state["checkpoints"].where(F.col("device") == device).select("sha", F.col("payload_sha").alias("_last"))
    entries = entries.join(mine, "sha", "left")
    status = F.when(F.col("sha").isNull(), "unmatched").when(F.col("payload_sha").eqNullSafe(F.col("_last")), "unchanged").otherwise("imported")
    entries = entries.withColumn("status", status)
    moved = entries.where("sha IS NOT NULL AND position IS NOT NULL").select("sha", F.lit("device").alias("source"), F.lit(device).alias("device"), F.col("position").alias("at"), "moved_at")
    notes = entries.where("status <> 'unchanged'").select("stem", "sha8", "sha", F.inline("notes").alias("dedup_hash", "body"))
    held = state["annotations"].select("dedup_hash").distinct().withColumn("_held", F.lit(True))
    met = notes.join(held, "dedup_hash", "left")
    first = met.where("_held IS NULL").groupBy("dedup_hash").agg(F.min(F.struct("stem", "sha", "body")).alias("_r")).select("dedup_hash", "_r.sha", "_r.body", F.when(F.col("_r.sha").isNull(), F.col("_r.stem")).alias("stem"))
    # those that lost to an equal hash in this batch count as duplicates too
    per = notes.groupBy("stem").agg(F.count("*").alias("_n")).join(met.where("_held IS NULL").groupBy("dedup_hash").agg(F.min("stem").alias("stem")).groupBy("stem").agg(F.count("*").alias("_new")), "stem", "left")
    report = entries.join(per, "stem", "left").select("stem", "status", F.coalesce("_new", F.lit(0)).alias("inserted"), (F.coalesce("_n", F.lit(0)) - F.coalesce("_new", F.lit(0))).alias("duplicate"))
    every = state["annotations"].unionByName(first)
    late = every.where("sha IS NULL").withColumn("sha8", F.substring_index("stem", "_", -1)).drop("sha").join(known, "sha8", "left")
    linked = late.select("dedup_hash", "sha", "body", F.when(F.col("sha").isNull(), F.col("stem")).alias("stem"))
    seen = entries.where("status = 'imported'").groupBy("sha").agg(F.max("payload_sha").alias("payload_sha")).select("sha", F.lit(device).alias("device"), "payload_sha")
    checkpoints = state["checkpoints"].join(seen.select("sha", "device"), ["sha", "device"], "left_anti").unionByName(seen)
    out = {"books": state["books"], "positions": latest_positions(state["positions"], moved), "annotations": every.where("sha IS NOT NULL").unionByName(linked), "checkpoints": checkpoints}
    return out, report


def copies_due(wanted: DataFrame, there: DataFrame, key: str, policy: str) -> DataFrame:
    """wanted with action: a file under the policy `always` is written again, under `once` only where it is not there."""
    held = there.select(key).distinct().withColumn("_there", F.lit(True))
    out = wanted.join(held, key, "left")
    action = F.when(F.col("_there").isNull(), "copy").when(F.col(policy) == "always", "overwrite").otherwise("skip")
    return out.withColumn("action", action).drop("_there")


def migrated(rows: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """rows with columns that later versions have (name -> type, SQL that fills it); those that are there stay, their nulls are filled."""
    for name, (kind, value) in columns.items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.expr(value)).cast(kind) if name in rows.columns else F.expr(value).cast(kind))
    return rows


def class_tally(outcomes: DataFrame, path: str, classes: dict[str, str]) -> DataFrame:
    """(kind, n) of what is not identical, by the kind that a path's ending tells."""
    kind = F.lit("other")
    for pattern, name in reversed(classes.items()):
        kind = F.when(F.col(path).rlike(pattern), name).otherwise(kind)
    return outcomes.where("outcome <> 'identical'").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
