"""Incremental sync as micro-batches: skip what is unchanged, keep the latest, ignore repeated pulses, plan updates.

State tables are Parquet in versions; a batch writes the next version and the caller reads the newest. A batch that is
run again after a failure finds its version there and writes it anew, so the outcome is that of running it once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The last row of each key."""
    columns = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*columns), order).alias("_row")).select(*key, "_row.*").select(*rows.columns)


def unchanged_skipped(batch: DataFrame, state: DataFrame, key: list[str], digest: str) -> DataFrame:
    """Rows of batch whose digest differs from the one that state has for their key."""
    return batch.join(state.select(*key, digest).distinct(), [*key, digest], "left_anti")


def update_plan(local: DataFrame, remote: DataFrame, key: str, rev: str) -> DataFrame:
    """(key, action): skip what is equal, record what has no revision here, update what moved; of local rows without a counterpart none."""
    r = remote.select(key, F.col(rev).alias("_remote"))
    action = F.when(F.col(rev).isNull(), "record").when(F.col(rev) == F.col("_remote"), "skip").otherwise("update")
    return local.select(key, rev).join(r, key).select(key, action.alias("action"))


def version(path: str, batch_id: int) -> str:
    return f"{path}/v={batch_id}"


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, key: list[str], order: Callable[[], Column]):
    """Keeps the latest row of each key of a stream in versions under path; returns the running query (all that is available, then it stops)."""

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if batch_id:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(version(path, batch_id - 1)))
        latest(rows, key, order()).write.mode("overwrite").parquet(version(path, batch_id))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_pulses(stream: DataFrame, at: str, key: str, late: str = "1 hour") -> DataFrame:
    """A stream with each (key, time) once; state older than the watermark is dropped."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key, at])
