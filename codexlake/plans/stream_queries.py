"""Micro-batch queries over events: what a stream keeps, held against the batch result."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexlake.plans.registry import query, read
from codexlake.streaming import sync
from codexlake.streaming import throttle as th


def _folder(spark: SparkSession) -> str:
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="spark-stream-")
    import uuid

    return f"{base}/stream-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query("SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def stream_latest_position(spark, sf_dir):
    at = _folder(spark)
    rows = _stream(spark, sf_dir).select("user_id", "ts", "event_id", "value")
    running = sync.upsert_stream(rows, f"{at}/state", f"{at}/checkpoint", ["user_id"], lambda: F.struct("ts", "event_id"))
    running.awaitTermination()
    batches = (running.lastProgress or {}).get("batchId", 0)
    return spark.read.schema(rows.schema).parquet(sync.version(f"{at}/state", batches))


@query("SELECT event_id, user_id FROM events e WHERE event_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM events s WHERE s.event_id % 2 = 0 AND s.user_id = e.user_id AND s.props = e.props)")
def stream_checkpoint_skip(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("digest", F.sha2(F.col("props").cast("binary"), 256))
    return sync.unchanged_skipped(e.where("event_id % 2 = 1"), e.where("event_id % 2 = 0"), ["user_id"], "digest").select("event_id", "user_id")


@query("""
WITH l AS (SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 3 END AS rev FROM customer WHERE c_custkey % 5 > 0), r AS (SELECT c_custkey, c_custkey % 2 AS rev FROM customer)
SELECT l.c_custkey, CASE WHEN l.rev IS NULL THEN 'record' WHEN l.rev = r.rev THEN 'skip' ELSE 'update' END AS action FROM l JOIN r ON l.c_custkey = r.c_custkey
""")
def stream_update_plan(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey")
    local = c.where("c_custkey % 5 > 0").withColumn("rev", F.when(F.col("c_custkey") % 4 > 0, F.col("c_custkey") % 3))
    return sync.update_plan(local, c.withColumn("rev", F.col("c_custkey") % 2), "c_custkey", "rev")


@query("SELECT DISTINCT user_id, date_trunc('minute', ts) AS at FROM events WHERE event_type = 'click'")
def pulse_dedup(spark, sf_dir):
    at = _folder(spark)
    rows = _stream(spark, sf_dir).where("event_type = 'click'").select("user_id", F.date_trunc("minute", "ts").alias("at"))
    running = sync.distinct_pulses(rows, "at", "user_id").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{at}/out")


#: What a user's progress says when it is told only after a hundredth more than last time.
TOLD = """
WITH RECURSIVE e AS (SELECT user_id, event_id, value / 1000 AS fraction, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
w AS (SELECT user_id, event_id, fraction, rn, fraction >= 1 OR fraction >= -0.99 AS told, CASE WHEN fraction >= 1 OR fraction >= -0.99 THEN fraction ELSE -1.0 END AS last FROM e WHERE rn = 1
UNION ALL SELECT e.user_id, e.event_id, e.fraction, e.rn, e.fraction >= 1 OR e.fraction >= w.last + 0.01, CASE WHEN e.fraction >= 1 OR e.fraction >= w.last + 0.01 THEN e.fraction ELSE w.last END FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1)
SELECT user_id, event_id, fraction FROM w WHERE told
"""


def _fractions(events: DataFrame) -> DataFrame:
    return events.select("user_id", "ts", "event_id", (F.col("value") / 1000).alias("fraction"))


@query(TOLD)
def progress_told(spark, sf_dir):
    """The batch's fold."""
    return th.throttled(_fractions(read(spark, sf_dir, "events")), "user_id", "fraction", ["ts", "event_id"]).select("user_id", "event_id", "fraction")


@query(TOLD)
def stream_progress_told(spark, sf_dir):
    """The same as a stream, with the last value told of each user as state."""
    at, name = _folder(spark), "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = th.throttled_stream(_fractions(_stream(spark, sf_dir)), "user_id", "fraction", ["ts", "event_id"])
        running = rows.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
        running.awaitTermination()
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)
    return spark.read.schema(rows.schema).parquet(f"{at}/out").select("user_id", "event_id", "fraction")
