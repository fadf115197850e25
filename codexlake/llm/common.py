"""What the corpus operators share: table reading, shared folders, Arrow plumbing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A word, as most contracts here have it: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A table for bytes.translate: A-Z to a-z.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; also Spark's checkpoint folder from then on.

    The cluster names it in spark.checkpoint.dir. A local folder is made only where that is unset, as in tests.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(base)
    return base


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: later steps read it, whichever executors are lost."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, taken: list[str]) -> str:
    """A column name that none of taken equals, whatever its case."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def give_back() -> None:
    """Returns freed memory to the system, so that an idle worker holds none of the last task's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def texts_in(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 22) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches, with their texts as a list; a slice has about `most` bytes of text, or one row."""
    for batch in batches:
        at, n = 0, batch.num_rows
        while at < n:
            step = n - at
            while step > 1 and batch.column(column).slice(at, step).get_total_buffer_size() and _bytes(batch.column(column), at, step) > most:
                step = max(1, step // 2)
            part = batch.slice(at, step)
            yield part, part.column(column).to_pylist()
            at += step
        del batch
    give_back()


def _bytes(array: pa.Array, at: int, n: int) -> int:
    part = array.slice(at, n)
    return part.nbytes
