"""Progress values told only when they have moved: as a stream with state, and as a fold over a batch that gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, StructField, StructType

#: What a value must have gained over the last one told, the value that is always told, the one before the first.
STEP, WHOLE, BEFORE = 0.01, 1.0, -1.0


def worth(value: float | None, told: float) -> bool:
    """Whether a value is told after `told`; a null or NaN never is."""
    return value is not None and value == value and (value >= WHOLE or value >= told + STEP)


class Told(StatefulProcessor):
    """The last value told of each key; of a micro-batch the rows of a key are taken in order."""

    def __init__(self, value: str, order: list[str], columns: list[str]):
        self.value, self.order, self.columns = value, order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("told", StructType([StructField("value", DoubleType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        frame = pd.concat(rows).sort_values(self.order, kind="stable")
        told = self.state.get()[0] if self.state.exists() else BEFORE
        keep = []
        for v in frame[self.value].tolist():
            keep.append(worth(v, told))
            told = v if keep[-1] else told
        self.state.update((told,))
        yield frame[keep][self.columns]

    def close(self) -> None:
        pass


def throttled_stream(stream: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The rows of a stream whose value is worth telling, per key. Needs a state store with column families (RocksDB)."""
    return stream.groupBy(key).transformWithStateInPandas(statefulProcessor=Told(value, order, stream.columns), outputStructType=stream.schema, outputMode="append", timeMode="none")


def throttled(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The same of a table: one sweep over each key in order, which holds the last value told. Ties in order keep any order."""
    at = [rows.columns.index(c) for c in (key, value)]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, told = object(), BEFORE
        for batch in batches:
            keep = []
            for i, (name, v) in enumerate(zip(*(batch.column(k).to_pylist() for k in at), strict=True)):
                if name != now:
                    now, told = name, BEFORE
                if worth(v, told):
                    keep.append(i)
                    told = v
            yield batch.take(pa.array(keep, pa.int64()))

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(sweep, rows.schema)
