"""Embedding near-dedup: rotations learned by iterative quantisation, multi-index Hamming tables, rerank by cosine.

Unit vectors of a bounded sample are centred and turned onto their principal axes; alternating between sign codes and the
rotation that fits them best (a Procrustes problem) gives balanced bits. Bits of several rotations are dealt to tables.
Two vectors at the threshold's angle agree on a bit with probability 1 - angle / pi, hence on a table's whole block of
b bits with that to the power of b; there are as many tables as leave a miss of at most `MISS` at the threshold, less for
nearer pairs. The block length follows the count of vectors, so a bucket has about `BUCKET` rows by chance.
All that share a bucket are compared by the cosine of their original vectors, in tasks, by blocks of a matrix product;
a pair counts in the first table in which it meets. A task hands on counts and a spanning forest, never pairs.

Scale: equal vectors are one row from the first grouping on. A bucket of more than PART rows is cut into parts, and each
pair of parts is a task's work of its own, so memory is bounded whatever the bucket; a large group of vectors that are
near but all different costs the square of its size in comparisons, spread over those tasks. Vectors are exchanged once
for each table in which they share a bucket. The sample alone reaches the driver.

Defined cases: vectors that are null, empty, zero or hold null, NaN or infinite components link with nothing and are
their own component; vectors of different lengths do not link, and each length has its own fit; a negative zero equals
zero; repeated rows and vectors that differ by a factor link (cosine 1); a null vec_id names a component only where no
other is there, and is kept false; an empty table gives no rows; further columns are left aside.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexlake.llm.common import give_back, written
from codexlake.llm.components import components
from codexlake.llm.simhash import Forest

COSINE, MISS, BUCKET, PART = 0.9, 0.02, 256, 2048
SAMPLE_ROWS, SAMPLE_NUMBERS, ROUNDS, MOST_BITS = 20_000, 1 << 21, 50, 64
LEAST_BLOCK, BLOCK_ROWS = 4, 256


def unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    m = m / np.abs(m).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def rotation(v: np.ndarray, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """The rotation of centred rows v that iterative quantisation ends with, from a random one."""
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(v.shape[1], v.shape[1])))[0]
    for _ in range(rounds):
        signs = np.where(v @ r >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(v.T @ signs)
        r = left @ right
    return r


class Tables:
    """Blocks of sign bits for the vectors of one length."""

    def __init__(self, sample: np.ndarray, vectors: int, cosine: float = COSINE, miss: float = MISS, bucket: int = BUCKET):
        self.d = sample.shape[1]
        self.block = max(LEAST_BLOCK, math.ceil(math.log2(max(1, vectors / bucket))))
        agree = (1 - math.acos(cosine) / math.pi) ** self.block
        self.n = math.ceil(math.log(miss) / math.log(1 - agree))
        x = unit(sample)
        self.mean = x.mean(axis=0)
        axes = np.linalg.eigh(np.cov((x - self.mean).T, bias=True).reshape(self.d, self.d))[1][:, ::-1][:, :MOST_BITS]
        v, need = (x - self.mean) @ axes, self.n * self.block
        planes = np.concatenate([axes @ rotation(v, k) for k in range(-(-need // axes.shape[1]))], axis=1)
        self.planes = planes[:, np.random.default_rng(0).permutation(planes.shape[1])[:need]]

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """One number for each unit vector and table; the table and the length are part of it."""
        bits = ((x - self.mean) @ self.planes >= 0).reshape(len(x), self.n, self.block)
        return (bits @ (1 << np.arange(self.block, dtype=np.int64))) + ((np.arange(self.n) + (self.d << 12)) << 40)


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Lists of one length as rows."""
    ends = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].reshape(len(lists), -1)


def distinct_vectors(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((vec_id, k1, k2) of all rows, (rep, k1, k2, embedding, m, first) of each distinct vector that can link), written."""
    kind = vectors.schema["embedding"].dataType.elementType
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    sound = (F.size("embedding") > 0) & F.forall("embedding", finite) & F.exists("embedding", lambda c: c != 0)
    plain = F.when(sound, F.transform("embedding", lambda c: (c + F.lit(0).cast(kind)).cast(kind)))
    rows = vectors.select("vec_id", plain.alias("embedding"))
    named = rows.select("vec_id", "embedding", *(F.when(F.col("embedding").isNotNull(), F.xxhash64(F.lit(k), "embedding")).alias(f"k{k}") for k in (1, 2)))
    distinct = named.where("embedding IS NOT NULL").groupBy("embedding").agg(F.min("k1").alias("k1"), F.min("k2").alias("k2"), F.count("*").alias("m"), F.min("vec_id").alias("first"))
    return named.select("vec_id", "k1", "k2"), written(distinct.withColumn("rep", F.monotonically_increasing_id()), "distinct-vectors")


def fitted(distinct: DataFrame, **more) -> dict[int, Tables]:
    """Tables for each length, fitted on the vectors of the least hashes."""
    out = {}
    for r in distinct.groupBy(F.size("embedding").alias("d")).count().collect():
        rows = min(SAMPLE_ROWS, max(2, SAMPLE_NUMBERS // r.d))
        sample = distinct.where(F.size("embedding") == r.d).orderBy("k1", "k2").select("embedding").limit(rows).toArrow()
        out[r.d] = Tables(_matrix(sample.column(0).combine_chunks()), r["count"], **more)
    return out


def near(group: dict[str, np.ndarray], table: int, apart: bool, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(count of linked vectors, root position) of each row of a bucket: pairs that met in an earlier table count there.

    apart: only pairs between the rows of the two parts."""
    x, m, buckets, part = group["x"], group["m"], group["buckets"], group["part"]
    count, forest = np.zeros(len(x), np.int64), Forest(len(x))
    ahead, behind = (np.flatnonzero(part == part.min()), np.flatnonzero(part != part.min())) if apart else (np.arange(len(x)),) * 2
    for at in range(0, len(ahead), BLOCK_ROWS):
        some = ahead[at : at + BLOCK_ROWS]
        close = x[some] @ x[behind].T >= cosine
        if not apart:
            close[np.arange(len(some)), some] = False
        if not close.any():
            continue
        for t in range(table):
            close &= buckets[some, t][:, None] != buckets[behind, t][None, :]
        count[some] += close @ m[behind]
        if apart:
            count[behind] += m[some] @ close
        p, q = np.nonzero(close)
        forest.tie(some[p], behind[q])
    return count, forest.root


def met(distinct: DataFrame, tables: dict[int, Tables], cosine: float, part: int) -> DataFrame:
    """(rep, n, root): the linked vectors that a vector meets in one bucket, and a vector that it is tied to there."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(batch.column(1).offsets.to_numpy())
            for d in np.unique(size).tolist():
                own = batch.take(pa.array(np.flatnonzero(size == d)))
                found = tables[d].buckets(unit(_matrix(own.column(1))))
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(list(found), pa.list_(pa.int64()))], names=["rep", "buckets"])

    dealt = written(distinct.select("rep", "embedding").mapInArrow(deal, "rep bigint, buckets array<bigint>"), "buckets")
    each = dealt.select("rep", F.posexplode("buckets").alias("table", "bucket"))
    # a bucket of one row has nobody to meet
    sizes = written(each.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / part).cast("int").alias("parts")), "bucket-sizes")
    asked = written(each.join(sizes, "bucket"), "asked").groupBy("rep").agg(F.collect_list(F.struct("table", "bucket", "parts")).alias("asked"))  # a row for each table at most
    rows = distinct.select("rep", "embedding", "m").join(dealt, "rep").join(written(asked, "asked-of"), "rep").withColumn("asked", F.explode("asked"))
    own = F.pmod(F.xxhash64("rep"), F.col("asked.parts")).cast("int")
    rows = rows.select("rep", "m", "embedding", "buckets", "asked.*", own.alias("part")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select(F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other")).alias("work"), "bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "rep", "m", "table", "part", "embedding", "buckets")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(own: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(own).combine_chunks().to_batches()[0]
            key = np.stack([whole.column(k).to_numpy() for k in (1, 2, 3)])
            starts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])).tolist()
            got: list[tuple[np.ndarray, ...]] = []
            for a, b in zip(starts, [*starts[1:], len(whole)], strict=True):
                if b - a < 2:
                    continue
                some = whole.slice(a, b - a)
                rep = some.column(4).to_numpy()
                group = {"x": unit(_matrix(some.column(8))), "m": some.column(5).to_numpy(), "part": some.column(7).to_numpy(), "buckets": _matrix(some.column(9))}
                n, root = near(group, int(some.column(6)[0].as_py()), bool(key[1, a] != key[2, a]), cosine)
                at = np.flatnonzero(n)
                got.append((rep[at], n[at], rep[root[at]]))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*got, strict=True)], names=["rep", "n", "root"])

        for batch in batches:
            work = batch.column(0).to_numpy()
            if held and work[0] != held[-1].column(0)[-1].as_py():
                yield from out(held)
                held = []
            last = int(np.flatnonzero(np.concatenate([[True], work[1:] != work[:-1]]))[-1])
            if last:
                yield from out([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
        if held:
            yield from out(held)
        give_back()

    # sorted by a hash first, so that a work's rows lie together in one task
    return rows.repartition("work").sortWithinPartitions("work", "bucket", "i", "j").mapInArrow(scan, "rep bigint, n bigint, root bigint")


def links(vectors: DataFrame, *, cosine: float = COSINE, part: int = PART, **more) -> DataFrame:
    """(vec_id, n_links, component_id, kept): see the module."""
    named, distinct = distinct_vectors(vectors.select("vec_id", "embedding"))
    found = written(met(distinct, fitted(distinct, cosine=cosine, **more), cosine, part), "met")
    counted = written(found.groupBy("rep").agg(F.sum("n").alias("n")), "counted")
    roots = written(components(found.select(F.greatest("rep", "root").alias("a"), F.least("rep", "root").alias("b"))).withColumnRenamed("node", "rep"), "roots")
    firsts = distinct.select("rep", "k1", "k2", "m", "first")
    least = written(firsts.join(roots, "rep").groupBy("root").agg(F.min("first").alias("component_id")), "least")
    tied = written(roots.join(least, "root").select("rep", "component_id"), "tied")
    known = firsts.join(counted, "rep", "left").join(tied, "rep", "left").select("k1", "k2", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    out = named.join(written(known, "known"), ["k1", "k2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def digest(vectors: DataFrame) -> DataFrame:
    return links(vectors)
