"""Sharding by best-fit-decreasing bin packing.

Groups of equal texts are indivisible unless one alone outgrows a shard. Groups of at least 1/`fineness` of a shard are
items of their own; all smaller groups fall by hash into n_shards x fineness bundles, which are items too. So the
packing sees a number of items that the parameters bound, whatever the input (2 x n_shards x fineness and a few per
outsized group); largest first, each enters the open shard with the tightest remaining capacity, found in a treap.

Scale: texts are read once, into a slim table of ids, sizes and digests in the shared folder. The item tables have a
proven bound and are broadcast. Slots come from counts of cells of about `cell_rows` rows (items salted by doc_id), so
neither a hot group nor a shard is ever gathered in one task.

Defined cases: a null text has no bytes and is a group of its own; equal rows share size, checksum and shard and get
slots of their own; a text of any length is one row's size and digest, and one that outgrows a shard fills one; with
fewer groups than shards some shards stay empty; an empty table gives no rows; further columns, whatever their names,
are left aside.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codexlake.llm.common import written

N_SHARDS, FINENESS, CELL_ROWS, ROW_BYTES = 24, 512, 2000, 8


class Treap:
    """A balanced tree of (remaining capacity, bin): insert, remove, and the smallest entry that is at least a key."""

    def __init__(self):
        self.root, self.rand = None, random.Random(0).random

    def _split(self, t, key):  # entries below key, the others
        if t is None:
            return None, None
        if t[0] < key:
            a, b = self._split(t[3], key)
            return (t[0], t[1], t[2], a), b
        a, b = self._split(t[2], key)
        return a, (t[0], t[1], b, t[3])

    def _join(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            return (a[0], a[1], a[2], self._join(a[3], b))
        return (b[0], b[1], self._join(a, b[2]), b[3])

    def insert(self, key):
        a, b = self._split(self.root, key)
        self.root = self._join(self._join(a, (key, self.rand(), None, None)), b)

    def pop_tightest(self, size):
        """Removes and returns the entry with the least capacity of size or more."""
        a, b = self._split(self.root, (size, -1))
        if b is None:
            return None
        t = b
        while t[2] is not None:
            t = t[2]
        _, rest = self._split(b, (t[0][0], t[0][1] + 1))
        self.root = self._join(a, rest)
        return t[0]


def best_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """The bin of each item and the number of bins. An item above capacity gets a bin of its own."""
    tree, bins, n = Treap(), [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        got = tree.pop_tightest(sizes[i])
        if got is None:
            got, n = (max(capacity, sizes[i]), n), n + 1
        bins[i] = got[1]
        tree.insert((got[0] - sizes[i], got[1]))
    return bins, n


def pack_evenly(sizes: list[int], n_bins: int) -> list[int]:
    """Bins below n_bins of near-equal sums: the least capacity, to a two-thousandth, at which the packing fits."""
    total = sum(sizes)
    low = max(-(-total // n_bins), max(sizes, default=0))
    step = max(1, low // 2000)
    k, best = 0, None
    while best is None:  # 0, 1, 3, 7, ... steps; then bisected
        bins, n = best_fit_decreasing(sizes, low + k * step)
        best, k = (bins if n <= n_bins else None), (k if n <= n_bins else 2 * k + 1)
    under, over = (k - 1) // 2, k
    while over - under > 1:
        mid = (under + over) // 2
        bins, n = best_fit_decreasing(sizes, low + mid * step)
        if n <= n_bins:
            best, over = bins, mid
        else:
            under = mid
    return best


def assign_shards(docs: DataFrame, *, n_shards: int = N_SHARDS, fineness: int = FINENESS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of each document."""
    spark = docs.sparkSession
    text = F.col("text")
    rows = written(docs.select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.sha2(text.cast("binary"), 256), F.lit("null")).alias("group"),
    ), "shard-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    capacity = max(1, -(-total // n_shards))
    least = max(1, capacity // fineness)
    # at most total / least groups: a bound set by the parameters
    large = rows.groupBy("group").agg(F.sum("size").alias("bytes")).where(F.col("bytes") >= least)
    large = large.select("group", F.when(F.col("bytes") > capacity, F.ceil(4 * F.col("bytes") / capacity)).otherwise(1).cast("long").alias("pieces"))
    piece = F.pmod(F.xxhash64("doc_id"), F.col("pieces"))
    bundle = F.pmod(F.xxhash64("group"), F.lit(n_shards * fineness))
    rows = rows.join(F.broadcast(large), "group", "left").withColumn("item", F.when(F.col("pieces").isNull(), F.concat(F.lit("b"), bundle)).otherwise(F.concat("group", F.lit("."), piece)))
    items = rows.groupBy("item").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    items.sort(key=lambda r: r.item)
    bins = pack_evenly([r.bytes for r in items], n_shards)
    placed = spark.createDataFrame([(r.item, b, -(-r.n // cell_rows)) for r, b in zip(items, bins, strict=True)], "item string, shard int, cells long")
    rows = rows.join(F.broadcast(placed), "item").withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.col("cells")))
    counts = rows.groupBy("shard", "item", "cell").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("item", "cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("item", "cell", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("item", "cell").orderBy("doc_id", "text_crc32"))
    return rows.join(starts, ["item", "cell"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + rank - 1).cast("long").alias("slot"))


def digest(docs: DataFrame) -> DataFrame:
    return assign_shards(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
