"""SimHash near-dedup: 64-bit fingerprints, linked within a Hamming radius by shards of vantage-point trees.

Routing: the bits fall into radius + 1 blocks. Two fingerprints within the radius agree on one block at least, that is,
one of the projected distances is 0; so each block value is a vantage shard of radius 0. A shard of more than
`shard_rows` fingerprints is dealt on by Hamming distance to a vantage point of its own, in rings; by the triangle
inequality only fingerprints within the radius of a ring's border can link across it, and those are sent to both
sides. What is still too large after `RING_ROUNDS` rounds is dealt by blocks of other bits, again and again, until no
shard is too large: that ends, as each round fixes more bits and a shard of equal fingerprints is one row. In a shard, a vantage-point tree answers which fingerprints lie within the radius, pruning branches the same
way. So no link is lost, and no shard pairs everything.

Scale: texts are read once and only fingerprints are shuffled; equal fingerprints (exact copies, hot groups) are one
row from the first grouping on. A shard hands on a spanning forest of its links, never all pairs.

Defined cases: a null, empty or wordless text has fingerprint 0, linked like any other; fewer words than a shingle are
one shingle; a text of any length is one row of its scan; repeated doc_ids belong to the component of each of their texts; null doc_ids are never a component's
name unless nothing else is there; an empty table gives no rows; further columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexlake.llm import near_copies
from codexlake.llm.common import LOWER, fresh, texts_in, written
from codexlake.llm.components import components

SHINGLE, SEED, RADIUS = 3, 42, 3
SHARD_ROWS, RING, RING_ROUNDS, LEAF = 2000, 8, 3, 32


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit k is 1 if it is set in over half of the shingles' XXH64."""
    own = text.encode().translate(LOWER).split() if text else []
    if not own:
        return 0
    joined = b" ".join(own)
    ends = np.cumsum([len(w) + 1 for w in own]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(own))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: len(own) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, len(own) - k + 1)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of (doc_id, text): the fingerprint's 64 bits as a signed integer."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in texts_in(batches, 1):
            found = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id bigint, fp bigint")


# -- links in a shard ------------------------------------------------------------------------------------------------


class Forest:
    """Union-find over positions that takes arrays of pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def tie(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            if (x == y).all():
                return
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while ((up := self.root[self.root]) != self.root).any():
                self.root = up


class VantageTree:
    """Fingerprints split by distance to a vantage point at the median; leaves are scanned."""

    def __init__(self, fps: np.ndarray, at: np.ndarray | None = None):
        self.fps, self.at = fps, np.arange(len(fps)) if at is None else at
        self.inner = self.outer = None
        if len(self.at) > LEAF:
            self.vantage = fps[self.at[len(self.at) // 2]]
            d = np.bitwise_count(fps[self.at] ^ self.vantage)
            self.edge = int(np.median(d))
            inside = d <= self.edge
            if not inside.all():
                self.inner, self.outer = VantageTree(fps, self.at[inside]), VantageTree(fps, self.at[~inside])

    def within(self, asked: np.ndarray, radius: int, forest: Forest) -> None:
        """Ties each of the positions asked to all that lie within radius."""
        if not len(asked):
            return
        if self.inner is None:
            for i in range(0, len(asked), 512):
                some = asked[i : i + 512]
                for j in range(0, len(self.at), 4096):
                    own = self.at[j : j + 4096]
                    near = np.bitwise_count(self.fps[some][:, None] ^ self.fps[own][None, :]) <= radius
                    p, q = np.nonzero(near)
                    forest.tie(some[p], own[q])
            return
        d = np.bitwise_count(self.fps[asked] ^ self.vantage).astype(np.int64)
        self.inner.within(asked[d <= self.edge + radius], radius, forest)
        self.outer.within(asked[d > self.edge - radius], radius, forest)


def shard_links(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (fingerprint, root) of the links of one shard's fingerprints."""
    forest = Forest(len(fps))
    VantageTree(fps).within(np.arange(len(fps)), radius, forest)
    tied = np.flatnonzero(forest.root != np.arange(len(fps)))
    return fps[tied], fps[forest.root[tied]]


def _links(shard: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of whole shards, one after the other: small ones are one leaf each and scanned together, larger ones get a tree."""
    starts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    sizes = np.diff(np.append(starts, len(shard)))
    out = [shard_links(fps[s : s + n], radius) for s, n in zip(starts[sizes > LEAF].tolist(), sizes[sizes > LEAF].tolist(), strict=True)]
    small = np.repeat(sizes <= LEAF, sizes)
    f, g = fps[small], shard[small]
    for step in range(1, LEAF):
        same = g[step:] == g[:-step]
        if not same.any():
            break
        a, b = f[step:][same], f[:-step][same]
        near = np.bitwise_count(a ^ b) <= radius
        out.append((a[near], b[near]))
    return np.concatenate([x[0] for x in out] or [f[:0]]), np.concatenate([x[1] for x in out] or [f[:0]])


# -- links over all shards -------------------------------------------------------------------------------------------


def bit_classes(n: int, level: int) -> list[int]:
    """Masks of n classes of the 64 bits, as signed integers; runs of bits at level 0, others at each level beyond."""
    order = np.arange(64) if not level else np.random.default_rng(level).permutation(64)
    masks = [sum(1 << int(b) for b in part) for part in np.array_split(order, n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b) that connect what lies within radius among distinct fingerprints (fp)."""
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage")))
    # the ring of a fingerprint, and the next one if that starts within the radius
    rings = F.sequence((far / RING).cast("int"), ((far + radius) / RING).cast("int"))
    parts = lambda level: F.transform(F.array(*map(F.lit, bit_classes(radius + 1, level))), lambda m, k: F.xxhash64(k, m.bitwiseAND(F.col("fp"))))
    rows, done, level = distinct.select("fp", F.explode(parts(0)).alias("shard")), [], 0
    while True:
        vantage = F.min_by("fp", F.xxhash64("fp", F.lit(level))).alias("vantage")
        full = written(rows.groupBy("shard").agg(F.count("*").alias("n"), vantage).where(F.col("n") > shard_rows).drop("n"), "full-shards")
        if full.isEmpty():
            break
        done.append(rows.join(full, "shard", "left_anti").select("shard", "fp"))
        level += 1
        dealt = rows.join(full, "shard").select("fp", "shard", F.explode(rings if level <= RING_ROUNDS else parts(level)).alias("part"))
        rows = written(dealt.select("fp", F.xxhash64("shard", "part").alias("shard")), "dealt")
    done.append(rows.select("shard", "fp"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        kept: list[np.ndarray] = []

        def out(shard: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            a, b = _links(shard, fps.view(np.uint64), radius)
            pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1), axis=0).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            held.append(batch.column(0).to_numpy())
            kept.append(batch.column(1).to_numpy())
            if held[0][0] == held[-1][-1]:
                continue  # one shard goes on
            shard, fps = np.concatenate(held), np.concatenate(kept)
            last = int(np.searchsorted(shard, shard[-1]))
            yield out(shard[:last], fps[:last])
            held, kept = [shard[last:]], [fps[last:]]
        if held and len(held[0]):
            yield out(np.concatenate(held), np.concatenate(kept))

    return reduce(DataFrame.union, done).repartition("shard").sortWithinPartitions("shard").mapInArrow(scan, "a bigint, b bigint")


def roots(distinct: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(fp, root): the least fingerprint of the component, of each fingerprint that has links."""
    return written(components(links(distinct.select("fp"), radius, shard_rows)).withColumnRenamed("node", "fp"), "roots")


def classes(prints: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) from (doc_id, fp): the least doc_id that links reach."""
    prints = written(prints, "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    linked = written(distinct.join(roots(distinct, radius, shard_rows), "fp"), "linked")
    # groupings are written, so that both sides of a join are exchanged for it and a hot key's partition can be split
    least = written(linked.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    named = linked.join(least, "root").select("fp", "component_id")
    names = written(distinct.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")), "names")
    return prints.join(names, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, percent: int | None = near_copies.PERCENT) -> DataFrame:
    """docs, same columns: of each group one row, of the least doc_id and then the least text's hash; rows without a doc_id stay.

    A group is what links reach: fingerprints within radius, and, by an exact check that follows them, texts whose
    five-word shingles have a Jaccard similarity of percent / 100 or more (None: no such check).
    """
    key = fresh("_text_key", docs.columns)
    named = docs.where("doc_id IS NOT NULL").withColumn(key, F.xxhash64("text"))
    texts = written(named.select(F.col(key).alias("key"), "text").dropDuplicates(["key"]), "texts")
    prints = written(fingerprints(texts.select(F.col("key").alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), "fp"), "fingerprints")
    distinct = written(prints.select("fp").distinct(), "distinct")
    of_root = prints.join(roots(distinct, radius, shard_rows), "fp", "left").select("key", F.coalesce("root", "fp").alias("root"))
    least = written(of_root.groupBy("root").agg(F.min("key").alias("class")), "least")
    classes = written(of_root.join(least, "root").select("key", "class"), "classes")
    if percent is not None:
        classes = written(near_copies.merged(texts, classes, percent), "classes")
    firsts = written(named.groupBy(F.col(key).alias("key")).agg(F.min("doc_id").alias("doc_id")), "firsts")
    kept = written(firsts.join(classes, "key").groupBy("class").agg(F.min(F.struct("doc_id", "key")).alias("first")).select("first.doc_id", F.col("first.key").alias(key)), "kept")
    one = named.join(kept, ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key])
    return one.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def digest(docs: DataFrame) -> DataFrame:
    found = classes(fingerprints(docs))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
