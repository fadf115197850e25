"""Exact near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Order: shingles are ordered by (hot, hash), one order for all texts. Two texts of that similarity share a shingle among
the first n - ceil(0.8 n) + 1 of each (prefix filter), whatever the order; so the order sets the cost only. Hot are
the shingles that over `HOT` texts have among their lowest hashes: passages that many texts share move to the end, and texts that share
nothing else don't meet. They are kept as bits of a fixed size; two shingles on one bit are hot together.

Groups: a shingle's texts first meet one leader of the group, `LEADS` times; pairs that are similar make their classes
one, and a pair inside one class is never looked at again. So a group of copies costs its size. What is left, texts of
different classes that share a rare shingle, meets in a join whose condition counts the bits in which their parities
differ: a lower bound of the shingles in which they differ, so it only drops pairs that cannot be similar. Every pair
beyond it is compared exactly, shingle by shingle.

Scale: texts are read twice; one exchange of the prefixes (a fifth of the shingles, 20 bytes each), from which only
shingles of two texts or more go on. That step streams a shingle's rows and holds one of them. Texts that are mostly hot
passages, differently joined, cost the square of the group they meet in: comparisons of bits inside the join, whose
large partitions adaptive execution splits. Above some 2,000 shingles the parities drop little, and pairs go on to texts.

Defined cases: texts without words have no shingle and link with nothing here; fewer words than five are one shingle; a
text of any length is one row of its scan; a null text has no words; an empty table gives no links; texts are told apart by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexlake.llm.common import LOWER, texts_in, written
from codexlake.llm.components import components

SHINGLE, PERCENT = 5, 80
HOT, HOT_BITS, LEADS, WORDS = 16, 26, 2, 16


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The distinct shingles' hashes, rising, not negative; words are lower-cased in A-Z."""
    own = text.encode().translate(LOWER).split() if text else []
    if not own:
        return np.zeros(0, np.int64)
    digest = xxhash.xxh64_intdigest
    seen: dict[bytes, int] = {}
    words = np.fromiter((seen[w] if w in seen else seen.setdefault(w, digest(w)) for w in own), np.uint64, len(own))
    k = min(k, len(words))
    mixed = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):  # a polynomial over the words' hashes
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - k + 1 + i]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed >> np.uint64(1)).astype(np.int64)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n + (-percent * n) // 100 + 1 if n else 0


def hot_bits(texts: DataFrame, percent: int = PERCENT, hot: int = HOT, bits: int = HOT_BITS) -> np.ndarray:
    """One bit for each value of a hash's low bits: set if a hot shingle has it. Its size is fixed: 2^bits bits."""

    def low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, some in texts_in(batches, 0):
            for text in some:
                own = shingles(text)
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(own[: 2 * prefix_length(len(own), percent)])], names=["token"])

    counts = texts.select("text").mapInArrow(_gathered(low), "token bigint").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > hot)
    at = F.col("token").bitwiseAND(F.lit((1 << bits) - 1))
    parts = counts.groupBy(F.shiftright(at, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(token & 63 AS int))")).alias("bits"))
    out = np.zeros(1 << (bits - 6), np.int64)
    got = parts.toArrow()  # at most 2^(bits - 6) rows
    out[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    return out


def _gathered(scan, most: int = 1 << 16):
    """scan, its small batches put together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in scan(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches(most)
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches(most)

    return run


def shared_prefixes(texts: DataFrame, hot: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """(token, key, n) of (key, text): prefix shingles that two texts have at least; n is the text's number of shingles."""
    held = texts.sparkSession.sparkContext.broadcast(hot)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for part, some in texts_in(batches, 1):
            for key, text in zip(part.column(0).to_pylist(), some, strict=True):
                own = shingles(text)
                if len(own):
                    at = own & (64 * len(table) - 1)
                    late = table[at >> 6] >> (at & 63) & 1
                    first = own[np.argsort(late, kind="stable")[: prefix_length(len(own), percent)]]
                    yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(np.full(len(first), key)), pa.array(np.full(len(first), len(own)))], names=["token", "key", "n"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, told = None, False  # the row before, as a batch, and whether it went on already
        for batch in batches:
            token = batch.column(0).to_numpy()
            if not len(token):
                continue
            same = token[1:] == token[:-1]
            meets = last is not None and last.column(0)[0].as_py() == token[0]
            if meets and not told:
                yield last
            keep = np.concatenate([[meets], same]) | np.concatenate([same, [False]])
            yield batch.filter(pa.array(keep))
            last, told = batch.slice(len(token) - 1), bool(keep[-1])

    schema = "token bigint, key bigint, n bigint"
    rows = texts.select("key", "text").mapInArrow(_gathered(scan), schema)
    return rows.repartition("token").sortWithinPartitions("token").mapInArrow(shared, schema)


def similar(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a_class, b_class) of those pairs (a, b, a_class, b_class) whose texts are similar."""
    one = lambda side: texts.select(F.col("key").alias(side), F.col("text").alias(f"{side}_text"))
    both = pairs.join(one("a"), "a").join(one("b"), "b").select("a_class", "b_class", "a_text", "b_text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, left in texts_in(batches, 2, 1 << 21):
            alike = []
            for a, b in zip(left, part.column(3), strict=True):
                x, y = shingles(a), shingles(b.as_py())
                common = len(np.intersect1d(x, y, assume_unique=True))
                alike.append(100 * common >= percent * (len(x) + len(y) - common))
            yield part.select(["a_class", "b_class"]).filter(pa.array(alike, pa.bool_()))

    return both.mapInArrow(scan, "a_class bigint, b_class bigint")


def parities(texts: DataFrame) -> DataFrame:
    """(key, bits) of (key, text): `WORDS` longs, of whose bits each is the parity of the shingles that fall on it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, some in texts_in(batches, 1):
            out = np.zeros((len(some), 64 * WORDS), np.uint8)
            for row, text in zip(out, some, strict=True):
                row[:] = np.bincount(shingles(text) % (64 * WORDS), minlength=64 * WORDS) & 1
            longs = np.packbits(out, axis=1, bitorder="little").view("<i8").reshape(-1)
            ends = pa.array(np.arange(0, len(longs) + 1, WORDS, np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(longs))], names=["key", "bits"])

    return texts.select("key", "text").mapInArrow(scan, "key bigint, bits array<bigint>")


def merged(texts: DataFrame, classes: DataFrame, percent: int = PERCENT, hot: int = HOT, leads: int = LEADS) -> DataFrame:
    """(key, class) anew: classes that a similar pair of (key, text) ties are one, named by the least of them."""
    rows = shared_prefixes(texts, hot_bits(texts, percent, hot), percent).join(classes, "key")
    rows = written(rows.select("token", "key", "n", "class"), "prefixes")

    def tied(pairs: DataFrame) -> DataFrame | None:
        """(class, root) of the classes that pairs tie, or None."""
        fits = (100 * F.col("a_n") >= percent * F.col("b_n")) & (100 * F.col("b_n") >= percent * F.col("a_n"))
        some = written(pairs.where(fits & (F.col("a_class") != F.col("b_class"))).select("a", "b", "a_class", "b_class").distinct(), "near-pairs")
        edges = written(similar(some, texts, percent).select(F.greatest("a_class", "b_class").alias("a"), F.least("a_class", "b_class").alias("b")).distinct(), "near-links")
        return None if edges.isEmpty() else written(components(edges).select(F.col("node").alias("class"), "root"), "near-roots")

    def renamed(df: DataFrame, named: DataFrame | None) -> DataFrame:
        return df if named is None else df.join(named, "class", "left").withColumn("class", F.coalesce("root", "class")).drop("root")

    def side(name: str) -> list:
        return [F.col("key").alias(name), F.col("n").alias(f"{name}_n"), F.col("class").alias(f"{name}_class")]

    for turn in range(leads):
        leader = F.min_by(F.struct(*side("b")), F.xxhash64("key", F.lit(turn))).alias("leader")
        # groups of one class need no look; written, so that both sides of the join are exchanged and a hot shingle can be split
        groups = written(rows.groupBy("token").agg(F.min("class").alias("low"), F.max("class").alias("high"), leader).where("low != high").select("token", "leader.*"), "near-groups")
        met = rows.join(groups, "token").where("key != b")
        named = tied(met.select(*side("a"), "b", "b_n", "b_class"))
        rows = written(renamed(met.select("token", "key", "n", "class"), named).select("token", "key", "n", "class"), "prefixes")
        classes = written(renamed(classes, named).select("key", "class"), "near-classes")
    groups = written(rows.groupBy("token").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low != high").select("token"), "near-groups")
    rows = written(rows.join(groups, "token"), "prefixes")
    keys = rows.select("key").distinct()
    bits = written(parities(texts.join(keys, "key", "left_semi")), "parities")
    rows = written(rows.join(bits, "key").select("token", "key", "n", "class", *(F.col("bits")[i].alias(f"w{i}") for i in range(WORDS))), "prefixes")
    both = rows.select("token", *side("a"), *(F.col(f"w{i}").alias(f"a{i}") for i in range(WORDS))).join(rows.select("token", *side("b"), *(F.col(f"w{i}").alias(f"b{i}") for i in range(WORDS))), "token")
    # the bits in which two texts differ are at most the shingles in which they differ
    apart = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(1, WORDS)), F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))))
    near = (100 + percent) * apart <= (100 - percent) * (F.col("a_n") + F.col("b_n"))
    return renamed(classes, tied(both.where(F.col("a_class") < F.col("b_class")).where(near))).select("key", "class")
