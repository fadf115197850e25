"""Phrase collocations: candidates by sketch upper bounds, counted by delimiter-guarded Aho-Corasick automata.

First pass: every task hashes the phrases of one word to `longest` words of its texts into one row of counters, which
saturate at the least count. Block by block the counters are summed in Spark; a counter is an upper bound of each
phrase in it, so only a bit a counter is kept (16 MB by default, the same at every size of the corpus), and broadcast.
Second pass: the phrases of a shard of text whose bound, and that of every phrase in them, reaches the least count are
compiled into an automaton, between blanks; the shard is scanned with it and all matches, overlapping ones too, are
counted. The counts of all shards are summed, and only then thresholds apply, so results are exact: the sketch merely
spares the exchange phrases that cannot reach the least count.

Scale: texts are read twice and never exchanged. A corpus of more phrases than counters fills the sketch: then it
spares less, up to nothing, and the sums exchange one row for each phrase and shard, aggregated before the exchange.
No group of rows is gathered: a language's first phrases are chosen in rounds over salted groups.

Defined cases: a null text is empty; a null lang is `und`; a text of pieces' breaks only has no words; repeated rows
count each; a text of any length is counted whole, in chunks cut between pieces; an empty table or a language without
candidates gives no rows; further columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexlake.llm.common import give_back, texts_in, written

LEAST, LONGEST, INSIDE_PERCENT, TOP = 10, 3, 50, 2000
CELLS, BLOCK, CHUNK = 1 << 27, 1 << 16, 1 << 22
SALTS = (1024, 32, 1)
_BREAK = b","
#: A-Z in lower case, tabs as blanks, every sign that ends a piece as a comma.
_NORMAL = bytes(44 if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def chunks(text: str | None, most: int = CHUNK) -> Iterator[bytes]:
    """The normalised text in chunks that are cut between pieces, each about `most` bytes where pieces allow it."""
    raw, at = (text or "").encode().translate(_NORMAL), 0
    while len(raw) - at > most:
        cut = raw.rfind(_BREAK, at, at + most)
        cut = raw.find(_BREAK, at + most) if cut < 0 else cut
        if cut < 0:
            break
        yield raw[at:cut]
        at = cut + 1
    yield raw[at:]


class _Numbers(dict):
    """Words numbered as they come; 0 is the break."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def shards(batches: Iterator[pa.RecordBatch], most: int = CHUNK) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, words) of rows (lang, text): texts of one language, a break after each piece, about `most` bytes at once."""
    for part, texts in texts_in(batches, 1, most):
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for lang, text in zip(part.column(0).to_pylist(), texts, strict=True):
            for chunk in chunks(text, most):
                held.setdefault(lang, []).append(chunk)
                sizes[lang] = sizes.get(lang, 0) + len(chunk)
                if sizes[lang] >= most:
                    yield lang, _BREAK.join(held.pop(lang)).replace(_BREAK, b" , ").split()
                    del sizes[lang]
        for lang, own in held.items():
            yield lang, _BREAK.join(own).replace(_BREAK, b" , ").split()


class Shard:
    """Words of one language as numbers, with the sketch's cells of all phrases in them."""

    def __init__(self, lang: str, own: list[bytes], longest: int, cells: int):
        numbers = _Numbers({_BREAK: 0})
        self.ids = np.fromiter(map(numbers.__getitem__, own), np.int64, len(own))
        self.vocabulary = list(numbers)
        seed = xxhash.xxh64_intdigest(lang.encode())
        h = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.vocabulary), np.uint64, len(self.vocabulary))[self.ids]
        whole, shift = self.ids > 0, np.uint64(64 - (cells - 1).bit_length())
        self.words = int(whole.sum())
        self.cells, self.valid, mixed = [], [], h
        for n in range(1, min(longest, len(own)) + 1):
            if n > 1:
                mixed = mixed[:-1] * _ODD[0] + (h[n - 1 :] ^ (h[n - 1 :] >> np.uint64(29)))
            self.valid.append(whole if n == 1 else self.valid[-1][:-1] & whole[n - 1 :])
            self.cells.append(((mixed ^ (mixed >> np.uint64(31))) * _ODD[1 + n % 2] >> shift).astype(np.int64))

    def candidates(self, bits: np.ndarray) -> list[bytes]:
        """The phrases of which the bound, and that of each phrase in them, reaches the least count."""
        out, hot, pair = [], None, self.ids
        for n, (cell, valid) in enumerate(zip(self.cells, self.valid, strict=True), 1):
            own = valid & ((bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1) > 0)
            hot = own if n == 1 else own & hot[:-1] & hot[1:]
            if n > 1:  # exact numbers of the phrases: of the shorter one's number and the last word's
                pair = np.unique(pair[:-1], return_inverse=True)[1] * np.int64(len(self.vocabulary)) + self.ids[n - 1 :]
            at = np.flatnonzero(hot)
            for i in at[np.unique(pair[at], return_index=True)[1]].tolist():
                out.append(b" ".join([self.vocabulary[k] for k in self.ids[i : i + n].tolist()]))
        return out


def matches(own: list[bytes], phrases: list[bytes]) -> np.ndarray:
    """How often each phrase occurs in the words, overlapping occurrences included."""
    automaton = ahocorasick.Automaton()
    for k, phrase in enumerate(phrases):
        automaton.add_word(f" {phrase.decode()} ", k)
    if not phrases:
        return np.zeros(0, np.int64)
    automaton.make_automaton()
    found = np.fromiter(map(itemgetter(1), automaton.iter(f" {b' '.join(own).decode()} ")), np.int64)
    return np.bincount(found, minlength=len(phrases))


def bounds(texts: DataFrame, least: int, longest: int, cells: int) -> np.ndarray:
    """One bit for each counter of the sketch of (lang, text): whether it reaches the least count."""
    block = min(BLOCK, cells)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(cells, np.uint8)
        for lang, own in shards(batches):
            shard = Shard(lang, own, longest, cells)
            for cell, valid in zip(shard.cells, shard.valid, strict=True):
                at, n = np.unique(cell[valid], return_counts=True)
                seen[at] = np.minimum(seen[at] + np.minimum(n, least), least)
        rows: tuple[list, list] = ([], [])
        for k in range(0, cells, block):
            at = np.flatnonzero(seen[k : k + block])
            if len(at):
                step = np.diff(at, prepend=0).astype("<u2").view(np.uint8).reshape(-1, 2)  # low bytes, high bytes, counts: each compresses well
                rows[0].append(k // block)
                rows[1].append(step[:, 0].tobytes() + step[:, 1].tobytes() + seen[k + at].tobytes())
            if len(rows[0]) == 64 or k + block >= cells:
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary())], names=["block", "counts"])
                rows = ([], [])
        del seen
        give_back()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block; one block's sum is held at a time."""
        name, total = None, np.zeros(block, np.uint8)
        told = lambda: pa.RecordBatch.from_arrays([pa.array([name], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != name:
                    if name is not None:
                        yield told()
                    name, total = k, np.zeros(block, np.uint8)
                low, high, n = np.frombuffer(counts, np.uint8).reshape(3, -1)
                at = np.cumsum(low.astype(np.int64) + (high.astype(np.int64) << 8))
                total[at] = np.minimum(total[at] + n, least)
        if name is not None:
            yield told()

    blocks = texts.mapInArrow(sketch, "block int, counts binary").repartition("block").sortWithinPartitions("block")
    bits = np.zeros((max(1, cells // block), max(1, block // 8)), np.uint8)
    for r in blocks.mapInArrow(summed, "block int, bits binary").collect():  # cells / 8 bytes at most
        bits[r.block] = np.frombuffer(r.bits, np.uint8)
    return bits.reshape(-1)


def counts(docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST, cells: int = CELLS) -> DataFrame:
    """(lang, phrase, n) of every phrase of up to `longest` words that occurs at least `least` times; the empty phrase has the number of all words."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    bits = texts.sparkSession.sparkContext.broadcast(bounds(texts, least, longest, cells))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, own in shards(batches):
            shard = Shard(lang, own, longest, cells)
            phrases = shard.candidates(bits.value)
            n = matches(own, phrases)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(n) + 1), pa.string()), pa.array(["", *(p.decode() for p in phrases)], pa.string()), pa.array([shard.words, *n.tolist()], pa.int64())], names=["lang", "phrase", "n"])
        give_back()

    found = texts.mapInArrow(scan, "lang string, phrase string, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return found.where((F.col("n") >= least) | (F.col("phrase") == ""))


def _joined(own: Column, first, n) -> Column:
    return F.array_join(F.slice(own, first, n), " ")


def scored(found: DataFrame, inside_percent: int = INSIDE_PERCENT) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two words and more of `found`, a written table of counts()."""
    own = F.split("phrase", " ")
    phrases = found.where("phrase LIKE '% %'").select("lang", "phrase", F.col("n").alias("a"), own.alias("own"))
    size = F.size("own")
    cut = F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.struct(k.alias("k"), _joined(F.col("own"), F.lit(1), k).alias("left"), _joined(F.col("own"), k + 1, size - k).alias("right")))
    cuts = phrases.select("lang", "phrase", "a", F.explode(cut).alias("cut")).select("lang", "phrase", "a", "cut.*")
    part = lambda side, n: found.select("lang", F.col("phrase").alias(side), F.col("n").alias(n))
    both = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    # neither part occurs less often than the phrase, so the score is at most 1000000; 15 and 19 digits hold any count there can be
    score = F.expr("CAST(1000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(15, 0)) * CAST(a AS DECIMAL(15, 0)) div (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))")
    least = both.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut")).select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.score")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: _joined(F.col("own"), i, n))))
    longer = phrases.where(size > 2).select("lang", "a", F.explode(F.array_distinct(spans)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    return least.join(written(longer, "longer"), ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("most") < inside_percent * F.col("a"), F.lit(True))).drop("most")


def first_of(rows: DataFrame, top: int = TOP) -> DataFrame:
    """rows with their rank, of each lang the first `top`: first of salted groups, so that no language is ranked in one task."""
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    for n in SALTS:
        salt = F.pmod(F.xxhash64("phrase"), F.lit(n))
        rows = rows.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return rows.drop("salt")


def collocations(docs: DataFrame, *, top: int = TOP, inside_percent: int = INSIDE_PERCENT, **more) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's strongest phrases."""
    found = written(counts(docs, **more), "phrase-counts")
    n = found.where("phrase = ''").select("lang", "n")
    best = first_of(written(scored(found, inside_percent), "scored"), top)
    return best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def digest(docs: DataFrame) -> DataFrame:
    return collocations(docs)


ORACLE = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
own AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM own, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
cut AS (SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS pos FROM c),
parts AS (SELECT c.lang, c.phrase, c.a, c.pos, x.a AS l, y.a AS r, 1000000 * c.a * c.a // (x.a * y.a) AS score
  FROM cut c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.pos], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.pos + 1:], ' ')),
best AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, pos) = 1),
held AS (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3),
most AS (SELECT lang, phrase, max(a) AS most FROM held GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN most m ON m.lang = b.lang AND m.phrase = b.phrase WHERE m.most IS NULL OR 100 * m.most < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, r.rank::BIGINT AS rank, r.phrase, r.a::BIGINT AS a, r.l::BIGINT AS l, r.r::BIGINT AS r, t.n, r.score::BIGINT AS score FROM ranked r JOIN total t ON t.lang = r.lang WHERE r.rank <= 2000
"""
