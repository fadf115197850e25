"""Substring dedup by sharded FM-indexes.

A window of `window` words is told from the anchor in it: the k-gram of least hash, the first of equals. Equal windows
have equal anchors, so windows can only meet under one anchor. Steps:

1. Sketch (one pass over the texts): maximal runs of windows with one anchor, as (anchor, hash of the run, place).
2. Anchors seen in two documents or more are kept, by a grouped minimum and maximum; most text ends here.
3. Of runs with equal words one stands for all, the one of the least doc_id; its words are fetched from its document.
4. Passages go to a shard by anchor. Those of an anchor with more than `hot_runs` different passages are cut and dealt
   anew by longer anchors, at last by whole windows, until no anchor is hot.
5. Each shard builds an FM-index of its passages and streams the passages through it: matching statistics of at least
   `window` words are reported as intervals, each with the least doc_id that has the words.
6. Intervals go back to all documents with such a run; words with a smaller doc_id are removed.

Scale: all exchanges but one carry hashes and places; texts are exchanged once, by document, for steps 3 and 6 together.
Shards are runs of whole keys of about `shard_words` words. No exchange gathers a hot key: groupings are minima, and
joins are of written tables or between exchanged sides, which can be split. Words are compared as words in the shards;
passages are told apart by two 64-bit hashes, of their anchor and of all their words.

Defined cases: a null or empty text has no words and nothing is removed; a document with fewer words than a window
stays whole; a text of any length is one row of its scan, and only its own words are held; of rows that repeat a doc_id
each is judged by its own text, and they take nothing from each other; rows without a doc_id remove nothing and lose
nothing; an empty table gives no rows; further columns are left aside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexlake.llm.common import texts_in, written
from codexlake.llm.fm_index import FMIndex

WINDOW, ANCHOR, HOT_RUNS, SHARD_WORDS = 50, 8, 128, 1 << 19
#: Anchors of hot keys, before whole windows.
LONGER = (24,)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def anchor_runs(texts: list[list[bytes]], window: int = WINDOW, k: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Of each run: number of the text, first word, windows, anchor, hash of the run's words."""
    sizes = np.array([len(t) for t in texts])
    flat = [w for t in texts for w in t]
    n = len(flat)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none, none
    k = min(k, window)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, flat), np.uint64, n)
    gram = hashes[: n - k + 1].copy()
    for j in range(1, k):
        gram *= _ODD
        gram += hashes[j : n - k + 1 + j]
    gram ^= gram >> np.uint64(31)
    gram *= np.uint64(0xBF58476D1CE4E5B9)
    gram ^= gram >> np.uint64(29)
    # least of `span` grams from each on, and where: doubled, the left one first among equals
    span, value, place, length = window - k + 1, gram, np.arange(len(gram)), 1
    while length < span:
        by = min(length, span - length)
        left, right = value[:-by], value[by:]
        pick = right < left
        value, place = np.where(pick, right, left), np.where(pick, place[by:], place[:-by])
        length += by
    text = np.repeat(np.arange(len(texts)), sizes)
    at = np.flatnonzero(text[: n - window + 1] == text[window - 1 :])
    if not len(at):
        return none, none, none, none, none
    new = np.concatenate([[True], (place[at][1:] != place[at][:-1]) | (at[1:] != at[:-1] + 1) | (text[at][1:] != text[at][:-1])])
    first = at[new]
    count = np.diff(np.append(np.flatnonzero(new), len(at)))
    joined = b" ".join(flat)
    ends = np.cumsum(np.fromiter(map(len, flat), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    run = np.fromiter((digest(joined[a:b], 1) for a, b in zip(starts[first].tolist(), ends[first + count + window - 2].tolist(), strict=True)), np.uint64, len(first))
    origin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return text[first], first - origin[text[first]], count, value[first].view(np.int64), run.view(np.int64)


def sketch(docs: DataFrame, window: int, k: int) -> DataFrame:
    """(anchor, run, doc_id, text_key, start, windows) of every run of every document (doc_id, text, text_key)."""
    kinds = pa.schema([("anchor", pa.int64()), ("run", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int32()), ("windows", pa.int32())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in texts_in(batches, 1, 1 << 21):
            text, start, count, anchor, run = anchor_runs([words(t) for t in texts], window, k)
            ids, keys = (part.column(c).to_numpy()[text] for c in (0, 2))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((anchor, run, ids, keys, start.astype(np.int32), count.astype(np.int32)), kinds.types, strict=True)], schema=kinds)

    return docs.mapInArrow(scan, "anchor bigint, run bigint, doc_id bigint, text_key bigint, start int, windows int")


def passages(held: DataFrame, window: int) -> DataFrame:
    """(key, run, doc_id, high, passage): the words of chosen runs. held: doc_id, text, runs (anchor, run, start, windows, high).

    doc_id is the run's least document, high its greatest.
    """
    kinds = pa.schema([("key", pa.int64()), ("run", pa.int64()), ("doc_id", pa.int64()), ("high", pa.int64()), ("passage", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in texts_in(batches, 1, 1 << 21):
            out: list[tuple] = []
            for doc, text, runs in zip(part.column(0).to_pylist(), texts, part.column(2).to_pylist(), strict=True):
                own = words(text)
                out += [(r["anchor"], r["run"], doc, r["high"], b" ".join(own[r["start"] : r["start"] + r["windows"] + window - 1]).decode()) for r in runs]
                if len(out) > 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds.types, strict=True)], schema=kinds)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds.types, strict=True)], schema=kinds)

    return held.mapInArrow(scan, "key bigint, run bigint, doc_id bigint, high bigint, passage string")


def reanchored(pieces: DataFrame, window: int, k: int) -> DataFrame:
    """Passages cut into runs of windows with one longer anchor: the passage each comes from (of, of_run) and its first window there (at)."""
    kinds = pa.schema([("key", pa.int64()), ("run", pa.int64()), ("of", pa.int64()), ("of_run", pa.int64()), ("at", pa.int32()), ("doc_id", pa.int64()), ("high", pa.int64()), ("passage", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in texts_in(batches, 4, 1 << 19):
            own = [t.encode().split(b" ") for t in texts]
            text, start, count, anchor, run = anchor_runs(own, window, k)
            said = [b" ".join(own[t][a : a + n + window - 1]).decode() for t, a, n in zip(text.tolist(), start.tolist(), count.tolist(), strict=True)]
            key, of_run, doc, high = (part.column(c).to_numpy()[text] for c in range(4))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((anchor, run, key, of_run, start.astype(np.int32), doc, high, said), kinds.types, strict=True)], schema=kinds)

    return pieces.mapInArrow(scan, "key bigint, run bigint, of bigint, of_run bigint, at int, doc_id bigint, high bigint, passage string")


def shard_matches(rows: DataFrame, window: int, shard_words: int) -> DataFrame:
    """rows: key, run, doc_id, passage. (key, run, spans): the windows of each passage with the least doc_id that has them, as intervals."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("least", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, str]] = []
        size = 0

        def out(rows: list[tuple[int, int, int, str]]) -> pa.RecordBatch:
            code: dict[str, int] = {}
            texts = [np.array([code.setdefault(w, len(code) + 1) for w in r[3].split(" ")], np.int64) for r in rows]
            length, least = FMIndex(texts, np.array([r[2] for r in rows]), window).statistics(texts)
            spans = []
            for k, t in enumerate(texts):
                n = len(t) - window + 1
                found = least[k, :n]
                cut = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
                ends = np.append(cut[1:], n)
                spans.append([{"start": a, "end": b, "least": v} for a, b, v in zip(cut.tolist(), ends.tolist(), found[cut].tolist(), strict=True)])
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(spans, span)], names=["key", "run", "spans"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if size > shard_words and row[0] != held[-1][0]:
                    yield out(held)
                    held, size = [], 0
                held.append(row)
                size += row[3].count(" ") + 2
        if held:
            yield out(held)

    ordered = rows.select("key", "run", "doc_id", "passage").repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(scan, "key bigint, run bigint, spans array<struct<start:int,end:int,least:bigint>>")


def matches(pieces: DataFrame, window: int, longer: tuple[int, ...], hot_runs: int, shard_words: int) -> DataFrame:
    """(key, run, spans) of passages (key, run, doc_id, high, passage), a written table: what shard_matches says of keys of up to hot_runs passages.

    Passages of other keys are dealt by the next longer anchor in them; the last length is the window, where equal
    windows are one passage and no key is hot.
    """
    if not longer:
        return shard_matches(pieces, window, shard_words)
    # written, so that a join with it is of two exchanged sides at most and a hot key's partition can be split
    hot = written(pieces.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot_runs).select("key"), "hot-keys")
    if hot.isEmpty():
        return shard_matches(pieces, window, shard_words)
    cold = shard_matches(pieces.join(hot, "key", "left_anti"), window, shard_words)
    parts = written(reanchored(pieces.join(hot, "key", "left_semi").select("key", "run", "doc_id", "high", "passage"), window, longer[0]), "reanchored")
    seen = written(parts.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("high").alias("high")).where("low < high").select("key"), "anchors")
    shared = parts.join(seen, "key", "left_semi")
    distinct = written(shared.groupBy("key", "run").agg(F.min("doc_id").alias("doc_id"), F.max("high").alias("high"), F.min("passage").alias("passage")), "passages")
    found = matches(distinct, window, longer[1:], hot_runs, shard_words)
    moved = F.transform("spans", lambda s: F.struct((F.col("at") + s["start"]).alias("start"), (F.col("at") + s["end"]).alias("end"), s["least"].alias("least")))
    back = parts.select("key", "run", "of", "of_run", "at").join(found, ["key", "run"]).select(F.col("of").alias("key"), F.col("of_run").alias("run"), moved.alias("spans"))
    return cold.unionByName(back.groupBy("key", "run").agg(F.flatten(F.collect_list("spans")).alias("spans")))


def removals(docs: DataFrame, *, window: int = WINDOW, k: int = ANCHOR, hot_runs: int = HOT_RUNS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, text_key, spans) for documents (doc_id, text, text_key) that lose words: spans of words, (start, end)."""
    rows = written(sketch(docs, window, k), "runs")
    # written, so that both sides of the join are exchanged for it and a hot anchor's partition can be split
    seen = written(rows.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor"), "anchors")
    rows = written(rows.join(seen, "anchor", "left_semi"), "shared-runs")
    runs = rows.groupBy("anchor", "run").agg(F.min(F.struct("doc_id", "text_key", "start", "windows")).alias("first"), F.max("doc_id").alias("high"))
    chosen = runs.groupBy("first.doc_id", "first.text_key").agg(F.collect_list(F.struct("anchor", "run", F.col("first.start").alias("start"), F.col("first.windows").alias("windows"), "high")).alias("runs"))
    # rows that repeat a document whole give its passages once
    held = docs.join(chosen, ["doc_id", "text_key"]).select("doc_id", "text", "runs")
    pieces = passages(held, window).groupBy("key", "run").agg(*(F.first(c).alias(c) for c in ("doc_id", "high", "passage")))
    found = matches(written(pieces, "passages"), window, tuple(x for x in LONGER if k < x < window) + (window,), hot_runs, shard_words)
    mine = F.transform(F.filter("spans", lambda s: s["least"] < F.col("doc_id")), lambda s: F.struct((F.col("start") + s["start"]).alias("start"), (F.col("start") + s["end"] + (window - 1)).alias("end")))
    hits = rows.join(found.withColumnRenamed("key", "anchor"), ["anchor", "run"]).select("doc_id", "text_key", mine.alias("spans")).where(F.size("spans") > 0)
    return hits.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def without_repeats(docs: DataFrame, **more) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of documents (doc_id, text): kept is the words left, joined by blanks."""
    return _applied(docs, False, **more)


def _applied(docs: DataFrame, digest_only: bool, **more) -> DataFrame:
    docs = docs.select("doc_id", "text")
    named = docs.where("doc_id IS NOT NULL").withColumn("text_key", F.xxhash64("text"))
    lost = removals(named, **more)
    last = "kept_sha256" if digest_only else "kept"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in texts_in(batches, 1, 1 << 21):
            counts, removed, kept = [], [], []
            for text, spans in zip(texts, part.column(2).to_pylist(), strict=True):
                own = words(text)
                counts.append(len(own))
                if spans:
                    gone = np.zeros(len(own) + 1, np.int64)
                    for s in spans:
                        gone[s["start"]] += 1
                        gone[s["end"]] -= 1
                    gone = np.cumsum(gone[:-1]) > 0
                    own = [w for w, g in zip(own, gone.tolist(), strict=True) if not g]
                removed.append(counts[-1] - len(own))
                said = b" ".join(own)
                kept.append(hashlib.sha256(said).hexdigest() if digest_only else said.decode())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", last])

    both = named.join(lost, ["doc_id", "text_key"], "left").select("doc_id", "text", "spans").unionByName(docs.where("doc_id IS NULL"), allowMissingColumns=True)
    return both.mapInArrow(scan, f"doc_id bigint, n_words bigint, n_removed bigint, {last} string")


def digest(docs: DataFrame) -> DataFrame:
    return _applied(docs, True)


ORACLE = r"""
WITH own AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
flat AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i, CASE WHEN len(w) >= 50 THEN w END AS w FROM own),
seen AS (SELECT doc_id, n, word, i, CASE WHEN i + 49 <= n THEN md5(array_to_string(w[i:i + 49], ' ')) END AS h FROM flat),
least AS (SELECT h, min(doc_id) AS low FROM seen WHERE h IS NOT NULL GROUP BY h),
marked AS (SELECT s.doc_id, s.word, s.i, coalesce(l.low < s.doc_id, false) AS starts FROM seen s LEFT JOIN least l ON s.h = l.h),
gone AS (SELECT doc_id, word, i, max(starts::INTEGER) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS g FROM marked),
out AS (SELECT doc_id, sum(g)::BIGINT AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (g = 0), '')) AS kept_sha256 FROM gone GROUP BY 1)
SELECT o.doc_id, len(o.w) AS n_words, coalesce(x.n_removed, 0) AS n_removed, coalesce(x.kept_sha256, sha256('')) AS kept_sha256 FROM own o LEFT JOIN out x ON o.doc_id = x.doc_id
"""
