"""Benchmark decontamination: a generalised suffix automaton of the benchmark's words, streamed over by every document.

The automaton has one state per class of item substrings; reading a document word by word keeps the longest suffix
read that occurs in any item. A suffix of `window` words or more marks its last `window` words; an item shorter than
a window counts as a whole.

Scale: documents are scanned once and never shuffled. The items are shipped to the executors in blocks whose size is
measured first (`block_bytes`), one block at a time; a larger benchmark takes one pass over the documents for each
block, written to the shared folder in between. A worker builds a block's automaton once for all its tasks and holds
one automaton, about 90 bytes for a byte of items (366 MB for a block of 4 MB). Nothing is dropped.

Defined cases: a null or empty text has no words, is never hit, and comes back as it is; a text of any length is read
word by word; items without words are passed over; repeated items count once per item_id, repeated documents are judged each by itself; an empty benchmark
hits nothing; further columns of the documents pass through unchanged, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codexlake.llm.common import fresh, texts_in, written

WINDOW = 10
BLOCK_BYTES = 4 << 20
#: Spans from so many words on are cut out of a text; a text with a larger share of hit words goes as a whole.
MIN_SPAN_WORDS, MAX_COVERAGE = 1, 0.5

#: A-Z to lower case; ASCII that is neither letter nor digit to a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_RAW_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    """Normalised words: [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class ItemAutomaton:
    """Generalised suffix automaton over the words of many items.

    Transitions are one map, from state and word to state; lengths and links are arrays. A state stands for substrings
    that end at the same places, of which one at most is `window` words long: items are named at that state, their home.
    """

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.code = window, {}
        coded = [(item, [self.code.setdefault(w, len(self.code)) for w in text]) for item, text in items]
        self.width = max(1, len(self.code))
        self.to: dict[int, int] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        self._first, self._more = array("i", [-1]), {}
        for _, ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        del self._first, self._more
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        #: The state of the last `window` words of what a state stands for; 0 where that is shorter.
        self.home = array("i", bytes(4 * len(self.length)))
        for s in order:
            if self.length[s] >= window:
                self.home[s] = s if self.length[self.link[s]] < window else self.home[self.link[s]]
        #: Items by home state; items shorter than a window by the state and length of the whole item.
        self.items_at: dict[int, set[str]] = defaultdict(set)
        self.short_at: dict[int, dict[int, set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, ids in coded:
            state = 0
            for i, c in enumerate(ids):
                state = self.to[state * self.width + c]
                if i >= window - 1:
                    self.items_at[self.home[state]].add(item)
            if 0 < len(ids) < window:
                self.short_at[state][len(ids)].add(item)
        #: For each state, the nearest state on its suffix path, itself included, where a short item ends.
        self.short_link = array("i", bytes(4 * len(self.length) if self.short_at else 0))
        for s in order if self.short_at else ():
            self.short_link[s] = s if s in self.short_at else self.short_link[self.link[s]]

    def _put(self, s: int, c: int, t: int) -> None:
        if s * self.width + c not in self.to:
            if self._first[s] < 0:
                self._first[s] = c
            else:
                self._more.setdefault(s, []).append(c)
        self.to[s * self.width + c] = t

    def _new(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self._first.append(-1)
        return len(self.length) - 1

    def _extend(self, last: int, c: int) -> int:
        to, link, length, width = self.to, self.link, self.length, self.width
        q = to.get(last * width + c)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur, p = self._new(length[last] + 1, 0), last
        while p != -1 and p * width + c not in to:
            self._put(p, c, cur)
            p = link[p]
        if p != -1:
            q = to[p * width + c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        to, link, width = self.to, self.link, self.width
        clone = self._new(self.length[p] + 1, link[q])
        for x in (self._first[q], *self._more.get(q, ())):
            if x >= 0:
                self._put(clone, x, to[q * width + x])
        link[q] = clone
        while p != -1 and to.get(p * width + c) == q:
            to[p * width + c] = clone
            p = link[p]
        return clone

    def scan(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Maximal spans of hit words, as (start, end), and the items with a window that occurs."""
        known, to, link, length, window, width = self.code.get, self.to.get, self.link, self.length, self.window, self.width
        spans: list[tuple[int, int]] = []
        homes: set[int] = set()
        found: set[str] = set()
        state = matched = 0
        has_short = bool(self.short_at)
        for i, w in enumerate(text):
            c = known(w)
            if c is None:
                state = matched = 0
                continue
            nxt = to(state * width + c)
            while nxt is None and state:
                state = link[state]
                matched = length[state]
                nxt = to(state * width + c)
            if nxt is None:
                continue
            state = nxt
            matched += 1
            reach = 0
            if matched >= window:
                reach = window
                homes.add(self.home[state])
            if has_short:
                s = self.short_link[state]
                while s > 0:
                    for size, items in self.short_at[s].items():
                        if size <= matched:
                            reach = max(reach, size)
                            found |= items
                    s = self.short_link[link[s]]
            if reach:
                start = i + 1 - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        return spans, found.union(*(self.items_at[h] for h in homes))


_LAST: dict[str, ItemAutomaton] = {}


def _automaton(name: str, items: list[tuple[str, str]], window: int) -> ItemAutomaton:
    """This worker's automaton of a block, built once for all its tasks; only the last block's is held."""
    if name not in _LAST:
        _LAST.clear()
        _LAST[name] = ItemAutomaton(((item, words(text)) for item, text in items), window)
    return _LAST[name]


def _items(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, int]:
    """(item, text, block) of the benchmark, item ids as strings, dealt by hash to blocks of about block_bytes of text; and the number of blocks."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item IS NOT NULL AND text IS NOT NULL").distinct()  # an item that repeats is one item
    n = max(1, -(-int(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    items = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    return (written(items, "benchmark") if n > 1 else items), n


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, names: tuple[str, str, str] = ("n_words", "hit_spans", "hit_items"), finish=None, finished: T.StructType | None = None) -> DataFrame:
    """docs with three more columns: the words of the text, the maximal hit spans in words, the items (as strings) that hit.

    finish, if given, turns the last pass's record batches into those of the schema finished, in the same worker.
    """
    out = T.StructType([*docs.schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField(names[2], T.ArrayType(T.StringType()))])
    at, base, sc = docs.columns.index(text_col), len(docs.columns), docs.sparkSession.sparkContext
    kinds = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())]
    frame = docs
    items, n_blocks = _items(benchmark, item_col, item_text_col, block_bytes)
    for k in range(n_blocks):
        last = finish if k == n_blocks - 1 else None
        # block_bytes of text at most, one block at a time
        shipped, name = sc.broadcast([(r.item, r.text) for r in items.where(F.col("block") == k).select("item", "text").collect()]), uuid.uuid4().hex

        def scan(batches: Iterator[pa.RecordBatch], shipped=shipped, name=name, k=k, last=last) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(name, shipped.value, window)
            for part, texts in texts_in(batches, at):
                counts, spans, items = [], [], []
                for i, text in enumerate(texts):
                    own = words(text)
                    hit, found = automaton.scan(own)
                    if k:  # what earlier blocks found
                        hit = merged([*((x["start"], x["end"]) for x in part.column(base + 1)[i].as_py()), *hit])
                        found = found | {*part.column(base + 2)[i].as_py()}
                    counts.append(len(own))
                    spans.append([{"start": s, "end": e} for s, e in hit])
                    items.append(sorted(found))
                new = [pa.array(x, kind) for x, kind in zip((counts, spans, items), kinds, strict=True)]
                whole = pa.RecordBatch.from_arrays([*part.columns[:base], *new], names=[*part.schema.names[:base], *names])
                yield last(whole) if last else whole

        frame = frame.mapInArrow(scan, finished if last else out)
        if k < n_blocks - 1:
            frame = written(frame, "decontaminated")  # so that a task holds one block's automaton
    return frame


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the characters from each span's first word to its last."""
    places = [m.span() for m in _RAW_WORD.finditer(text)]
    kept, at = [], 0
    for s, e in spans:
        kept.append(text[at : places[s][0]])
        at = places[e - 1][1]
    return "".join([*kept, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", window: int = WINDOW, min_span: int = MIN_SPAN_WORDS, max_coverage: float = MAX_COVERAGE, **more) -> DataFrame:
    """docs, same columns: texts with more than max_coverage of their words hit go, hit spans of min_span words or more are cut out of the rest."""
    names = tuple(fresh(n, docs.columns) for n in ("n_words", "hit_spans", "hit_items"))
    at, base = docs.columns.index(text_col), len(docs.columns)

    def clean(part: pa.RecordBatch) -> pa.RecordBatch:
        keep, out = [], []
        for text, n, spans in zip(*(part.column(k).to_pylist() for k in (at, base, base + 1)), strict=True):
            spans = [(x["start"], x["end"]) for x in spans]
            keep.append(sum(e - s for s, e in spans) <= max_coverage * n)
            long = [x for x in spans if x[1] - x[0] >= min_span]
            out.append(cut(text, long) if long and keep[-1] else text)
        columns = [*part.columns[:base]]
        columns[at] = pa.array(out, part.schema.field(at).type)
        return pa.RecordBatch.from_arrays(columns, names=part.schema.names[:base]).filter(pa.array(keep, pa.bool_()))

    return find_contamination(docs, benchmark, text_col=text_col, window=window, names=names, finish=clean, finished=docs.schema, **more)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's row for each document."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS k FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS said FROM (SELECT item_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM sized)),
sizes AS (SELECT DISTINCT k FROM sized),
places AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS said FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM words, sizes WHERE len(w) >= k)),
hits AS (SELECT p.doc_id, p.i, p.k, x.item_id FROM places p JOIN windows x ON p.k = x.k AND p.said = x.said),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY 1)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items, coalesce(n.items_sha256, sha256('')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN covered c ON w.doc_id = c.doc_id LEFT JOIN named n ON w.doc_id = n.doc_id
"""
