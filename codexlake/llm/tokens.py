"""Token-ID output: ids in fixed-size blocks, each block turned into byte or bit planes, each plane compressed.

A piece is one file image: header, planes, chunk index. Pieces are the rows of a Parquet table in the shared folder,
so Spark's commit protocol covers lost executors, and any store that Spark reaches will do. Layout, little-endian:

    "BPS1" | mode u8 (0 byte planes, 1 bit planes) | width u8 (planes of a block) | pad u16 | block u32 | n_ids u64
    planes, block by block, each a zstandard frame
    chunk index: for each block, for each plane: offset u64, size u32
    index offset u64 | "BPSX"

Scale: one range exchange by doc_id and text's hash puts documents in order; everything else is local to a partition. A piece closes at
the first document end past `piece_ids` ids; a document is never split over pieces. Offsets of pieces come from sums
over partitions, and then inside each, never from one pass over all rows.

Defined cases: a null text is empty and gives only the end id; a null doc_id sorts first; documents that share a
doc_id come in order of their text's hash (null first), and equal ones are written as often as they are; a text of any length is one
document of one piece; an empty table gives no pieces; further columns are left aside.
"""

from __future__ import annotations

import os
import struct
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codexlake.llm.common import shared_path, texts_in

BLOCK_IDS, PIECE_IDS, END_ID = 1 << 16, 1 << 18, 2
_HEAD, _ENTRY, _TAIL = struct.Struct("<4sBBHIQ"), struct.Struct("<QI"), struct.Struct("<Q4s")


# -- the file format -------------------------------------------------------------------------------------------------


def _planes(ids: np.ndarray, mode: str, width: int) -> list[bytes]:
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if mode == "byte":
        return [raw[:, k].tobytes() for k in range(width)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(width)]


def _unplanes(planes: list[bytes], mode: str, n: int) -> np.ndarray:
    if mode == "byte":
        raw = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(planes):
            raw[:, k] = np.frombuffer(p, np.uint8)
    else:
        bits = np.zeros((n, 32), np.uint8)
        for k, p in enumerate(planes):
            bits[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
        raw = np.packbits(bits, axis=1, bitorder="little")
    return raw.view("<u4").reshape(-1)


def pack(ids: np.ndarray, mode: str = "byte", block: int = BLOCK_IDS, level: int = 1) -> bytes:
    """The file image of ids. Planes that no id reaches are left out of the whole piece."""
    top = int(ids.max()) if len(ids) else 0
    width = max(1, -(-top.bit_length() // 8) if mode == "byte" else top.bit_length())
    press = zstandard.ZstdCompressor(level=level)
    out, index = [_HEAD.pack(b"BPS1", mode == "bit", width, 0, block, len(ids))], []
    at = _HEAD.size
    for i in range(0, len(ids), block):
        for plane in _planes(ids[i : i + block], mode, width):
            frame = press.compress(plane)
            index.append(_ENTRY.pack(at, len(frame)))
            out.append(frame)
            at += len(frame)
    return b"".join([*out, *index, _TAIL.pack(at, b"BPSX")])


def unpack(image: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids start to stop of a file image; only the blocks that hold them are opened."""
    magic, bit, width, _, block, n = _HEAD.unpack_from(image)
    index_at, end = _TAIL.unpack_from(image, len(image) - _TAIL.size)
    if magic != b"BPS1" or end != b"BPSX":
        raise ValueError("not a piece of plane-shuffled ids")
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, "<u4")
    open_, mode, blocks = zstandard.ZstdDecompressor(), "bit" if bit else "byte", []
    first = start // block
    for b in range(first, -(-stop // block)):
        size = min(block, n - b * block)
        entries = (_ENTRY.unpack_from(image, index_at + (b * width + k) * _ENTRY.size) for k in range(width))
        blocks.append(_unplanes([open_.decompress(image[a : a + s]) for a, s in entries], mode, size))
    return np.concatenate(blocks)[start - first * block : stop - first * block]


# -- encoding --------------------------------------------------------------------------------------------------------


class _Codes(dict):
    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self) + 1
        self.new.append(word)
        return code


_TAIL_MARKS = b".,!?;:*#$%&"


class WordEncoder:
    """encode() of the tokenizer, word by word with caches of bounded size.

    Right for tokenizers that split at white space and between letters and other signs before their model runs, ignore
    case and normalise characters one by one, so that no id spans two words; the tests hold it against the tokenizer's
    own encoding of whole texts. New words are taken apart into stem and closing signs where the stem ends in a letter or
    digit (else the signs belong to the stem's own run of signs). Stems of a-z alone go to the merges straight; stems of other
    letters are encoded many at a time, told apart by the mark that the vocabulary puts on a word's last id.
    """

    def __init__(self, path: str, end_id: int, most_words: int = 1 << 19):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model, self.end_id, self.most = Tokenizer.from_file(path), end_id, most_words
        vocabulary = self.model.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        # words of a-z go to the vocabulary's merges straight, where normaliser and splitter leave such words as they are
        probe, normalizer, splitter = "abcdefghijklmnopqrstuvwxyz", self.model.normalizer, self.model.pre_tokenizer
        self.plain = (not normalizer or normalizer.normalize_str(probe) == probe) and (not splitter or [w for w, _ in splitter.pre_tokenize_str(probe)] == [probe])
        self.forget()

    def forget(self) -> None:
        """Drops the caches; the model stays."""
        self.ids_of: dict[bytes, bytes] = {b"": b""}
        self.older: dict[bytes, bytes] = {}
        self._clear()

    def _clear(self) -> None:
        self.codes = _Codes()
        self.pool, self.starts, self.sizes = np.array([self.end_id], "<u4"), np.array([0]), np.array([1])

    def _splits_after(self, stem: bytes) -> bool:
        """Whether the tokenizer splits between stem and a sign after it: the stem, normalised, ends in a letter or digit."""
        if stem[-1:].isascii():
            return not stem or stem[-1:].isalnum()
        text, normalizer = stem.decode(), self.model.normalizer
        return (normalizer.normalize_str(text) if normalizer else text)[-1:].isalnum()

    def _encode_new(self, parts: list[bytes]) -> None:
        """Enters the parts into ids_of."""
        if self.plain:
            merge, rest, pack = self.model.model.tokenize, [], struct.pack
            for p in parts:
                if p.isalpha() and p.islower():  # a-z alone
                    ids = [t.id for t in merge(p.decode())]
                    self.ids_of[p] = pack(f"<{len(ids)}I", *ids)
                else:
                    rest.append(p)
            parts = rest
        letters = [(p, t) for p in parts if (t := p.decode()).isalpha()]
        others = [p for p in parts if not p.decode().isalpha()]
        for i in range(0, len(letters), 1000):
            some = letters[i : i + 1000]
            ids = np.array(self.model.encode_batch_fast([" ".join(t for _, t in some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(some):
                others += [p for p, _ in some]
                continue
            raw, at = ids.tobytes(), 0
            for (p, _), end in zip(some, (4 * ends).tolist(), strict=True):
                self.ids_of[p] = raw[at:end]
                at = end
        for p, got in zip(others, self.model.encode_batch_fast([p.decode() for p in others], add_special_tokens=False), strict=True):
            self.ids_of[p] = np.array(got.ids, "<u4").tobytes()

    def _learn(self, new: list[bytes]) -> None:
        """Ids of new words, onto the pool."""
        if len(self.ids_of) > self.most:
            self.older, self.ids_of = self.ids_of, {b"": b""}
        parts, need, known, older = [], {}, self.ids_of, self.older
        for w in new:
            low = w if b"<|" in w else w.lower()  # special tokens keep their case
            stem = low.rstrip(_TAIL_MARKS)
            if len(stem) < len(low) and not self._splits_after(stem):
                stem = low
            parts.append(pair := (stem, low[len(stem) :]))
            for p in pair:
                if p not in known:
                    if p in older:
                        known[p] = older[p]
                    else:
                        need[p] = None
        self._encode_new([*need])
        got = [known[a] + known[b] for a, b in parts]
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(got), "<u4")])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's end id included, and the count of ids of each text."""
        if len(self.codes) > self.most:
            self._clear()
        codes, end, n = [], np.zeros(1, np.int64), 0
        ends = np.empty(len(texts), np.int64)
        code = self.codes.__getitem__
        for i, text in enumerate(texts):
            if text:
                own = text.encode().split()
                codes.append(np.fromiter(map(code, own), np.int64, len(own)))
                n += len(own)
            codes.append(end)
            n += 1
            ends[i] = n
        if self.codes.new:
            self._learn(self.codes.new)
            self.codes.new = []
        at = np.concatenate([np.zeros(0, np.int64), *codes])
        sizes = self.sizes[at]
        before = np.cumsum(sizes)
        ids = self.pool[np.repeat(self.starts[at] - before + sizes, sizes) + np.arange(int(before[-1]) if len(at) else 0)]
        total = before[ends - 1] if len(texts) else np.zeros(0, np.int64)
        return ids, np.diff(total, prepend=0)


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, end_id: int) -> WordEncoder:
    """This worker's encoder, loaded once."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = WordEncoder(path, end_id)
    return _ENCODERS[path, end_id]


def write_ids(docs: DataFrame, tokenizer_path: str, *, end_id: int = END_ID, mode: str = "byte", block: int = BLOCK_IDS, piece_ids: int = PIECE_IDS, path: str | None = None) -> DataFrame:
    """Encodes docs (doc_id, text) in ascending doc_id order and writes the pieces; returns them as read back.

    Columns: shard (order of the range), piece (order in the shard), before (ids of the shard before it), doc_ids, doc_sizes, n_ids, image.
    """
    schema = "shard int, piece int, before bigint, doc_ids array<bigint>, doc_sizes array<bigint>, n_ids bigint, image binary"
    kinds = pa.schema([("shard", pa.int32()), ("piece", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_sizes", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("image", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shard, piece = encoder(tokenizer_path, end_id), TaskContext.get().partitionId(), 0
        names, sizes, held, count, before = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(held)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((shard, piece, before, names, sizes, len(ids), pack(ids, mode, block)), kinds.types, strict=True)], schema=kinds)

        for part, texts in texts_in(batches, 1, 1 << 20):
            ids, n = words.encode(texts)
            at = done = 0
            for k, doc in enumerate(part.column(0).to_pylist()):
                names.append(doc)
                sizes.append(int(n[k]))
                at += int(n[k])
                if count + at - done >= piece_ids:
                    held.append(ids[done:at])
                    yield close()
                    before += sum(sizes)
                    names, sizes, held, count, done, piece = [], [], [], 0, at, piece + 1
            held.append(ids[done:at])
            count += at - done
        words.forget()
        if names:
            yield close()

    spark = docs.sparkSession
    path = path or shared_path(spark, "token-ids")
    # the text's hash takes part, so that many rows of one doc_id fall into several ranges
    keyed = docs.select("doc_id", "text", F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("text_key"))
    ordered = keyed.repartitionByRange("doc_id", "text_key").sortWithinPartitions("doc_id", "text_key", "text")
    ordered.select("doc_id", "text").mapInArrow(encode, schema).write.option("compression", "none").parquet(path)
    return spark.read.schema(schema).parquet(path)


def with_start(pieces: DataFrame) -> DataFrame:
    """pieces and the count of ids before each. A shard's own count is in its pieces; what comes before a shard is summed over shards.

    There are as many shards as partitions wrote pieces, which bounds what is broadcast; the images stay where they are.
    """
    shards = pieces.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = shards.select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    return pieces.join(F.broadcast(shards), "shard").withColumn("start", F.col("base") + F.col("before")).drop("base")


def read_ids(pieces: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the file images."""
    kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                names, sizes, image, start = (batch.column(k)[row] for k in range(4))
                sizes = sizes.values.to_numpy(zero_copy_only=False)
                ids, ends = unpack(image.as_py()), np.cumsum(sizes)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([names.values, pa.array(start.as_py() + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], schema=kinds)

    return with_start(pieces).select("doc_ids", "doc_sizes", "image", "start").mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_output(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    return read_ids(write_ids(docs, tokenizer_path))
