"""The registered queries over whole small tables: against their SQL, or against brute force where there is none."""

import hashlib
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from codexlake.llm import queries as Q

from .test_quality import brute as brute_quality
from .test_secrets import S
from .test_secrets import brute as brute_secrets
from .test_simhash import brute_classes, brute_print

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def docs():
    t = pq.read_table(f"{DATA}/documents.parquet")
    return sorted(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


def result(spark, name):
    return {r.doc_id: r for r in Q.queries()[name](spark, DATA).collect()}


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = c.sql(Q.oracle_sql()[name])
    got = Q.queries()[name](spark, DATA).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)


def test_simhash(spark, docs):
    got = result(spark, "op2_simhash")
    prints = [(d, brute_print(t)) for d, t in docs]
    classes = brute_classes(prints)
    assert {d: (r.fingerprint, r.component_id) for d, r in got.items()} == {d: (f"{f:016x}", classes[k]) for k, (d, f) in enumerate(prints)}


def test_tokens(spark, docs):
    got, t, at = result(spark, "op3_token_planes"), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    for d, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert tuple(got[d]) == (d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_secrets(spark, docs):
    got = result(spark, "op6_secret_scan")
    for d, text in docs:
        want = brute_secrets(text)
        assert got[d].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert [got[d][f"n_{k}"] for k in S.BASE] == [sum(x[0] == k for x in want) for k in S.BASE]


def test_quality(spark, docs):
    got = result(spark, "op7_quality_rules")
    for d, text in docs:
        want = brute_quality(text)
        assert tuple(got[d])[1:7] == want and not (got[d].kept and want[-1])


def test_shards(spark, docs):
    got, load, slots = result(spark, "op8_best_fit_shards"), Counter(), defaultdict(list)
    for d, text in docs:
        raw, r = (text or "").encode(), got[d]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None) and 0 <= r.shard < 24
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == [*range(len(s))] for s in slots.values())


def test_mixture_covers_all(spark, docs):
    got = result(spark, "op5_temperature_mix")
    assert set(got) == {d for d, _ in docs} and all(r.tokens == len((t or "").encode().split()) for (d, t), r in zip(docs, (got[d] for d, _ in docs), strict=True))
