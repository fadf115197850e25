"""Each stage of the pipeline on its own input, against plain Python."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from codexlake.llm import mixing

from .test_decontaminate import brute as brute_hits
from .test_quality import brute as brute_quality
from .test_simhash import brute_classes, brute_print


def fixture(spark, tmp_path):
    r = random.Random(8)
    say = lambda n: " ".join("".join(r.choice("abcdefghijk") for _ in range(r.randrange(2, 9))) for _ in range(n))
    items = [(k, say(14)) for k in range(3)]
    rows = [(i, say(60), "en", f"src{i % 3 % 2}", 1) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "src0", 1) for i in range(5)]  # copies
    rows += [(200 + i, f"{say(40)}, {items[i][1].upper()}! {say(30)}", "en", "src1", 1) for i in range(3)]  # passages
    rows += [(300, items[0][1] + " " + say(8), "en", "src1", 1), (301, "short", "en", "src1", 1), (302, None, None, None, None), (303, "again and again we say it so " * 20, "en", "src0", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return items


def test_stages(spark, tmp_path):
    items = fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = [docs.collect()]
    for _, stage in P.STAGES:
        out = stage(spark, docs, str(tmp_path))
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen.append(docs.collect())
    for k in range(1, 5):
        assert seen[k][0].asDict().keys() == seen[0][0].asDict().keys()
    assert {x.doc_id for x in seen[1]} == {x.doc_id for x in seen[0] if not brute_quality(x.text)[-1]}
    prints = [(x.doc_id, brute_print(x.text)) for x in seen[1]]
    names = brute_classes(prints)
    assert sorted(x.doc_id for x in seen[2]) == sorted({*names.values()}) and not {x.doc_id for x in seen[2]} & set(range(100, 105))
    texts = {x.doc_id: x.text for x in seen[3]}
    for x in seen[2]:
        n, hit, _ = brute_hits(x.text, items)
        assert (x.doc_id in texts) == (2 * hit <= n)
        if x.doc_id in texts:
            assert brute_hits(texts[x.doc_id], items)[:2] == (n - hit, 0) and (hit or texts[x.doc_id] == x.text)
    assert 300 not in texts and {200, 201, 202} <= set(texts)
    copies = {x.doc_id: x.copies for x in mixing.digest(spark.createDataFrame(seen[3])).collect()}
    assert sorted(x.doc_id for x in seen[4]) == sorted(d for d, c in copies.items() for _ in range(c))
    t, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    for x, g in zip(sorted(seen[4], key=lambda x: (x.doc_id, x.text)), sorted(seen[5], key=lambda x: x.start), strict=True):
        ids = [*t.encode(x.text or "", add_special_tokens=False).ids, 2]
        assert tuple(g) == (x.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_run(spark, tmp_path):
    fixture(spark, tmp_path)
    got = P.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 40
