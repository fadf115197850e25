import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from codexlake.llm import tokens as K

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Hello  World's\tBIG\x0btest\x1cfoo bar　baz", "", None, "éÉ é Σας ΣΣ İ", "a<|endoftext|>b <|startoftext|>", "x" * 3000, "12 34.5 %%% $$ don't I'LL\n\n\nend", "日本語 テキスト", " lead and trail \r\n", "a<|ENDOFTEXT|>b word.,! word!! Wörd?! '.' it's. ...", "ﬁ e\u0301 E\u0301. \u1100\u1161 ǅ ªº x\u0301y,", "don 't we 're 'S"]


def test_format_round_trip():
    r = np.random.default_rng(1)
    for mode in ("byte", "bit"):
        for n, top in ((0, 1), (1, 1), (100, 3), (65536, 50000), (200001, 1 << 31)):
            ids = r.integers(0, top, n).astype("<u4")
            image = K.pack(ids, mode, 1 << 12)
            assert np.array_equal(K.unpack(image), ids)
            assert np.array_equal(K.unpack(image, n // 3, n // 2), ids[n // 3 : n // 2])


def test_against_tokenizer(spark):
    t = Tokenizer.from_file(PATH)
    r = random.Random(2)
    rows = [(i, TEXTS[i % len(TEXTS)] if i % 3 else " ".join(r.choice("the Theory of, Ünder gr33n's".split(" ")) for _ in range(r.randrange(400)))) for i in range(120)]
    r.shuffle(rows)
    docs = spark.createDataFrame([(*x, "e") for x in rows], "doc_id long, text string, start string").repartition(5)
    got = K.read_ids(K.write_ids(docs, PATH, piece_ids=700, block=128, mode="bit")).orderBy("doc_id").collect()
    at = 0
    for (doc, text), g in zip(sorted(rows, key=lambda x: x[0]), got, strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert tuple(g) == (doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), text
        at += len(ids)


def test_signs_before_closing_signs():
    t, words = Tokenizer.from_file(PATH), K.WordEncoder(PATH, 2)
    for w in ["(foo).", '"foo",', "foo),", "foo'.", '"foo".', "[1],", "f();", "foo-.", "(1).", "x\u0301.", "q\u0301.", "İ.", "\u0958!", "²,", "日本）。.", "«é».", "a<|endoftext|>.", "it's.", "'s.", "foo_,", "'.", "½."]:
        ids, n = words.encode([w])
        want = [*t.encode(w, add_special_tokens=False).ids, 2]
        assert (ids.tolist(), n.tolist()) == (want, [len(want)]), w


def test_nulls_repeats_empty(spark):
    docs = spark.createDataFrame([(None, "a"), (1, "b b"), (1, "b b"), (1, None)], "doc_id long, text string")
    got = K.token_output(docs, PATH).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 2), (1, 2, 1), (1, 3, 3), (1, 6, 3)]
    assert K.token_output(docs.limit(0), PATH).count() == 0


def test_repeated_ids_and_random_signs(spark):
    """Many texts under one doc_id, signs, marks and emoji; against the tokenizer's own encoding."""
    r = random.Random(11)
    letters = "abcXYZ019 .,!?;:*#$%&()[]{}\"'`~^_-+=/\\|<>@ \n\t éßÅİ😀👩‍👩‍👧中文字ア‍́²½Ⅷ٣\u0085\x1cſﬁǅ’“”…—"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(1, 40))) for _ in range(3000)] + ["(foo).", '"foo",', "f();", "x </w>. y", None, ""] + ["long word, " * 50_000]
    rows = [(r.randrange(3), t) for t in texts]
    got = K.token_output(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), PATH).collect()
    model = Tokenizer.from_file(PATH)
    want = {}
    for (d, _), e in zip(rows, model.encode_batch_fast([t or "" for _, t in rows], add_special_tokens=False), strict=True):
        ids = np.array([*e.ids, 2], "<u4")
        want.setdefault(d, []).append((len(ids), zlib.crc32(ids.tobytes())))
    have = {}
    for x in got:
        have.setdefault(x.doc_id, []).append((x.n_tokens, x.ids_crc32))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    ordered = sorted(got, key=lambda x: x.start)
    assert [x.doc_id for x in ordered] == sorted(d for d, _ in rows) and [x.start for x in ordered] == list(np.cumsum([0, *(x.n_tokens for x in ordered)])[:-1])
