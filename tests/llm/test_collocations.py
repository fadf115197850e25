import random
import re
from collections import Counter

from codexlake.llm import collocations as C


def brute(docs, least=10, top=2000):
    """docs (lang, text) -> rows, with Python's whole numbers."""
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    rows = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        inside = [f[lang, q] for (x, q) in f if x == lang and len(q) == 3 and len(p) == 2 and p in (q[:2], q[1:]) and f[lang, q] >= least]
        if any(100 * b >= 50 * a for b in inside):
            continue
        score, k = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        rows.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    out, ranks = [], Counter()
    for lang, score, a, p, left, right in sorted(rows):
        ranks[lang] += 1
        if ranks[lang] <= top:
            out.append((lang, ranks[lang], p.decode(), -a, left, right, n[lang], -score))
    return out


def texts(seed, size=300):
    r = random.Random(seed)
    words = [*"abcdefg", "New", "york", "é", "zz", "𝒳", "￿", "x\x1fy", "x\x00y", "|"]
    out = [(None, None), ("en", ""), ("en", " .,\t\n"), (None, "a a a a a a a a a a a a a a"), ("", "New York new york")]
    for _ in range(size):
        out.append((r.choice(["en", "en", "fr", None]), "".join(r.choice(words) + r.choice([" ", " ", " ", "\t ", ". ", "\r\n", ", "]) for _ in range(r.randrange(40)))))
    return out


def test_against_brute_force(spark):
    docs = texts(1)
    df = spark.createDataFrame([(t, lang, 1, "x") for lang, t in docs], "text string, lang string, n int, phrase string").repartition(5)
    assert sorted(map(tuple, C.digest(df).collect())) == sorted(brute(docs))
    got = C.collocations(df, least=3, top=7, cells=1 << 10).collect()  # a sketch that is full spares nothing and loses nothing
    assert sorted(map(tuple, got)) == sorted(brute(docs, 3, 7))


def test_candidates_keep_all_that_reach_the_least_count():
    own = [w for lang, t in texts(2) if t for w in (*C._BREAK.join(C.chunks(t)).replace(b",", b" , ").split(), b",")]
    import numpy as np

    for cells in (1 << 8, 1 << 14):
        shard, seen = C.Shard("en", own, 3, cells), np.zeros(cells, int)
        for cell, valid in zip(shard.cells, shard.valid, strict=True):
            np.add.at(seen, cell[valid], 1)
        phrases = shard.candidates(np.packbits(seen >= 10, bitorder="little"))
        count = Counter(b" ".join(own[i : i + k]) for k in (1, 2, 3) for i in range(len(own) - k + 1) if b"," not in own[i : i + k])
        assert len(set(phrases)) == len(phrases) and set(phrases) >= {p for p, n in count.items() if n >= 10}
        assert dict(zip(phrases, C.matches(own, phrases).tolist(), strict=True)) == {p: count[p] for p in phrases}
        assert cells < 1 << 10 or len(phrases) < len(count) / 3


def test_chunks_are_cut_between_pieces_only():
    text = "One two. three\tfour five; six " * 50
    whole = next(C.chunks(text))
    assert C._BREAK.join(C.chunks(text, 64)) == whole and all(len(c) <= 64 for c in C.chunks(text, 64))
    assert [*C.chunks("no break " * 50, 64)] == [b"no break " * 50] and [*C.chunks(None)] == [b""]


def test_counts_beyond_64_bits(spark):
    big = 9 * 10**13
    found = spark.createDataFrame([("en", "a", big), ("en", "b", big), ("en", "c", 20), ("en", "a b", big - 1), ("en", "b c", 12), ("en", "a b c", 11)], "lang string, phrase string, n long")
    got = {r.phrase: (r.l, r.r, r.score) for r in C.scored(found).collect()}
    assert got == {"a b": (big, big, 10**6 * (big - 1) ** 2 // big**2), "a b c": (big, 12, 10**6 * 11 * 11 // (big * 12))}


def test_ranks_over_salted_groups(spark):
    rows = [(lang, f"p {i}", i % 7, i % 5) for lang in ("en", "fr") for i in range(500 if lang == "en" else 3)]
    got = C.first_of(spark.createDataFrame(rows, "lang string, phrase string, score long, a long"), 20)
    want = sorted((r for r in rows if r[0] == "en"), key=lambda r: (-r[2], -r[3], r[1]))[:20]
    assert [(r.phrase, r.rank) for r in sorted(got.where("lang = 'en'").collect(), key=lambda r: r["rank"])] == [(r[1], k + 1) for k, r in enumerate(want)]
    assert got.where("lang = 'fr'").count() == 3


def test_empty_and_long(spark):
    docs = spark.createDataFrame([("a b " * 300_000, "en"), ("a b. " * 300_000, "fr")], "text string, lang string")
    assert C.digest(docs.limit(0)).count() == 0
    got = {(r.lang, r.phrase): (r.a, r.n) for r in C.digest(docs).collect()}
    assert got == {("en", "a b a"): (299_999, 600_000), ("en", "b a b"): (299_999, 600_000), ("fr", "a b"): (300_000, 600_000)}
