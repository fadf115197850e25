import hashlib
import random
import re

import numpy as np

from codexlake.llm import substring as S


def brute(rows, window):
    own = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (doc, _), w in zip(rows, own, strict=True):
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            least[key] = min(least.get(key, doc), doc)
    out = {}
    for (doc, text), w in zip(rows, own, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < doc:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.setdefault(doc, []).append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


def rows(seed, n, window):
    r = random.Random(seed)
    say = lambda k: [r.choice(["a", "b", "Ünï", "c\x1cd", "e　f", "g", "hh", "i", "jj"]) for _ in range(k)]
    shared = [say(r.randrange(window - 3, 4 * window)) for _ in range(6)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(r.randrange(4)):
            p = list(r.choice(shared))
            if r.random() < 0.4:
                p[r.randrange(len(p))] = f"edit{r.randrange(3)}"
            if r.random() < 0.3:
                p = p[r.randrange(len(p)) :]
            parts += p + say(r.randrange(30))
        out.append((i, r.choice([" ", "\n", "\t\x0b"]).join(parts)))
    out += [(n, None), (n + 1, ""), (n + 2, "aa " * 300), (n + 3, "x " + "aa " * 100), (n + 4, " ".join(shared[0][: window - 1])), (-7, " ".join(shared[1]))]
    out += [(d, out[(5 * d + 3) % n][1]) for d in r.sample(range(n), n // 4)]  # ids again, with other texts
    r.shuffle(out)
    return out


def test_anchor_runs():
    t = [[b"w%d" % (i % 7) for i in range(40)], [], [b"x"] * 12, [b"short"], [b"w%d" % (i % 7) for i in range(5, 33)]]
    text, start, count, anchor, run = S.anchor_runs(t, 12, 4)
    for k, w in enumerate(t):
        assert count[text == k].sum() == max(0, len(w) - 11)
    by = {}
    for k, s, c, a in zip(text, start, count, anchor, strict=True):
        for i in range(c):
            assert by.setdefault(tuple(t[k][s + i : s + i + 12]), a) == a  # the anchor follows from the window


def test_against_brute_force(spark):
    for seed, window, k, hot, shard in ((1, 50, 8, 128, 1 << 19), (2, 12, 4, 2, 200), (3, 12, 4, 0, 1), (4, 5, 8, 5, 1000)):
        data = rows(seed, 60, window)
        docs = spark.createDataFrame([(*x, 1) for x in data], "doc_id long, text string, n_words int").repartition(5)
        got = {}
        for x in S._applied(docs, True, window=window, k=k, hot_runs=hot, shard_words=shard).collect():
            got.setdefault(x.doc_id, []).append(tuple(x)[1:])
        assert {k: sorted(v) for k, v in got.items()} == brute(data, window), seed


def test_hot_anchors_meet_in_the_index(spark):
    """Passages of a hot anchor are found as parts of other passages at the longer anchor, not by their own hash alone."""
    r = random.Random(3)
    common = [f"c{i}" for i in range(8)]
    tails = [[f"t{k}x{i}" for i in range(60)] for k in range(5)]
    data = []
    for i in range(40):
        tail = tails[i % 5]
        data.append((i, " ".join([f"u{i}", *common, *tail[: 45 + i % 9], f"v{i}", *(f"{r.random()}" for _ in range(5))])))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = {x.doc_id: tuple(x)[1:] for x in S._applied(docs, True, window=20, k=3, hot_runs=3, shard_words=500).collect()}
    assert {k: [v] for k, v in got.items()} == brute(data, 20)
    longer = S.reanchored(spark.createDataFrame([(1, 2, 3, 4, " ".join(["w", *common, *tails[0]]))], "key long, run long, doc_id long, high long, passage string"), 20, 12).collect()
    assert any(len(x.passage.split()) > 20 for x in longer) and all((x.of, x.of_run, x.doc_id, x.high) == (1, 2, 3, 4) for x in longer)
    assert sorted(x.at + i for x in longer for i in range(len(x.passage.split()) - 19)) == list(range(69 - 19))


def test_long_text_and_repeated_ids(spark):
    """A text of 100,000 words; a row that repeats a doc_id with another text loses its own words only."""
    r = random.Random(8)
    shared = " ".join(f"s{i}" for i in range(60))
    other = " ".join(f"o{i}" for i in range(80))
    long = " ".join([*(str(r.random()) for _ in range(50_000)), shared, *(str(r.random()) for _ in range(50_000))])
    docs = spark.createDataFrame([(1, shared), (2, other), (2, shared), (3, long), (3, shared)], "doc_id long, text string")
    got = sorted((x.doc_id, x.n_words, x.n_removed) for x in S.digest(docs).collect())
    assert got == [(1, 60, 0), (2, 60, 60), (2, 80, 0), (3, 60, 60), (3, 100_060, 60)]


def test_repeats_nulls_empty(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(None, passage), (4, passage), (4, passage), (6, f"x {passage} y"), (9, None)], "doc_id long, text string")
    got = sorted(((x.doc_id is None, x.doc_id, x.n_words, x.n_removed, x.kept) for x in S.without_repeats(docs).collect()), key=str)
    assert got == [(False, 4, 60, 0, passage), (False, 4, 60, 0, passage), (False, 6, 62, 60, "x y"), (False, 9, 0, 0, ""), (True, None, 60, 0, passage)]
    assert S.digest(docs.limit(0)).count() == 0
    assert np.array_equal(S.anchor_runs([])[0], np.zeros(0))
