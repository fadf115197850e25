"""Exact near copies against plain Python's sets of shingles."""

import random
import re

import pytest
from pyspark.sql import functions as F

from codexlake.llm import near_copies as N
from codexlake.llm import simhash as S

from .test_simhash import brute_print


def brute_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_groups(keys, linked):
    root = {k: k for k in keys}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if top(a) != top(b) and linked(a, b):
                root[max(top(a), top(b))] = min(top(a), top(b))
    return {k: top(k) for k in keys}


def corpus(r):
    word = lambda: r.choice(["Ah", "oh", "é"]) + str(r.randrange(3000))
    say = lambda n: [word() for _ in range(n)]
    passages = [say(30) for _ in range(3)]
    texts = [say(r.choice([1, 3, 5, 6, 20, 80, 200])) for _ in range(40)]
    texts += [say(20) + r.choice(passages) + say(r.choice([0, 5, 30])) for _ in range(60)]  # shared passages
    texts += [sum(r.sample(passages, r.choice([1, 2, 3])), []) + say(r.randrange(3)) for _ in range(30)]  # hardly anything else
    for _ in range(120):  # near copies, and copies of those
        t = list(r.choice(texts))
        for _ in range(r.choice([1, 1, 2, 4])):
            at = r.randrange(len(t) + 1)
            t[at : at + r.choice([0, 1])] = say(r.choice([0, 1]))
        texts.append(t)
    base = say(100)
    texts += [base[:k] + say(1) + base[k + 1 :] for k in range(0, 100, 2)]  # a large group
    return list(dict.fromkeys(" ".join(t) for t in texts)) + ["", " \n"]


def test_shingles():
    r = random.Random(1)
    for n in (0, 1, 4, 5, 6, 300):
        a = " ".join(r.choice("aBc") + "\x1f" for _ in range(n))
        assert len(N.shingles(a)) == len(brute_set(a)) and (N.shingles(a.lower()) == N.shingles(a)).all()
    assert len(N.shingles(None)) == 0
    for n in range(1, 400):  # what is left outside the prefix cannot reach the similarity
        assert 100 * (n - N.prefix_length(n)) < 80 * n <= 100 * (n - N.prefix_length(n) + 1)


@pytest.mark.parametrize(("hot", "leads", "seed"), [(16, 2, 1), (2, 1, 2), (0, 0, 3)])
def test_classes_are_those_of_brute_force(spark, hot, leads, seed):
    texts = corpus(random.Random(seed))
    sets = [brute_set(t) for t in texts]
    sizes = [len(s) for s in sets]
    alike = lambda a, b: bool(sizes[a]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    want = brute_groups(list(range(len(texts))), alike)
    assert len({*want.values()}) < len(texts) - 50
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "key long, text string")
    got = {x["key"]: x["class"] for x in N.merged(df, df.select("key", F.col("key").alias("class")), hot=hot, leads=leads).collect()}
    assert got == want


def test_given_classes_stay_together(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(80)) for c in "ab")
    df = spark.createDataFrame([(1, a), (2, b), (3, a + " more"), (4, b + " more"), (5, None), (6, "")], "key long, text string")
    own = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6)], "key long, class long")
    assert {x["key"]: x["class"] for x in N.merged(df, own).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6}
    assert N.merged(df.limit(0), own.limit(0)).count() == 0


def test_one_document_of_each_group(spark):
    """Groups of both kinds of links, hot copies, a passage that all texts share, null ids and clashing columns."""
    texts = corpus(random.Random(4))
    r = random.Random(5)
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000 + k, texts[0]) for k in range(300)] + [(2000 + k, r.choice(texts)) for k in range(20)]
    sets, prints = {t: brute_set(t) for t in texts}, {t: brute_print(t) for t in texts}
    first = {}
    for d, t in sorted(rows):
        first.setdefault(t, d)
    of = {d: t for t, d in first.items()}

    def linked(a, b):
        x, y = sets[of[a]], sets[of[b]]
        return (prints[of[a]] ^ prints[of[b]]).bit_count() <= 3 or bool(x and y) and 100 * len(x & y) >= 80 * len(x | y)

    want = {*brute_groups(sorted(of), linked).values()}
    docs = spark.createDataFrame([(d, t, 1, "x", 2, 3) for d, t in [*rows, (None, "x y")]], "doc_id long, text string, key int, class string, token int, n int")
    got = S.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((x.doc_id for x in got.where("doc_id IS NOT NULL").collect())) == sorted(want)
