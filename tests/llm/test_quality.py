import random
import re

import numpy as np
from pyspark.sql import functions as F

from codexlake.llm import quality as Q


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, cover = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            cover.update(j for i in at for j in range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len({*lines}), len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)


def texts():
    r = random.Random(1)
    out = [None, "", " \n\x0b ", "a b c d e f g h " * 40, "x y z　w " * 15, "l1 a\nl1 a\n\n \nl1 a \n" * 3, "é€😀 #*|<> " * 30, "w " * 5000]
    return out + [r.choice(" \n\t").join(r.choice(["a", "bb", "ccc", "d$"]) for _ in range(r.randrange(300))) for _ in range(60)] + [" ".join(str(r.random()) for _ in range(100)) + " and then this is said once more " * 2]


def test_counts(spark):
    rows = [(i, t, 1) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = Q.digest(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(rows[r.doc_id][1])
        assert tuple(r)[1:7] == want and r.kept == (not want[5]), rows[r.doc_id][1]


def test_learned_list(spark):
    r = random.Random(2)
    good = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8))) for _ in range(80))
    bad = lambda: " ".join(w + r.choice(["", "$$", "%%%"]) for w in good().split())
    rows = [(i, bad() if i % 5 == 0 else good()) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 300)] + [(7, None, 0), (None, 0, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    kept = {x.doc_id for x in Q.keep_good(docs, labels).collect()}
    assert len({i for i in kept if i % 5 == 0}) <= 3 and len({i for i in kept if i % 5}) == 400
    assert Q.keep_good(docs.limit(0), labels).count() == 0


def test_no_rule_without_precision():
    x = {"a": np.arange(200.0)}
    bad = np.arange(200) % 2 == 0
    assert Q.learn(x, bad, np.arange(200) % 3 > 0) == []


def test_names_clash(spark):
    docs = spark.createDataFrame([(1, "a " * 30, 5, "k")], "doc_id long, text string, n_words int, Kept string")
    out, name = Q.judge(docs, spark.createDataFrame([], "doc_id long, quality int"))
    r = out.first()
    assert r.n_words == 5 and r.Kept == "k" and r[name["n_words"]] == 30 and name["kept"] == "_kept"
    assert out.where(F.col(name["kept"])).count() == 0


def test_list_against_brute_force(spark):
    """The first term of each list is the best of all cuts by FOIL gain; all rules are precise on what earlier ones leave; Spark's verdict is a plain reading of the list."""
    for seed in range(4):
        r = np.random.default_rng(seed)
        n = 400
        x = {"a": r.normal(size=n), "b": r.integers(0, 9, n).astype(float), "c": r.normal(size=n)}
        bad = (x["a"] > 0.8) | ((x["b"] <= 2) & (x["c"] < -0.5))
        part = np.arange(n) % 3 > 0
        rules = Q.learn(x, bad, part)
        assert rules
        best = 0.0
        for f, v in x.items():
            for t in {float(q) for m in (bad, ~bad) for q in np.quantile(v[m], np.linspace(0, 1, Q.CUTS + 1))}:
                for hit in ([z >= t for z in v], [z <= t for z in v]):
                    p = sum(h and b and k for h, b, k in zip(hit, bad, part, strict=True))
                    q = sum(h and not b and k for h, b, k in zip(hit, bad, part, strict=True))
                    p0, n0 = int((bad & part).sum()), int((~bad & part).sum())
                    if p:
                        best = max(best, p * (np.log2(p / (p + q)) - np.log2(p0 / (p0 + n0))))
        f, op, t = rules[0][0]
        hit = (x[f] >= t if op == ">=" else x[f] <= t) & part
        p, q = int((hit & bad).sum()), int((hit & ~bad).sum())
        assert np.isclose(p * (np.log2(p / (p + q)) - np.log2((bad & part).sum() / part.sum())), best)
        left, want = [True] * n, [0] * n
        for k, rule in enumerate(rules, 1):
            took = [i for i in range(n) if left[i] and all(x[f][i] >= t if op == ">=" else x[f][i] <= t for f, op, t in rule)]
            assert sum(bad[i] for i in took) >= max(Q.MIN_COVER, Q.MIN_PRECISION * len(took))
            for i in took:
                left[i], want[i] = False, k
        rows = spark.createDataFrame([(i, *(float(x[f][i]) for f in "abc")) for i in range(n)], "i int, a double, b double, c double")
        assert [v.v for v in rows.select("i", Q.verdict(rules, {f: F.col(f) for f in "abc"}).alias("v")).orderBy("i").collect()] == want


def test_repeated_ids_teach_once(spark):
    """A labelled doc_id that many rows repeat teaches one row, whichever partitions they are in."""
    docs = [(i % 40, " ".join(f"w{(i * 7 + k) % 1000}{'$' * (i % 2)}" for k in range(60))) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(40)], "doc_id long, quality int")
    lists = [Q.fit(spark.createDataFrame(docs, "doc_id long, text string").repartition(n), labels, max_labelled=30) for n in (1, 5)]
    assert lists[0] == lists[1] and lists[0]
