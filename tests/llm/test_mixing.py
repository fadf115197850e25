import math
import random
from collections import Counter

import pytest

from codexlake.llm import mixing as M


def brute_exponent(tokens, budget, target, most):
    def at(a):
        w = [t**a for t in tokens]
        p = [x / sum(w) for x in w]
        return -sum(x * math.log(x) for x in p), max(x * budget / t for x, t in zip(p, tokens, strict=True))

    goal = at(1)[0] + target * (at(0)[0] - at(1)[0])
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        h, r = at(mid)
        low, high = (low, mid) if h <= goal and r <= most else (mid, high)
    return high


@pytest.mark.parametrize(("target", "most"), [(0.5, 4.0), (1.0, 1.5), (0.0, 4.0), (0.9, 100.0)])
def test_exponent(spark, target, most):
    tokens = [100_000, 40_000, 3000, 500, 500]
    df = spark.createDataFrame([(t,) for t in tokens], "tokens long")
    assert M.exponent(df, sum(tokens), target, most) == pytest.approx(brute_exponent(tokens, sum(tokens), target, most), abs=1e-6)


def test_weights_are_realised(spark):
    r = random.Random(3)
    sizes = {"hot": 1500, "mid": 500, "small": 60, None: 40}
    rows = [(f"{s}{i}", " ".join("w" for _ in range(r.randrange(1, 40))), s) for s, n in sizes.items() for i in range(n)]
    rows = [(k, t, s, 1) for k, (_, t, s) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int").repartition(5)
    out, name = M.with_copies(docs)
    got = out.collect()
    assert len(got) == len(rows) and name["copies"] == "_copies"
    total, mixed = Counter(), Counter()
    for x in got:
        total[x.source] += x.tokens
        mixed[x.source] += x.tokens * x._copies
    budget = sum(total.values())
    a = brute_exponent(list(total.values()), budget, 0.5, 4.0)
    z = sum(t**a for t in total.values())
    for s, t in total.items():
        assert abs(mixed[s] - budget * t**a / z) <= 41, s  # a document at most
        assert {x._copies for x in got if x.source == s} <= {int(budget * t**a / z / t) + k for k in (0, 1)}
    again = Counter(x.doc_id for x in M.mix(docs).collect())
    assert again == {x.doc_id: x._copies for x in got if x._copies}


def test_empty_and_null(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (None, "x y", None), (3, "z", "b"), (3, "z", "b")], "doc_id long, text string, source string")
    got = {(x.doc_id, x.source): x.copies for x in M.digest(docs).collect()}
    assert got[1, "a"] == got[2, "a"] == 1 and len(got) == 4
    assert M.digest(docs.where("source = 'a'")).count() == 2
    assert M.digest(docs.limit(0)).count() == 0


def test_digest_is_the_operators_result(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 17), f"s{i % 3 if i % 4 else 0}") for i in range(300)] + [(300, "long " * 200_000, "s1")], "doc_id long, text string, source string")
    out, name = M.with_copies(docs)
    assert sorted(map(tuple, M.digest(docs).collect())) == sorted(map(tuple, out.select("doc_id", "source", name["tokens"], name["copies"]).collect()))
