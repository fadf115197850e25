from fractions import Fraction

import numpy as np
import pytest

from codexlake.llm import whitening as W


def test_symmetric_qr():
    r = np.random.default_rng(1)
    for d in (1, 2, 3, 8, 40):
        for a in (r.normal(size=(d, d)), np.eye(d), np.zeros((d, d)), np.diag(np.arange(d, 0.0, -1)), np.ones((d, d)), np.outer(r.normal(size=d), np.ones(d))):
            a = a + a.T
            values, vectors = W.symmetric_qr(a)
            assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * max(1, np.abs(a).max() * d))
            assert np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-12) and np.allclose(a @ vectors, vectors * values, atol=1e-11 * max(1, np.abs(a).max() * d))


def test_merged_states_equal_one_stream():
    m = np.random.default_rng(2).normal(1e6, 3, (500, 6))
    one, parts = W.Welford(6), W.Welford(6)
    for x in m:
        one.add(x)
    for k in range(0, 500, 37):
        part = W.Welford(6)
        for x in m[k : k + 37]:
            part.add(x)
        parts.merge(W.Welford.from_bytes(6, part.to_bytes()))
    want = np.cov(m.T, bias=True)
    assert parts.n == one.n == 500 and np.allclose(one.covariance(), want, rtol=1e-9) and np.allclose(parts.covariance(), want, rtol=1e-9)
    parts.merge(W.Welford(6))
    assert parts.n == 500


def brute(rows):
    """rows (vec_id, x vector): n, S, covariance by whole numbers and fractions."""
    fit = sorted({tuple(x) for _, x in rows})
    n, d = len(fit), len(fit[0])
    sums = [sum(v[k] for v in fit) for k in range(d)]
    cov = np.array([[float(Fraction(sum((n * v[i] - sums[i]) * (n * v[j] - sums[j]) for v in fit), n**3)) for j in range(d)] for i in range(d)])
    return n, sums, cov


def check(got, rows):
    n, sums, cov = brute(rows)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(4, len(sums))
    assert len(got) == k * len(rows)
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    for c, own in by.items():
        want = sorted((v, sum((n * x - s) ** 2 for x, s in zip(xs, sums, strict=True)), sum((x - s / n) * float(w) for x, s, w in zip(xs, sums, vectors[:, c - 1], strict=True)) / values[c - 1] ** 0.5) for v, xs in rows)
        mine = sorted((r.vec_id, r.deviation, r.whitened) for r in own)
        assert [m[:2] for m in mine] == [w[:2] for w in want]
        a, b = np.array([m[2] for m in mine]), np.array([w[2] for w in want])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6
        assert all(r.n == n and r.explained == pytest.approx(values[c - 1] / values.sum(), rel=1e-9) and r.identity_error < 1e-9 and r.deviation_exact == r.deviation for r in own)


def test_against_fractions(spark):
    r = np.random.default_rng(3)
    m = (r.normal(size=(200, 6)) * [3, 2, 1.3, 0.7, 0.4, 0.1]).astype(np.float32)
    rows = [(i, m[i % 150].tolist()) for i in range(200)]  # 50 copies
    bad = [(900, None), (901, [None, 1.0]), (902, [float("nan")] * 6), (903, [float("inf"), 0.0]), (904, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + bad], "vec_id long, embedding array<float>, n int, x int").repartition(50)
    got = W.digest(df).collect()
    check(got, [(i, [int(np.floor(np.float64(c) * 256)) for c in v]) for i, v in rows])


def test_real_table(spark):
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(i, [int(np.floor(np.float64(np.float32(c)) * 256)) for c in v[:8]]) for i, v in zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist(), strict=True)]
    df = spark.createDataFrame([(i, v[:8]) for i, v in zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist(), strict=True)], "vec_id long, embedding array<float>")
    check(W.digest(df).collect(), rows)


def test_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert W.digest(make([(1, None)])).count() == 0 and W.digest(make([(1, [1.0])]).limit(0)).count() == 0
    one = W.digest(make([(1, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert {(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(v, c, 1, 0, None, 0.0, None) for v in (1, None) for c in (1, 2)}
    flat = W.digest(make([(i, [float(i), 7.0, 2.0 * i]) for i in range(9)])).collect()
    assert {(r.component, r.whitened is None) for r in flat} == {(1, False), (2, True), (3, True)} and max(r.identity_error for r in flat) < 1e-9
    both = W.digest(make([(i, [float(i), float(i * i % 5)]) for i in range(9)] + [(100 + i, [float(i * i)]) for i in range(6)])).collect()
    assert {(r.vec_id >= 100, r.n, r.component) for r in both} == {(False, 9, 1), (False, 9, 2), (True, 6, 1)}
    far = W.digest(make([(i, [1e15 * i, 1.0 + i % 2]) for i in range(5)])).collect()
    assert all(r.deviation is None or r.deviation == r.deviation_exact for r in far) and any(r.deviation is None for r in far)
    exact = {r.vec_id: int(r.deviation_exact) for r in far}
    xs = {i: (int(np.floor(256 * 1e15 * i)), 256 * (1 + i % 2)) for i in range(5)}
    sums = [sum(x[k] for x in xs.values()) for k in (0, 1)]
    assert exact == {i: sum((5 * x[k] - sums[k]) ** 2 for k in (0, 1)) for i, x in xs.items()}
