import numpy as np

from codexlake.llm import embedding_dedup as E


def brute(rows, cosine=0.9):
    """rows (vec_id, vector) -> (vec_id, n_links, component) of each, by all pairs."""
    ok = [i for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)]
    link = {i: [] for i in range(len(rows))}
    for d in {len(rows[i][1]) for i in ok}:
        own = [i for i in ok if len(rows[i][1]) == d]
        x = np.array([rows[i][1] for i in own], np.float64)
        s = (x @ x.T) / np.sqrt((x * x).sum(1)[:, None] * (x * x).sum(1)[None, :])
        for p, q in zip(*np.nonzero(s >= cosine), strict=True):
            if p != q:
                link[own[p]].append(own[q])
    out, seen = {}, set()
    for i in link:
        if i in seen:
            continue
        queue, group = [i], {i}
        while queue:
            for k in link[queue.pop()]:
                if k not in group:
                    group.add(k)
                    queue.append(k)
        seen |= group
        out |= dict.fromkeys(group, min((rows[k][0] for k in group if rows[k][0] is not None), default=None))
    return [(rows[i][0], len(link[i]), out[i]) for i in range(len(rows))]


def near(r, v, cosine):
    """A unit vector at exactly this cosine of unit v."""
    w = r.normal(size=len(v))
    w -= (w @ v) * v
    return cosine * v + (1 - cosine**2) ** 0.5 * w / np.linalg.norm(w)


def planted(seed, n=900, d=24):
    r = np.random.default_rng(seed)
    base = E.unit(r.normal(size=(n, d)))
    rows = [*base]
    for k in range(150):
        rows += [near(r, base[k], c) for c in (0.905, 0.93, 0.97, 0.999)]
    ball = [near(r, base[-1], 0.98) for _ in range(300)]  # a large group, all different
    rows += [*ball, *rows[:40], *(3.0 * v for v in rows[:10])]
    return [(int(i), v.astype(np.float32).tolist()) for i, v in zip(r.permutation(len(rows)), rows, strict=True)]


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 7, 8, "x") for i, v in rows], "vec_id long, embedding array<float>, n int, rep int, label string").repartition(3)
    return E.links(df, **more)


def test_links_against_all_pairs(spark):
    rows = planted(1)
    want = {v: (n, c) for v, n, c in brute(rows)}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in run(spark, rows).collect()}
    assert len(got) == len(rows) and all(got[v][0] <= want[v][0] and got[v][2] == (v == got[v][1]) for v in got)
    assert sum(x[0] for x in got.values()) >= 0.97 * sum(x[0] for x in want.values())
    assert sum(got[v][1] == want[v][1] for v in got) >= 0.97 * len(got)


def test_parts_of_large_buckets_change_nothing(spark):
    rows = planted(2, 400)
    whole = sorted(map(tuple, run(spark, rows).collect()))
    assert whole == sorted(map(tuple, run(spark, rows, part=60).collect()))


def test_recall_at_the_threshold():
    """Pairs at a cosine of 0.9 exactly, where most are missed: recall of the tables alone, at two sizes of table."""
    r = np.random.default_rng(4)
    for n, d in ((1 << 16, 64), (1 << 12, 16)):
        t = E.Tables(r.normal(size=(5000, d)), n)
        a = E.unit(r.normal(size=(4000, d)))
        for cosine, least in ((0.9, 0.9), (0.95, 0.985), (0.99, 0.999)):
            b = np.array([near(r, v, cosine) for v in a])
            assert (t.buckets(a) == t.buckets(b)).any(axis=1).mean() >= least


def test_rotation_balances_and_fits():
    r = np.random.default_rng(5)
    v = r.normal(size=(3000, 12)) * np.linspace(3, 0.2, 12)
    got = E.rotation(v, 0)
    loss = lambda q: ((np.where(v @ q >= 0, 1, -1) - v @ q) ** 2).sum()
    assert np.allclose(got @ got.T, np.eye(12)) and loss(got) < loss(E.rotation(v, 0, 0))


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(5, [1.0, 0.0]), (3, [2.0, 0.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (None, [1.0, 0.01]), (7, None), (8, []), (1, [0.0, -0.0]), (2, [nan, 1.0]), (4, [None, 1.0]), (6, [1.0]), (10, [4.0]), (11, [-1.0, 0.0]), (12, [0.0, 1e-30]), (13, [-0.0, 3e30]), (14, [float("inf"), 1.0])]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in run(spark, rows).collect()), key=str)
    assert got == sorted(brute(rows), key=str)
    assert {r.vec_id for r in run(spark, rows).where("kept").collect()} == {3, 7, 8, 1, 2, 4, 6, 11, 12, 14}
    assert run(spark, rows).limit(0).count() == 0 and E.digest(run(spark, rows).select("vec_id").limit(0).selectExpr("vec_id", "CAST(NULL AS array<float>) AS embedding")).count() == 0


def test_registered_query(spark):
    import pyarrow.parquet as pq

    from codexlake.llm import queries as Q

    t = pq.read_table("/root/testdata/sf0.001/embeddings.parquet")
    rows = list(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist(), strict=True))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in Q.op13_embedding_dedup(spark, "/root/testdata/sf0.001").collect()) == sorted(brute(rows))
