"""Cuts, closures, reading orders and told values against plain Python, with nulls, ties, cycles and empty tables."""

import random

from pyspark.sql import functions as F

from codexlake.functions import text as fn
from codexlake.operators import volumes as vo
from codexlake.streaming import throttle as th


def test_voted_cuts(spark):
    docs = spark.createDataFrame([(b, k) for b in ("x", "y") for k in range(8)], "book string, ord int")
    said = spark.createDataFrame([("x", 2, "label"), ("x", 2, "label"), ("x", 3, "label"), ("x", 3, "rights"), ("x", 6, "rights"), ("x", 6, "contents"), ("y", 4, "label"), ("y", 4, "rights")], "book string, ord int, kind string")
    got = {(r.book, r.ord): r.volume for r in vo.voted_cuts(docs, said, "book", "ord").collect()}
    assert [got["x", k] for k in range(8)] == [1, 1, 1, 1, 1, 1, 2, 2] and {got["y", k] for k in range(8)} == {1}
    assert vo.voted_cuts(docs, said.limit(0), "book", "ord").agg(F.max("volume")).first()[0] == 1


def test_closure_against_search(spark):
    r = random.Random(2)
    docs = [(b, v, f"d{v}{k}") for b in (1, 2) for v in (1, 2, 3) for k in range(2)]
    files = [(b, f"f{k}") for b in (1, 2) for k in range(25)] + [(b, p) for b, _, p in docs]
    refs = [(r.choice([1, 2]), r.choice([p for _, _, p in docs] + [f"f{k}" for k in range(25)]), r.choice([f"f{k}" for k in range(30)] + ["d10", None])) for _ in range(60)] + [(1, "f1", "f2"), (1, "f2", "f1"), (1, None, "f3")]
    want = {}
    for b in (1, 2):
        for v in (1, 2, 3):
            front, seen, depth = {p for x, y, p in docs if (x, y) == (b, v)}, set(), 0
            while front:
                depth += 1
                front = {q for x, p, q in refs if x == b and p in front and (b, q) in files and q not in {z for y, _, z in docs if y == b}} - seen
                seen |= front
                want |= {(b, v, q): depth for q in front}
    make = spark.createDataFrame
    got = vo.closure(make(docs, "book int, volume int, path string"), make(refs, "book int, src string, dst string"), make(files, "book int, path string"), "book")
    assert {(x.book, x.volume, x.path): x.depth for x in got.collect()} == want
    assert vo.closure(make([], "book int, volume int, path string"), make(refs, "book int, src string, dst string"), make(files, "book int, path string"), "book").count() == 0


def test_orders_are_permutations(spark):
    r = random.Random(3)
    docs, named, want = [], [], {}
    for b in range(40):
        n = r.randrange(1, 9)
        ids = r.sample([f"i{k}" for k in range(20)], n)
        nav = [r.choice(ids) for _ in range(r.randrange(0, 7))]
        docs += [(b, i, 10 * k, f"{i[1:]}.x") for k, i in enumerate(ids)]
        named += [(b, k, i, f"L{i}") for k, i in enumerate(nav)] + [(b, 99, "gone", "?")]
        order = [*dict.fromkeys(nav)]
        out, at = [i for k, i in enumerate(ids) if not any(x in order for x in ids[: k + 1])], [ids.index(i) for i in order]
        for i in order:
            k = ids.index(i) + 1
            out.append(i)
            while k < n and ids[k] not in order:
                out.append(ids[k])
                k += 1
        falls = [k for k in range(len(at) - 1) if at[k] > at[k + 1]]
        moved = sum(x != y for x, y in zip(ids, out, strict=True))
        tidy = n >= 3 and (ids == sorted(ids) or [f"{i[1:]}.x" for i in ids] == sorted(f"{i[1:]}.x" for i in ids))
        want[b] = (out, len(falls), moved if falls else 0, tidy, f"L{order[falls[0]]}" if falls else None)
    a, b = spark.createDataFrame(docs, "book int, id string, at int, file string"), spark.createDataFrame(named, "book int, place int, id string, label string")
    rows = {}
    for x in sorted(vo.repaired_order(a, b, "book").collect(), key=lambda x: x.proposed):
        rows.setdefault(x.book, []).append(x.id)
    assert rows == {k: v[0] for k, v in want.items()}
    assert {x.book: tuple(x)[1:] for x in vo.misordering(a, b, "book").collect()} == {k: v[1:] for k, v in want.items()}


def test_told_values_of_stream_and_batch(spark, tmp_path):
    r = random.Random(4)
    nan = float("nan")
    rows = [(k, i, v) for k in ("a", "b", "c") for i, v in enumerate([0.0, 0.005, 0.01, 0.0149, None, nan, 0.5, 0.4, 1.0, 1.0, 0.2, 2.0] + [r.random() / 10 for _ in range(40)])]
    want = []
    for k in ("a", "b", "c"):
        last = -1.0
        for _, i, v in sorted(x for x in rows if x[0] == k):
            if v is not None and v == v and (v >= 1.0 or v >= last + 0.01):
                want.append((k, i))
                last = v
    df = spark.createDataFrame(rows, "key string, i int, v double")
    assert sorted((x.key, x.i) for x in th.throttled(df, "key", "v", ["i"]).collect()) == want
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source = str(tmp_path / "in")
        for a, b in ((0, 5), (5, 20), (20, 99)):  # state goes on over micro-batches and over queries
            df.where((F.col("i") >= a) & (F.col("i") < b)).coalesce(1).write.mode("append").parquet(source)
            stream = th.throttled_stream(spark.readStream.schema(df.schema).parquet(source), "key", "v", ["i"])
            stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        assert sorted((x.key, x.i) for x in spark.read.parquet(str(tmp_path / "out")).collect()) == want
    finally:
        spark.conf.unset(name)


def test_fold_of_any_script(spark):
    said = {"Ångström ﬁne": "angstrom fine", "Ελλάδα": "ελλαδα", "が": "か", "Ⅳ①": "iv1", "": "", "ñÑ": "nn"}
    got = {x.t: x.f for x in spark.createDataFrame([(t,) for t in [*said, None]], "t string").select("t", fn.fold_any(F.col("t")).alias("f")).collect()}
    assert got == said | {None: None}
