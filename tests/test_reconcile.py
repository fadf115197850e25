from pyspark.sql import functions as F

from codexlake.operators import reconcile as rc
from codexlake.sources import files


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_newest_wins_keeps_ours_on_a_tie_and_is_idempotent(spark):
    kind = "sha string, title string, stamp string"
    ours = spark.createDataFrame([("a", "ours", "2024-01-02"), ("b", "ours", "2024-01-01"), ("c", None, "2024")], kind)
    theirs = spark.createDataFrame([("a", "theirs", "2024-01-02"), ("b", "theirs", "2024-01-03"), ("d", "new", "1")], kind)
    once = rc.newest_wins(ours, theirs, "sha", "stamp")
    assert rows(once) == [("a", "ours", "2024-01-02"), ("b", "theirs", "2024-01-03"), ("c", None, "2024"), ("d", "new", "1")]
    assert rows(rc.newest_wins(once, theirs, "sha", "stamp")) == rows(once)


def test_insert_ignore_tombstones_presence(spark):
    t = spark.createDataFrame([("h1", 1)], "key string, v int")
    new = spark.createDataFrame([("h1", 9), ("h2", 2), ("h2", 3)], "key string, v int")
    assert rows(rc.insert_ignore(t, new, ["key"], "v")) == [("h2", 2)]
    assert rows(rc.without_tombstones(new, t, ["key"])) == [("h2", 2), ("h2", 3)]
    seen = spark.createDataFrame([("h1", 5)], "key string, v int")
    assert rows(rc.refresh_presence(new, seen, ["key"])) == [("h1", 5), ("h2", 2), ("h2", 3)]


def test_patches(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], "id int, p string, q string")
    c = spark.createDataFrame([(1, None), (2, "new")], "id int, p string")
    assert rows(rc.patch(t, c, "id")) == [(1, "a", "x"), (2, "new", "y"), (3, "c", "z")]
    assert rows(rc.patch(t, c, "id", clear=True)) == [(1, None, "x"), (2, "new", "y"), (3, "c", "z")]
    d = c.withColumn("deleted", F.col("id") == 2).withColumn("q", F.lit("d"))
    assert rows(rc.delta_over_base(t, d, "id")) == [(1, None, "d"), (3, "c", "z")]


def test_tiers_first_match_wins(spark):
    left = spark.createDataFrame([(1, "x", "k"), (2, "none", "k"), (3, "none", None)], "l int, a string, b string")
    right = spark.createDataFrame([(9, "x", "k"), (7, "y", "k"), (8, "x", None)], "r int, a2 string, b2 string")
    assert rows(rc.tiered_match(left, right, [(F.col("a"), F.col("a2")), (F.col("b"), F.col("b2"))], "l", "r"), "l") == [(1, 8, 1), (2, 7, 2), (3, None, None)]


def test_comparisons(spark):
    a = spark.createDataFrame([("k", "1", 1), ("k", "2", 2), ("gone", "x", 1), ("n", None, 1)], "key string, v string, at int")
    b = spark.createDataFrame([("k", "1", 1), ("new", "y", 1), ("n", None, 1)], "key string, v string, at int")
    assert rows(rc.bag_diff(a, b, "key", "v", "at")) == [("gone", "dropped", 1), ("k", "changed", 1), ("k", "identical", 1), ("n", "identical", 1), ("new", "added", 1)]
    assert rows(rc.keyed_diff(a.where("at = 1"), b, ["key"], "v")) == [("gone", "dropped"), ("k", "identical"), ("n", "identical"), ("new", "added")]
    assert rc.multiset_diff(a, a, "v").where("lost > 0 OR gained > 0").count() == 0


def test_backup_round_trip(spark, tmp_path):
    t = spark.createDataFrame([(1, "a"), (2, None)], "id int, s string")
    files.backup({"t": t}, str(tmp_path / "b"))
    assert rows(files.restore(spark, str(tmp_path / "b"))["t"]) == [(1, "a"), (2, None)]
    t.limit(1).write.mode("overwrite").parquet(str(tmp_path / "b" / "t"))
    try:
        files.restore(spark, str(tmp_path / "b"))
        raise AssertionError("damage not seen")
    except ValueError as e:
        assert "damaged" in str(e)


def test_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"\x89PNG\r\n\x1a\nxx")
    (tmp_path / "b.txt").write_bytes("﻿é".encode())
    (tmp_path / "c.txt").write_bytes("é€".encode("cp1252"))
    got = {r.path[-5:]: (r.kind, r.t) for r in files.binary_files(spark, str(tmp_path)).withColumn("t", files.decode_text(F.col("content"))).collect()}
    assert got["a.bin"][0] == "png" and got["b.txt"] == ("txt", "é") and got["c.txt"] == ("txt", "é€")
    notes = spark.createDataFrame([(1, 2, "highlight", "x\ny"), (1, 1, "note", "n"), (1, 3, "bookmark", None)], "book int, pos int, kind string, text string")
    assert files.annotations_markdown(notes, "book", ["pos"], "kind", "text").first().markdown == "- **Note:** n\n> x\n> y\n- (bookmark)"
