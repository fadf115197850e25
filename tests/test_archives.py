"""Archives as rows and rows as archives: round trips, what is read, and what a failure leaves."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, StringEndsWith

from codexlake.sources import archives as ar


def test_members_and_filters(spark, tmp_path, monkeypatch):
    for k in range(5):
        with zipfile.ZipFile(tmp_path / f"b{k}.zip", "w") as z:
            z.writestr("dir/", "")
            z.writestr("a.txt", f"text {k}")
            z.writestr("dir/b.bin", bytes([k]) * 1000)
    (tmp_path / "other.txt").write_text("no archive")
    got = ar.members(spark, str(tmp_path), glob="*.zip")
    assert sorted((r.archive, r.ord, r.member, r.size, bytes(r.content[:6])) for r in got.collect()) == sorted(x for k in range(5) for x in [(f"b{k}.zip", 1, "a.txt", 6, f"text {k}".encode()), (f"b{k}.zip", 2, "dir/b.bin", 1000, bytes([k]) * 6)])
    assert got.where("member LIKE '%.txt'").count() == 5 and got.where("member = 'a.txt' AND size > 6").count() == 0
    assert {r.content for r in ar.members(spark, str(tmp_path), glob="*.zip", content="false").collect()} == {None}
    assert ar.members(spark, str(tmp_path / "none"), glob="*.zip").count() == 0
    assert ar.members(spark, str(tmp_path), glob="*.zip", like="dir/*").count() == 5
    name = "spark.sql.python.filterPushdown.enabled"
    spark.conf.set(name, "true")
    try:
        assert ar.members(spark, str(tmp_path), glob="*.zip").where("member LIKE '%.txt' AND size > 3").count() == 5
    finally:
        spark.conf.unset(name)
    reader = ar.PushedReader({"path": str(tmp_path), "glob": "*.zip", "partition_bytes": "1"})
    assert [len(p.paths) for p in reader.partitions()] == [1] * 5
    left = GreaterThan(("size",), 3)
    assert [*reader.pushFilters([StringEndsWith(("member",), ".txt"), left, EqualTo(("archive",), "x")])] == [left, EqualTo(("archive",), "x")]
    read = []
    whole = zipfile.ZipFile.read
    monkeypatch.setattr(zipfile.ZipFile, "read", lambda self, m, *a: read.append(m.filename) or whole(self, m, *a))
    assert [r[2] for p in reader.partitions() for r in reader.read(p)] == ["a.txt"] * 5 and read == ["a.txt"] * 5


def test_books_round_trip(spark, tmp_path):
    pages = [(1, k, f"<html><body><p>{k} é</p></body></html>", "A & <b>") for k in (3, 1, 2)] + [(2, 7, None, None)]
    df = spark.createDataFrame(pages, "book int, n int, html string, title string")
    ar.write_archives(ar.book_members(df, "book", "n", "html", "title"), str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["1.epub", "2.epub"]
    with zipfile.ZipFile(tmp_path / "out/1.epub") as z:
        assert z.infolist()[0].filename == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED and z.testzip() is None
        assert b"A &amp; &lt;b&gt;" in z.read("OEBPS/nav.xhtml")
    got = sorted((r.archive, r.spine, r.path, r.html) for r in ar.chapters(spark, str(tmp_path / "out")).collect())
    assert got == [*(("1.epub", k - 1, f"OEBPS/c0000000{k}.xhtml", f"<html><body><p>{k} é</p></body></html>") for k in (1, 2, 3)), ("2.epub", 0, "OEBPS/c00000007.xhtml", "")]
    assert ar.package_rows("a", "p.opf", b"<no") == [] and ar.packages(spark, str(tmp_path / "out")).where("spine IS NULL").count() == 2


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    rows = spark.range(20).select(F.concat("id", F.lit(".zip")).alias("archive"), F.lit(0).alias("ord"), F.lit("m").alias("member"), F.when(F.col("id") == 13, F.raise_error(F.lit("broken")).cast("string")).otherwise("x").cast("binary").alias("content"))
    with pytest.raises(Exception, match="broken"):
        ar.write_archives(rows, str(tmp_path / "out"))
    assert [*(tmp_path / "out").rglob("*")] == [] if (tmp_path / "out").exists() else True
    ar.write_archives(rows.where("archive <> '13.zip'"), str(tmp_path / "out"))
    assert len(os.listdir(tmp_path / "out")) == 19
