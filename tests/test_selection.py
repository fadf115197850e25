import pytest
from pyspark.sql import functions as F

from codexlake.functions import text as fn
from codexlake.operators import selection as sel

#: Differ on every predicate.
BOOKS = [
    (1, "aaa", "Wool", "Hugh Howey", "en", "Saga", ["manga"], "x"), (2, "bbb", "人間失格", "太宰 治", "ja", "Saga", ["manga", "old"], "x"), (3, "ccc", "Shift", "Hugh Howey", "en", None, [], None),
]


@pytest.fixture(scope="module")
def books(spark):
    return spark.createDataFrame(BOOKS, "id long, sha256 string, title string, author string, language string, series string, tags array<string>, path string")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_each_predicate(books):
    s = sel.Selection
    assert ids(s(prefixes=["a", "cc"]).apply(books)) == [1, 3]
    assert ids(s(contains={"author": "hugh"}).apply(books)) == [1, 3]
    assert ids(s(tags=["manga", "old"]).apply(books)) == [2]
    assert ids(s(equals={"series": "Saga"}, has=["path"]).apply(books)) == [1, 2]
    assert ids(s(missing=["path"]).apply(books)) == [3]
    assert ids(s(either={("title", "language"): "en"}).apply(books)) == [1, 3]
    assert ids(s(ids=[3, 1]).apply(books)) == [1, 3]
    assert ids(s(limit=2).apply(books, [F.col("id").desc()])) == [2, 3]
    for wrong in (s(), s(ids=[1, 99])):
        with pytest.raises(ValueError):
            wrong.apply(books)


def test_facets_leave_one_out(books):
    facets = {"language": sel.facet_values(F.col("language")), "series": sel.facet_values(F.col("series")), "tags": sel.facet_values(F.col("tags"), many=True)}
    got = {(r.facet, r.label): r.n for r in sel.facet_counts(books, facets, {"language": ["en"], "tags": ["old", "gone"]}).collect()}
    assert got[("language", "ja")] == 1 and got[("language", "en")] == 0  # other facets hold, its own does not
    assert got[("tags", "manga")] == 1 and got[("tags", "—")] == 1 and got[("tags", "gone")] == 0 and got[("tags", "old")] == 0
    assert ("series", "Saga") not in got


def test_missing_sinks_last_both_ways(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, None), (3, 1.0)], "id int, v double")
    order = lambda d: [r.id for r in rows.orderBy(sel.missing_last(F.col("v"), d)).collect()]
    assert order(False) == [3, 1, 2] and order(True) == [1, 3, 2]


def test_natural_order(spark):
    names = ["Vol 10", "Vol 9", "Vol 09", "vol", "Vol 9b", "", "10", "2", "Vol 123456789012345678"]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    got = [r.s for r in df.orderBy(fn.natural_key(F.col("s")), fn.leading_zeros(F.col("s")), "s").collect()]
    assert got == ["", "2", "10", "Vol 9", "Vol 09", "Vol 9b", "Vol 10", "Vol 123456789012345678", "vol"]


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(fn.fold(F.lit("Éa-Ü 9!"))) == "eau9"
    assert one(fn.search_key(F.lit("Bär"), F.lit("x"))) == "barx|baerx" and one(fn.search_key(F.lit("Bar"))) == "bar"
    assert one(fn.normal_language(F.lit("zh_TW"))) == "zh-Hant" and one(fn.normal_language(F.lit("zh-CN"))) == "zh-Hans" and one(fn.normal_language(F.lit("JPN"))) == "ja"
    assert one(fn.display_name(F.lit("Howey, Hugh"))) == "Hugh Howey" and one(fn.display_name(F.lit("King, Jr."))) == "King, Jr." and one(fn.display_name(F.lit("太宰, 治"))) == "太宰, 治"
    assert one(fn.normal_title(F.lit("﻿A  b\n c "))) == "A b c" and one(fn.without_suffix(F.lit("A (b) (c)"))) == "A (b)"
    assert one(fn.resolve_path(F.lit("OEBPS/t/a.html"), F.lit("../../../i/./x.png"))) == "/i/x.png"
    assert [one(fn.href_kind(F.lit(h))) for h in ("#a", "http://x", "b.html#c", "mailto:x", "")] == ["fragment", "external", "chapter", "other", "none"]
    assert one(fn.visible_text(F.lit("<p>a<script>var t='</p>'</script><ruby>b<rp>(</rp><rt>c</rt></ruby></p>"))) == "a b c"
    assert one(F.lit("My.Notes.TXT").rlike(fn.glob_regex("my.*.t?t"))) and not one(F.lit("myxnotes.txt").rlike(fn.glob_regex("my.*")))
    assert one(fn.canonical_tags(F.array(F.lit(" A "), F.lit("a"), F.lit("")))) == ["a"]


def test_series_and_groups(spark):
    df = spark.createDataFrame([(1, "B", 1.5), (2, None, None), (3, "A", 10.0), (4, "B", None)], "id int, s string, i double")
    assert {r.id: r.group_at for r in sel.first_seen(df, "s", "id").collect()} == {1: 1, 2: 2, 3: 3, 4: 1}
    keys = {r.id: r.k for r in df.select("id", sel.series_key(F.col("s"), F.col("i")).alias("k")).collect()}
    assert keys[1] == "B 00000015" and keys[3] == "A 00000100" and keys[4] == "B 99999999"
    assert ids(sel.leads(df.where("s IS NOT NULL"), "s", [F.col("i").asc_nulls_last()])) == [1, 3]
