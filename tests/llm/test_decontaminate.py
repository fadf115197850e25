import hashlib
import random

from codexlake.llm import decontaminate as D


def brute(text, items, window=10):
    own = D.words(text)
    hit, found = set(), set()
    for item, t in items:
        w = D.words(t)
        size = min(window, len(w))
        windows = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(own) - size + 1):
            if size and tuple(own[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(str(item))
    return len(own), len(hit), sorted(found)


def cases(seed=3):
    r = random.Random(seed)
    say = lambda n: " ".join(r.choice("aa bb cc") for _ in range(n))
    items = [(i, say(r.choice([1, 3, 9, 10, 11, 25]) if i else 40)) for i in range(1, 9) if i != 1]
    items += [(100, None), (101, "  .,! "), (7, say(12)), (7, say(12)), (9, "Ünïcode  words, HERE")]
    docs = [(i, say(r.choice([0, 1, 5, 30, 200]))) for i in range(20)]
    docs += [(50, None), (51, ""), (52, "x " * 30 + (items[2][1] or "") + " y" * 30), (52, "x " * 30), (53, "say ünïcode? words here"), (54, "say Ünïcode? WORDS here")]
    return docs, items


def test_against_brute_force(spark):
    docs, items = cases()
    long = [(i, t) for i, t in items if t is None or len(t.split()) >= 9 or i == 9]
    for bench, block in ((items, 1 << 20), (long, 1 << 20), (long, 120)):
        b = spark.createDataFrame(bench, "item_id long, text string")
        d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, n_words int")
        got = sorted(tuple(r) for r in D.find_contamination(d, b, block_bytes=block, names=("n", "s", "i")).selectExpr("doc_id", "coalesce(text, '')", "n", "aggregate(s, 0L, (a, x) -> a + x.end - x.start)", "i").collect())
        want = sorted((i, t or "", *brute(t, bench)) for i, t in docs)
        assert got == want


def test_digest_and_cut(spark):
    docs, items = cases(5)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for r in D.digest(d, b).collect():
        assert r.contaminated == (r.n_hit > 0)
        assert (r.n_items == 0) == (r.items_sha256 == hashlib.sha256(b"").hexdigest())
    passage = "one two three four five six seven eight nine ten eleven"
    mine = spark.createDataFrame([(1, f"Before it, {' w' * 30} (One two, three four five six seven eight nine TEN eleven) after."), (2, passage), (3, "clean"), (4, None)], "doc_id long, text string")
    left = {r.doc_id: r.text for r in D.decontaminate(mine, spark.createDataFrame([(1, passage)], "item_id long, text string")).collect()}
    assert left == {1: f"Before it, {' w' * 30} () after.", 3: "clean", 4: None}


def test_empty(spark):
    d, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert D.digest(d, b).count() == 0
    assert D.digest(b.toDF("doc_id", "text"), d.toDF("item_id", "text")).first().n_hit == 0


def test_long_text(spark):
    """A text of 200,000 words with a passage at its end; scanned again by the second block's pass."""
    passage = "one two three four five six seven eight nine ten eleven"
    text = "word " * 200_000 + passage
    b = spark.createDataFrame([(1, passage), (2, "word other " * 6)], "item_id long, text string")
    for block in (1 << 20, 40):
        r = D.find_contamination(spark.createDataFrame([(1, text)], "doc_id long, text string"), b, block_bytes=block).first()
        assert (r.n_words, [tuple(x) for x in r.hit_spans], r.hit_items) == (200_011, [(200_000, 200_011)], ["1"])


def test_an_item_that_repeats_is_one_item(spark):
    items = spark.createDataFrame([("a", "one two three four five six seven eight nine ten")] * 3000 + [("b", "x y")], "item_id string, text string")
    rows, n = D._items(items, "item_id", "text", 200)
    assert n == 1 and rows.count() == 2
