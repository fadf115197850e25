import random
import re

import numpy as np
import xxhash

from codexlake.llm import simhash as S
from codexlake.llm.components import components


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_classes(rows):
    out, left = {}, dict(enumerate(rows))
    while left:
        k, seen = next(iter(left)), []
        queue = [k]
        del left[k]
        while queue:
            i = queue.pop()
            seen.append(i)
            near = [j for j in left if (rows[i][1] ^ rows[j][1]).bit_count() <= 3]
            for j in near:
                del left[j]
            queue += near
        name = min(rows[i][0] for i in seen)
        out |= {i: name for i in seen}
    return out


def test_fingerprint():
    r = random.Random(1)
    for t in (None, "", " \n", "One", "one TWO", "Élan É x\x1fy　z", *(" ".join(r.choice("abc") for _ in range(n)) for n in (3, 4, 50, 400))):
        assert S.fingerprint(t) == brute_print(t)


def test_classes(spark):
    r = random.Random(2)
    prints = [r.getrandbits(64) for _ in range(60)] + [0, 0]
    for _ in range(400):
        f = r.choice(prints[-120:])
        for _ in range(r.choice([0, 1, 2, 3, 3, 4])):
            f ^= 1 << r.randrange(64)
        prints.append(f)
    rows = list(enumerate(prints))
    r.shuffle(rows)
    want = brute_classes(rows)
    df = spark.createDataFrame([(d, f - (1 << 64) if f >> 63 else f) for d, f in rows], "doc_id long, fp long")
    assert {x.doc_id: x.component_id for x in S.classes(df).collect()} == {rows[i][0]: c for i, c in want.items()}
    edges = S.links(df.select("fp").distinct(), shard_rows=20)  # shards dealt on in rings
    roots = {x.node & (2**64 - 1): x.root for x in components(edges).collect()}
    same = {}
    for i, c in want.items():
        f = rows[i][1]
        assert same.setdefault(roots.get(f, f"own {f}"), c) == c
    assert len(same) == len({*want.values()})


def test_tree_prunes_and_loses_nothing():
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 8, np.uint64)
    fps = np.unique(np.concatenate([base, *(base[r.integers(0, 8, 300)] ^ (np.uint64(1) << r.integers(0, 64, 300, np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 300, np.uint64)) for _ in range(2))]))
    a, b = S.shard_links(fps)
    forest = S.Forest(len(fps))
    forest.tie(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3))
    assert len(a) == (forest.root != np.arange(len(fps))).sum()


def test_documents(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(5, text, 1), (3, text.upper(), 2), (9, None, 3), (8, "", 4), (8, "", 4), (7, "other words " * 9, 5), (None, "x y", 6)], "doc_id long, text string, fp int")
    got = {(x.doc_id, x.component_id) for x in S.digest(docs).collect()}
    assert got >= {(5, 3), (3, 3), (9, 8), (8, 8), (7, 7)} and len(got) == 6
    assert {x.doc_id for x in S.keep_one(docs).collect()} == {None, 3, 7, 8} and S.keep_one(docs).count() == 4
    assert S.digest(docs.limit(0)).count() == 0


def test_dense_ball_is_dealt_until_shards_are_small(spark):
    """All fingerprints within two bits of one: rings cannot part them, blocks of other bits do; chains lose no link."""
    masks = [0, *(1 << a for a in range(24)), *((1 << a) | (1 << b) for a in range(24) for b in range(a))]
    chain = [(255 << 56) + sum(1 << b for b in range(n)) for n in range(0, 40, 3)]
    df = spark.createDataFrame([(m - (1 << 64) if m >> 63 else m,) for m in {*masks, *chain}], "fp long")
    got = {}
    for x in components(S.links(df, shard_rows=60)).collect():
        got.setdefault(x.root, set()).add(x.node & (2**64 - 1))
    assert sorted(map(len, got.values())) == sorted([len({*masks}), len(chain)])
    for level in range(5):
        m = [x & (2**64 - 1) for x in S.bit_classes(4, level)]
        assert sum(m) == 2**64 - 1 and all(a & b == 0 for i, a in enumerate(m) for b in m[:i])


def test_texts_under_one_id_and_long_texts(spark):
    """A different text that repeats a doc_id stays; a repeated row goes; a text of 200,000 words is one fingerprint."""
    a, b, long = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 50), ("b", 50), ("c", 200_000)))
    docs = spark.createDataFrame([(1, a), (1, b), (1, b), (2, b), (3, long), (4, long + " end")], "doc_id long, text string")
    assert sorted((x.doc_id, len(x.text)) for x in S.keep_one(docs).collect()) == [(1, len(a)), (1, len(b)), (3, len(long))]
    found = {(x.doc_id, x.fingerprint, x.component_id) for x in S.digest(docs).collect()}
    assert {(d, c) for d, _, c in found} == {(1, 1), (2, 1), (3, 3), (4, 3)} and (3, f"{brute_print(long):016x}", 3) in found
