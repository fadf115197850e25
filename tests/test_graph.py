import random

from codexlake.operators import graph as G


def _closure(edges):
    """node -> depth of each node that a walk of one edge or more reaches."""
    out = {}
    for start in {a for a, _ in edges}:
        seen, front, d = {}, {start}, 0
        while front:
            d += 1
            front = {b for a, b in edges if a in front} - seen.keys()
            seen |= dict.fromkeys(front, d)
        out[start] = seen
    return out


def test_long_chain_and_cycle(spark):
    chain = [(i, i + 1) for i in range(104)]
    got = {r.node: r.depth for r in G.reachable(spark.createDataFrame(chain, "src int, dst int").coalesce(1), spark.createDataFrame([(0,)], "node int")).collect()}
    assert got == {i: i for i in range(105)}
    ring = [(i, (i + 1) % 53) for i in range(53)] + [(5, 60), (60, 61), (70, 3), (None, 1), (80, 80)]
    assert {r.node for r in G.on_cycles(spark.createDataFrame(ring, "src int, dst int").coalesce(1)).collect()} == {*range(53), 80}


def test_dense_and_random(spark):
    r = random.Random(4)
    for edges in ([(a, b) for a in range(16) for b in range(16)], [(r.randrange(30), r.randrange(30)) for _ in range(36)]):
        df, want = spark.createDataFrame(edges, "src int, dst int").coalesce(1), _closure(edges)
        root = edges[0][0]
        got = {x.node: x.depth for x in G.reachable(df, spark.createDataFrame([(root,)], "node int")).collect()}
        assert got == want[root] | {root: 0}
        assert {x.node for x in G.on_cycles(df).collect()} == {a for a in want if a in want[a]}
        both = _closure([*edges, *((b, a) for a, b in edges)])
        assert {x.node: x.least for x in G.equivalence_classes(df, "src", "dst").collect()} == {a: min(v) for a, v in both.items()}


def test_note_pairs(spark):
    links = [(1, "r", "n", 5), (1, "n", "r", 90), (1, "n", "r", 3000), (1, "x", "y", 2), (1, "s", "s", 1), (1, "b", "a", 4), (1, "a", "b", 4), (2, "n", "r", 1), (2, "r", "n", 2), (3, None, "q", 1), (3, "q", None, 2)]
    df = spark.createDataFrame(links, "book int, src string, dst string, at int")
    assert sorted(map(tuple, G.note_pairs(df, "book").collect())) == [(1, "a", "b", "unordered"), (1, "r", "n", "ordered"), (2, "n", "r", "ordered")]
    assert G.note_pairs(df.limit(0), "book").count() == 0
