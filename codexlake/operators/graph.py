"""Graphs over edge tables: reachability, cycles, equivalence classes of names, broken and reverse links."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _kept(df: DataFrame) -> DataFrame:
    """df checkpointed, which cuts the lineage of rounds; in a local folder only where the cluster names none, as in tests."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def reachable(edges: DataFrame, roots: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, depth): nodes that roots (node) reach, and over how many edges at least. One round for each depth, until no node is new."""
    edges = _kept(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    seen = front = _kept(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while True:
        depth += 1
        new = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = _kept(new.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return seen
        seen = _kept(seen.union(front))


def on_cycles(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Nodes (node) that a path of their own edges leads back to.

    Strong components by colours: each node takes the greatest node that reaches it; what leads back to that node in
    its colour is a component and leaves the graph, until no edge is left. Rows are nodes and edges, never paths.
    """
    edges = _kept(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    found = edges.where("src = dst").select(F.col("src").alias("node"))
    rest = _kept(edges.where("src <> dst"))
    n = rest.count()
    while n:
        # edges from or to where nothing goes on are on no cycle
        fewer = _kept(rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(rest.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        rest, before, n = fewer, n, fewer.count()
        if n < before or not n:
            continue
        colour = _kept(rest.select(F.col("src").alias("node")).distinct().withColumn("colour", F.col("node")))
        moved = True
        while moved:
            up = rest.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("up"))
            new = _kept(colour.join(up, "node").select("node", F.greatest("colour", "up").alias("colour"), (F.col("up") > F.col("colour")).alias("moved")))
            moved, colour = not new.where("moved").isEmpty(), new.drop("moved")
        of = lambda end: colour.select(F.col("node").alias(end), F.col("colour").alias(f"{end}_colour"))
        same = rest.join(of("src"), "src").join(of("dst"), "dst").where("src_colour = dst_colour")
        back = _kept(reachable(same, colour.where("node = colour"), "dst", "src").select("node").join(colour, "node"))
        many = back.groupBy("colour").count().where("count > 1").select("colour")
        found = _kept(found.union(back.join(many, "colour", "left_semi").select("node")))
        for end in ("src", "dst"):
            rest = rest.join(back.select(F.col("node").alias(end)), end, "left_anti").select("src", "dst")
        rest = _kept(rest)
        n = rest.count()
    return found.distinct()


def equivalence_classes(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, least): least node that pairs connect a node with, by passing the least label on until nothing changes.

    Labels are checkpointed each round in the folder of spark.checkpoint.dir.
    """
    both = pairs.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = _kept(both.union(both.select("y", "x")).distinct())
    labels = _kept(both.select(F.col("x").alias("node")).distinct().withColumn("least", F.col("node")))
    moved = True
    while moved:
        near = both.join(labels, both.y == labels.node).groupBy("x").agg(F.min("least").alias("near"))
        new = labels.join(near, labels.node == near.x).select("node", F.least("least", "near").alias("least"), (F.col("near") < F.col("least")).alias("moved"))
        # a label is also replaced by its own label, which halves the way to the least
        jump = new.select(F.col("node").alias("_n"), F.col("least").alias("_l"))
        new = _kept(new.join(jump, new.least == jump._n, "left").select("node", F.least("least", F.coalesce("_l", "least")).alias("least"), "moved"))
        moved, labels = bool(new.where("moved").limit(1).count()), new.drop("moved")
    return labels


def broken(edges: DataFrame, targets: DataFrame, dst: str, target: str) -> DataFrame:
    """Edges whose target is not among targets."""
    return edges.join(targets.select(F.col(target).alias("_t")).distinct(), F.col(dst) == F.col("_t"), "left_anti")


def reverse(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(dst, n, sources in order) of each target."""
    return edges.groupBy(dst).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(src)).alias("sources"))


def reciprocal(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Edges (a, b), a below b, that run both ways: how note references are told."""
    x = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).distinct()
    return x.where("a < b").join(x.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi")


def note_pairs(links: DataFrame, book: str) -> DataFrame:
    """(book, reference, note, kind) of links (book, src, dst, at) between anchors that point to one another.

    at is the place of src in reading order: what comes first is the reference. Where both stand at one place the order
    tells nothing, and kind is `unordered`, the lesser anchor first; where the way back is told at several places, the
    first counts. Links of an anchor to itself are no pair.
    """
    ends = links.where("src <> dst").groupBy(book, "src", "dst").agg(F.min("at").alias("at"))
    back = ends.select(book, F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("at").alias("_back"))
    both = ends.join(back, [book, "src", "dst"]).where((F.col("at") < F.col("_back")) | ((F.col("at") == F.col("_back")) & (F.col("src") < F.col("dst"))))
    return both.select(book, F.col("src").alias("reference"), F.col("dst").alias("note"), F.when(F.col("at") == F.col("_back"), "unordered").otherwise("ordered").alias("kind"))
