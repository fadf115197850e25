"""Collections and reading orders: cuts voted by evidence, the resources each volume reaches, spines put back in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codexlake.operators.graph import _kept


def voted_cuts(documents: DataFrame, evidence: DataFrame, book: str, order: str, needed: int = 2) -> DataFrame:
    """documents with volume (from 1): a document opens one if `needed` kinds of evidence (book, order, kind) speak for it.

    Under two openings a book is one volume; what stands before the first opening belongs to it.
    """
    votes = evidence.groupBy(book, order).agg(F.count_distinct("kind").alias("_votes")).where(F.col("_votes") >= needed)
    w = Window.partitionBy(book)
    rows = documents.join(votes, [book, order], "left").withColumn("_opens", F.col("_votes").isNotNull().cast("int"))
    before = F.sum("_opens").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("volume", F.when(F.sum("_opens").over(w) < 2, 1).otherwise(F.greatest(before, F.lit(1))).cast("long")).drop("_votes", "_opens")


def closure(documents: DataFrame, references: DataFrame, files: DataFrame, book: str) -> DataFrame:
    """(book, volume, path, depth): the files that each volume's documents (book, volume, path) reach over references (book, src, dst), and in how many steps at least.

    All volumes go in one loop: a frontier row is labelled with its volume, so rounds are as many as the longest way, not
    as the volumes. Documents of the spine are links, not resources, whatever points to them; what no file is ends there.
    """
    known = files.select(book, "path").distinct()
    edges = references.where("src IS NOT NULL AND dst IS NOT NULL").select(book, "src", "dst").distinct()
    edges = edges.join(known.withColumnRenamed("path", "dst"), [book, "dst"], "left_semi")
    edges = _kept(edges.join(documents.select(book, F.col("path").alias("dst")).distinct(), [book, "dst"], "left_anti"))
    front = _kept(documents.select(book, "volume", "path").distinct())
    seen, depth = None, 0
    while True:
        depth += 1
        step = front.withColumnRenamed("path", "src").join(edges, [book, "src"]).select(book, "volume", F.col("dst").alias("path")).distinct()
        front = _kept((step.join(seen, [book, "volume", "path"], "left_anti") if seen is not None else step).withColumn("depth", F.lit(depth)))
        seen = front if seen is None else _kept(seen.unionByName(front))
        if front.isEmpty():
            return seen
        front = front.drop("depth")


def volume_resources(documents: DataFrame, references: DataFrame, files: DataFrame, book: str, order: str) -> DataFrame:
    """(book, volume, first, last, documents, resources, shared): each volume's span, what it reaches, and how much of that another volume reaches too."""
    spans = documents.groupBy(book, "volume").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("documents"))
    reached = _kept(closure(documents, references, files, book))
    many = reached.groupBy(book, "path").agg((F.count("*") > 1).alias("_many"))
    used = reached.join(many, [book, "path"]).groupBy(book, "volume").agg(F.count("*").alias("resources"), F.count_if("_many").alias("shared"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return spans.join(used, [book, "volume"], "left").select(book, "volume", "first", "last", "documents", zero("resources"), zero("shared"))


def repaired_order(documents: DataFrame, named: DataFrame, book: str) -> DataFrame:
    """(book, id, at, proposed): a spine (book, id, at) in the order of its navigation (book, place, id).

    Documents that the navigation names take its order, each at its first mention; the others stay behind the nearest
    named one before them, or at the front. The result is a permutation of each book's documents.
    """
    first = named.groupBy(book, "id").agg(F.min("place").alias("_place"))
    w = Window.partitionBy(book)
    rows = documents.select(book, "id", "at").join(first, [book, "id"], "left")
    anchor = F.last("_place", ignorenulls=True).over(w.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_anchor", anchor).withColumn("at", F.row_number().over(w.orderBy("at")) - 1)
    # ties of the anchor are those that follow one named document, in their order
    return rows.select(book, "id", "at", (F.row_number().over(w.orderBy(F.col("_anchor").asc_nulls_first(), "at")) - 1).alias("proposed"))


def misordering(documents: DataFrame, named: DataFrame, book: str) -> DataFrame:
    """(book, descents, moved, machine_sorted, first_out_of_order): how a spine (book, id, at, file) departs from its navigation (book, place, id, label).

    descents counts neighbours in the navigation that stand the other way round in the spine; moved is 0 without any. A
    spine of three and more is machine-sorted if its ids or its file names are in order by code point.
    """
    order = repaired_order(documents, named, book)
    w = Window.partitionBy(book).orderBy("at")
    falls = lambda c: F.coalesce(F.col(c) < F.lag(c).over(w), F.lit(False))
    base = documents.withColumn("_i", falls("id")).withColumn("_f", falls("file")).groupBy(book).agg(F.count("*").alias("_n"), F.bool_or("_i").alias("_i"), F.bool_or("_f").alias("_f"))
    first = named.groupBy(book, "id").agg(F.min(F.struct("place", "label")).alias("_p"))
    nav = order.join(first, [book, "id"]).withColumn("_next", F.lead("at").over(Window.partitionBy(book).orderBy("_p.place"))).where("_next < at")
    fell = nav.groupBy(book).agg(F.count("*").alias("descents"), F.min("_p").alias("_first"))
    moved = order.groupBy(book).agg(F.count_if(F.col("at") != F.col("proposed")).alias("_moved"))
    out = base.join(moved, book).join(fell, book, "left")
    sorted_ = (F.col("_n") >= 3) & (~F.col("_i") | ~F.col("_f"))
    return out.select(book, F.coalesce("descents", F.lit(0)).alias("descents"), F.when(F.col("descents") > 0, F.col("_moved")).otherwise(0).alias("moved"), sorted_.alias("machine_sorted"), F.col("_first.label").alias("first_out_of_order"))
