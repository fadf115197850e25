"""Temperature mixing of sources.

A source's weight is its share of tokens to the power of an exponent in [0, 1], normalised. The least exponent is
searched (by sections, many per pass) at which the entropy of the weights is down to the target and no source repeats
more often than allowed. A source's quota of the budget is whole passes over it and a part of one more; that part is
the beginning of a block permutation: documents fall by hash into about sqrt(n) blocks, blocks and the documents in
them are put in the order of keyed hashes, and documents are taken until the quota is met. So the outcome for each
source is one row: passes, and the order key up to which documents get one copy more.

Scale: texts are counted once for the plan. Sources are never collected; each section search is one aggregate over one row per
source. Only the one block of each source in which its quota ends is put in order, so a hot source costs about
sqrt(n) rows in a task. Per-source rows are broadcast only if there are at most `broadcast_sources` of them; beyond
that they are joined.

Defined cases: a null source is a source of its own; a source without tokens keeps its documents once; a null text has
no tokens, one of any length is one count; repeated rows of a doc_id share one fate; a budget beyond what the repetition limit allows is lowered to it;
an empty table stays empty; further columns pass through, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexlake.llm.common import WORD, fresh, written

#: Between the entropy of the sources as they are (0) and that of equal weights (1); passes over a source at most.
TARGET, MAX_REPEATS, SEED, BROADCAST_SOURCES = 0.5, 4.0, 17, 100_000
_SECTIONS, _ROUNDS = 16, 7


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def exponent(totals: DataFrame, budget: float, target: float = TARGET, max_repeats: float = MAX_REPEATS) -> float:
    """The least exponent in [0, 1] that meets the target entropy and the repetition limit, given (tokens) of each source."""
    top = totals.agg(F.max("tokens")).first()[0]
    x = F.log(F.col("tokens") / top)

    def measured(alphas: list[float]) -> list[tuple[float, float]]:
        """Entropy, and most passes over a source, at each exponent."""
        sums = []
        for k, a in enumerate(alphas):
            w = F.exp(a * x)
            sums += [F.sum(w).alias(f"z{k}"), F.sum(w * x).alias(f"s{k}"), F.max(w / F.col("tokens")).alias(f"m{k}")]
        r = totals.agg(*sums).first()
        return [(math.log(r[f"z{k}"]) - a * r[f"s{k}"] / r[f"z{k}"], r[f"m{k}"] * budget / r[f"z{k}"]) for k, a in enumerate(alphas)]

    (most, _), (least, _) = measured([0.0, 1.0])
    goal = least + target * (most - least)
    good = lambda hr: hr[0] <= goal + 1e-12 and hr[1] <= max_repeats + 1e-9
    low, high = 0.0, 1.0
    for _ in range(_ROUNDS):
        points = [low + (high - low) * k / _SECTIONS for k in range(_SECTIONS + 1)]
        found = next((k for k, hr in enumerate(measured(points)) if good(hr)), _SECTIONS)
        if found == 0:
            return low
        low, high = points[found - 1], points[found]
    return high


def _keys(n_blocks: Column, source: Column, doc_id: Column, seed: int) -> tuple[Column, Column]:
    """Order keys of a document's block and of the document in it."""
    block = F.pmod(F.xxhash64(doc_id, F.lit(seed)), n_blocks)
    return F.xxhash64(block, source, F.lit(seed + 1)), F.xxhash64(doc_id, F.lit(seed + 2))


def plan(slim: DataFrame, *, target: float = TARGET, max_repeats: float = MAX_REPEATS, budget: float | None = None, seed: int = SEED) -> DataFrame:
    """A row for each source of (source, doc_id, tokens): source, n_blocks, passes, block_key and doc_key up to which one copy more is due."""
    totals = written(slim.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "sources")
    some = totals.where("tokens > 0")
    total = some.agg(F.sum("tokens")).first()[0]
    blocks_of = F.ceil(F.sqrt(F.col("n"))).cast("long").alias("n_blocks")
    if not total:
        return totals.select("source", blocks_of, F.lit(1).cast("long").alias("passes"), F.lit(None).cast("long").alias("block_key"), F.lit(None).cast("long").alias("doc_key"))
    budget = min(budget or float(total), max_repeats * total)
    a = exponent(some, budget, target, max_repeats)
    top, weight = some.agg(F.max("tokens")).first()[0], lambda top: F.exp(a * F.log(F.col("tokens") / top))
    z = some.agg(F.sum(weight(top))).first()[0]
    quota = weight(top) / z * budget
    passes = F.floor(quota / F.col("tokens") + 1e-9)
    quotas = totals.select("source", blocks_of, F.when(F.col("tokens") > 0, passes).otherwise(1).cast("long").alias("passes"), F.when(F.col("tokens") > 0, F.greatest(F.lit(0.0), quota - passes * F.col("tokens"))).otherwise(0.0).alias("rest"))
    quotas = written(quotas, "quotas")
    block_key, doc_key = _keys(F.col("n_blocks"), F.col("source"), F.col("doc_id"), seed)
    keyed = slim.join(quotas, "source").select("source", "tokens", "rest", block_key.alias("block_key"), doc_key.alias("doc_key"))
    blocks = keyed.groupBy("source", "rest", "block_key").agg(F.sum("tokens").alias("tokens"))
    so_far = F.sum("tokens").over(Window.partitionBy("source").orderBy("block_key").rowsBetween(Window.unboundedPreceding, 0))
    last = blocks.withColumn("before", so_far - F.col("tokens")).where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("tokens"))).select("source", "block_key", "before")
    inside = keyed.join(last, ["source", "block_key"])
    so_far = F.sum("tokens").over(Window.partitionBy("source").orderBy("doc_key").rangeBetween(Window.unboundedPreceding, 0))
    taken = inside.withColumn("to_here", F.col("before") + so_far).where(F.col("to_here") - F.col("tokens") / 2 <= F.col("rest")).groupBy("source").agg(F.max("doc_key").alias("doc_key"))
    ends = last.select("source", "block_key").join(taken, "source", "left")
    return written(quotas.select("source", "n_blocks", "passes").join(ends, "source", "left"), "mixing-plan")


def _slim(docs: DataFrame, text_col: str, source_col: str, id_col: str) -> DataFrame:
    return written(docs.select(_named(F.col(source_col)).alias("source"), F.col(id_col).alias("doc_id"), token_count(F.col(text_col)).alias("tokens")), "mixing-rows")


def _named(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("null"))


def _copies(docs: DataFrame, rows: DataFrame, source: Column, doc_id: Column, name: str, seed: int, broadcast_sources: int) -> DataFrame:
    """docs with the copies that a plan's rows give each."""
    rows = rows.select(*(F.col(c).alias(f"_mix_{c}") for c in ("source", "n_blocks", "passes", "block_key", "doc_key")))
    if rows.limit(broadcast_sources + 1).count() <= broadcast_sources:
        rows = F.broadcast(rows)
    block_key, doc_key = _keys(F.col("_mix_n_blocks"), F.col("_mix_source"), doc_id, seed)
    due = (block_key < F.col("_mix_block_key")) | ((block_key == F.col("_mix_block_key")) & (doc_key <= F.col("_mix_doc_key")))
    # with no block in which the quota ends, the passes are all
    copies = F.col("_mix_passes") + F.when(F.coalesce(due, F.lit(False)), 1).otherwise(0)
    return docs.join(rows, source == F.col("_mix_source")).withColumn(name, copies).drop(*rows.columns)


def with_copies(docs: DataFrame, *, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", seed: int = SEED, broadcast_sources: int = BROADCAST_SOURCES, **more) -> tuple[DataFrame, dict[str, str]]:
    """docs with tokens and copies, and those columns' names."""
    name = {k: fresh(k, docs.columns) for k in ("tokens", "copies")}
    rows = plan(_slim(docs, text_col, source_col, id_col), seed=seed, **more)
    out = docs.withColumn(name["tokens"], token_count(F.col(text_col)))
    return _copies(out, rows, _named(F.col(source_col)), F.col(id_col), name["copies"], seed, broadcast_sources), name


def mix(docs: DataFrame, **more) -> DataFrame:
    """docs, same columns, each as often as the mixture has it."""
    out, name = with_copies(docs, **more)
    again = fresh("_again", out.columns)
    return out.where(F.col(name["copies"]) > 0).withColumn(again, F.explode(F.sequence(F.lit(1).cast("long"), F.col(name["copies"])))).select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, source, tokens and copies of each document, from the rows that were counted once."""
    slim = written(docs.select("doc_id", F.col("source").alias("own"), _named(F.col("source")).alias("source"), token_count(F.col("text")).alias("tokens")), "mixing-rows")
    out = _copies(slim, plan(slim.select("source", "doc_id", "tokens")), F.col("source"), F.col("doc_id"), "copies", SEED, BROADCAST_SOURCES)
    return out.select("doc_id", F.col("own").alias("source"), "tokens", "copies")
