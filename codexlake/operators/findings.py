"""Rules over rows: findings, severities, first-matching rules of a pattern, verdicts from evidence."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    check: str
    severity: str
    failed: Column
    message: str


def findings(rows: DataFrame, rules: Sequence[Rule], location: Column) -> DataFrame:
    """(check, severity, location, message) for each rule that a row fails; one scan for all rules."""
    said = F.array_compact(F.array(*(F.when(r.failed, F.struct(F.lit(r.check).alias("check"), F.lit(r.severity).alias("severity"), F.lit(r.message).alias("message"))) for r in rules)))
    return rows.select(location.alias("location"), F.inline(said)).select("check", "severity", "location", "message")


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def severity_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.count("*").alias("n"))


def first_rule(contexts: Sequence[tuple[Column, str]]) -> Column:
    """The name of the first rule whose context holds: of a pattern's rules only that one fires."""
    return F.coalesce(*(F.when(c, F.lit(name)) for c, name in contexts))


#: The verdicts, and how much evidence of chapters and how many listed ones count.
MISORDERED, FLATTENED, OK, SUSPECT, SPARSE = "MISORDERED", "FLATTENED", "OK", "SUSPECT", "SPARSE"
MIN_EVIDENCE, CHAPTERS_ENOUGH = 5, 2


def toc_verdict(misordered: Column, misplaced: Column, chapters: Column, evidence: Column, listed: Column) -> Column:
    """What a table of contents is; the first that fits. Listed chapters beyond two are enough, whatever the evidence."""
    return (
        F.when(misordered > 0, MISORDERED).when(misplaced > 0, FLATTENED).when(chapters > CHAPTERS_ENOUGH, OK)
        .when((evidence >= MIN_EVIDENCE) & (evidence > listed), SUSPECT).otherwise(SPARSE)
    )
