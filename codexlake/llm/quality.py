"""Quality rules: statistics of a text as Spark columns, and a decision list learned on them.

The list is an ordered set of conjunctions of thresholds, learned by sequential covering: each rule grows by FOIL gain
on two thirds of the labelled rows and is pruned on the rest; rows that a rule takes are put aside for the next one. A
rule is kept only if nearly all it takes is labelled bad. The list comes out as one nested Spark conditional.

Scale: native columns only, one pass and no shuffle over the documents. The labelled rows to learn from are bounded by
`max_labelled` (rows of least hash of doc_id, so the choice does not depend on partitions); that many ids are broadcast
and that many rows of numbers reach the driver.

Defined cases: a null text has no words and fails the base rule, an empty one too; labels without a document, null
labels and tables without both classes teach nothing (the base rule alone decides); repeated rows are judged each by
itself, and of those with one doc_id one teaches; a text of any length is one row's arrays; further columns pass through, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexlake.llm.common import fresh

MAX_LABELLED, MAX_RULES, MAX_TERMS, MIN_PRECISION, MIN_COVER, CUTS = 20_000, 8, 4, 0.97, 5, 48
_BLANKS = " \t\n\x0b\x0c\r"


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def repeat_words(own: Column, n: int = 8) -> Column:
    """Words inside n-word windows that occur twice or more in the text. Words are taken one by one: slice() would copy the whole array each time."""
    windows = F.when(F.size(own) < n, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(own) - n + 1), lambda i: F.xxhash64(*(F.get(own, i + (k - 1)) for k in range(n)))))

    def covered(w: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(
            F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])), lambda x: x.isNotNull()
        )
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda a, p: F.struct((a["n"] + p + n - F.greatest(p, a["end"])).alias("n"), (p + n).alias("end"))
        return F.aggregate(F.sort_array(_let(placed, twice)), start, step, lambda a: a["n"])

    return _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w))).cast("long")


def with_statistics(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """docs with the counts, and the name that each count's column got.

    The counts come out of a generator of one row: filters on them stay above it, where pushing them into a projection
    would put the splitting of the text into every step of the array functions.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != "")
    per_word = lambda w: {"n_words": F.size(w), "word_chars": F.length(F.array_join(w, "")), "n_repeat_words": repeat_words(w), "n_distinct": F.size(F.array_distinct(w))}
    per_line = lambda x: {"n_dup_lines": F.size(x) - F.size(F.array_distinct(x)), "n_lines": F.size(x)}
    per_char = {"n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")), "n_upper": F.regexp_count(text, F.lit(r"[A-Z]")), "n_bangs": F.regexp_count(text, F.lit(r"[!?]"))}
    as_struct = lambda d: F.struct(*(v.cast("long").alias(k) for k, v in d.items()))
    counts = _let(words(text), lambda w: _let(lines, lambda x: as_struct(per_word(w) | per_line(x) | per_char)))
    keys = ["n_words", "word_chars", "n_repeat_words", "n_distinct", "n_dup_lines", "n_lines", *per_char]
    name = {k: fresh(k, docs.columns) for k in keys}
    return docs.select("*", F.inline(F.array(counts)).alias(*(name[k] for k in keys))), name


def base_failed(name: dict[str, str]) -> Column:
    return (F.col(name["n_words"]) < 20) | (100 * F.col(name["n_repeat_words"]) > 30 * F.col(name["n_words"]))


def ratios(name: dict[str, str]) -> dict[str, Column]:
    """What the rules set thresholds on."""
    c = {k: F.col(v).cast("double") for k, v in name.items()}
    per = lambda a, b: F.coalesce(F.try_divide(c[a], c[b]), F.lit(0.0))
    return {
        "words": c["n_words"], "mean_word": per("word_chars", "n_words"), "symbols": per("n_symbols", "n_words"), "dup_lines": per("n_dup_lines", "n_lines"), "repeats": per("n_repeat_words", "n_words"),
        "distinct": per("n_distinct", "n_words"), "upper": per("n_upper", "word_chars"), "bangs": per("n_bangs", "n_words"), "line_words": per("n_words", "n_lines"),
    }


# -- learning --------------------------------------------------------------------------------------------------------

Rule = list[tuple[str, str, float]]


def _takes(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for f, op, t in rule:
        hit &= x[f] >= t if op == ">=" else x[f] <= t
    return hit


def learn(x: dict[str, np.ndarray], bad: np.ndarray, part: np.ndarray) -> list[Rule]:
    """The ordered rules for bad rows. part: False for rows that prune."""
    n, rules, left = len(bad), [], np.ones(len(bad), bool)
    share = np.linspace(0, 1, CUTS + 1)
    cuts = {f: np.unique(np.concatenate([np.quantile(v[m], share) for m in (bad, ~bad)])) for f, v in x.items()} if bad.any() and not bad.all() else {}
    while cuts and len(rules) < MAX_RULES and (left & bad).sum() >= MIN_COVER:
        rule: Rule = []
        hit = left & part
        while len(rule) < MAX_TERMS and (hit & ~bad).any():
            p0, n0 = (hit & bad).sum(), (hit & ~bad).sum()
            if not p0:
                break
            before, best = np.log2(p0 / (p0 + n0)), (1e-9, None, None)
            for f, ts in cuts.items():
                v = x[f][hit]
                b = bad[hit]
                for t in ts:
                    for op, m in ((">=", v >= t), ("<=", v <= t)):
                        p, q = (m & b).sum(), (m & ~b).sum()
                        if p and (gain := p * (np.log2(p / (p + q)) - before)) > best[0]:
                            best = gain, (f, op, float(t)), None
            if best[1] is None:
                break
            rule.append(best[1])
            hit &= _takes(rule[-1:], x, n)
        prune = left & ~part

        def worth(r: Rule, prune=prune) -> float:
            h = _takes(r, x, n) & prune
            p, q = (h & bad).sum(), (h & ~bad).sum()
            return (p + 1) / (p + q + 2) if p + q else 0.5

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        got = _takes(rule, x, n) & left
        p, q = (got & bad).sum(), (got & ~bad).sum()
        if not rule or p < MIN_COVER or p / (p + q) < MIN_PRECISION:
            break
        rules.append(rule)
        left &= ~got
    return rules


def fit(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Rules learned from at most max_labelled labelled documents (label 0: bad)."""
    some = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.min(label_col).alias("label"))
    some = some.orderBy(F.xxhash64("label_id"), "label_id").limit(max_labelled)
    text = docs.select(F.col(id_col).alias("label_id"), F.col(f"`{text_col}`").alias("text"))
    stats, name = with_statistics(text.join(F.broadcast(some), "label_id"))  # max_labelled rows of two numbers
    # of rows that repeat a doc_id the least by label and ratios, so that max_labelled rows of numbers reach the driver
    one = F.min(F.struct("label", *(v.alias(k) for k, v in ratios(name).items()))).alias("one")
    rows = stats.where(~base_failed(name)).groupBy("label_id").agg(one).select("label_id", "one.*").collect()
    rows.sort(key=lambda r: tuple(r))
    x = {k: np.array([r[k] for r in rows], float) for k in (rows[0].asDict() if rows else ()) if k not in ("label_id", "label")}
    bad = np.array([r.label == 0 for r in rows], bool)
    return learn(x, bad, np.array([zlib.crc32(str(r.label_id).encode()) % 3 > 0 for r in rows], bool)) if rows else []


def verdict(rules: list[Rule], x: dict[str, Column]) -> Column:
    """The number of the first rule that takes a row, from 1; 0 if none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        hit = F.lit(True)
        for f, op, t in rule:
            hit = hit & (x[f] >= t if op == ">=" else x[f] <= t)
        out = F.when(hit, k) if out is None else out.when(hit, k)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(docs: DataFrame, labels: DataFrame, *, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """docs with statistics, base_failed, rule (of the list; 0: none) and kept, and those columns' names."""
    rules = fit(docs, labels, text_col=text_col)
    out, name = with_statistics(docs, text_col)
    name |= {k: fresh(k, docs.columns) for k in ("base_failed", "rule", "kept")}
    out = out.withColumns({name["base_failed"]: base_failed(name), name["rule"]: verdict(rules, ratios(name))})
    return out.withColumn(name["kept"], ~F.col(name["base_failed"]) & (F.col(name["rule"]) == 0)), name


def keep_good(docs: DataFrame, labels: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs, same columns, without those that the base rule or the list rejects."""
    out, name = judge(docs, labels, text_col=text_col)
    return out.where(F.col(name["kept"])).select(*(F.col(f"`{c}`") for c in docs.columns))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out, _ = judge(docs.select("doc_id", "text"), labels)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
