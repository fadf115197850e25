"""A corpus pipeline of five operators; each stage takes and returns documents, the last one the written token ids.

Defined cases of all stages: a null text counts as empty; rows that repeat whole count each but where a stage says
otherwise; texts of any length are rows of a scan; further columns, whatever their names, go through to the last stage;
an empty table gives none. Rows with a null doc_id go through near-dedup as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from codexlake.llm import decontaminate, mixing, quality, simhash, tokens
from codexlake.llm.common import shared_path, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned decision list rejects; without labels the base rule alone judges, and empty texts fail it."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (by fingerprints, then exactly by five-word shingles), that of the least doc_id; texts without words are one group, and two different texts under one doc_id are two documents."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without what they share with benchmark items; without items they stay as they are."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights of their sources ask for."""
    return mixing.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read back from the written pieces."""
    return tokens.token_output(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("temperature mixing", mixture), ("token-id output", token_output)]

#: The learned list, the fingerprints and the tokenizer are beyond SQL; the tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = shared_path(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
