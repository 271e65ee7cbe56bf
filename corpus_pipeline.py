"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, tokens.

Each stage works on everything its predecessor kept. All but the last return
the columns of ``documents``; the last returns (doc_id, n_tokens, token_ids,
ids_sha256, decoded_sha256). Stages are written as Parquet and read again, so
a lost executor costs tasks of the running stage alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import bpe, decontaminate, line_dedup, order_minhash, toxicity
from sheaf.llm._shared import Scratch, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more for toxicity go."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def remove_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go from the texts; n_chars follows the text."""
    out = line_dedup.remove_boilerplate(docs, removed_col="_sheaf_removed")
    changed = F.when(F.col("_sheaf_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).select(*docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the least id stays."""
    return order_minhash.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests of the ids and of their decoding."""
    return bpe.encode_and_check(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", remove_boilerplate),
    ("near_dedup", keep_one_of_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("tokens", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; a stage's table goes when the next one is written."""
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = name
    return docs


#: Training, Order MinHash and BPE have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None
