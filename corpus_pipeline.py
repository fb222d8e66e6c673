"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from overstrata.llm import decontaminate, ngram_join, packing, pii, toxicity
from overstrata.llm.common import Table, bounded_bytes
from overstrata.llm.queries import PII_KEY
from overstrata.session import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _bounded(stage: Stage) -> Stage:
    """Executors run all stages one after another, and keep what the largest batch took: batches are bounded in bytes."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_bytes(docs)
        return stage(spark, docs, sf_dir)

    return run


@_bounded
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model learned from labels holds for toxic go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject(docs, model)


@_bounded
def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more, the one of least doc_id stays."""
    return ngram_join.keep_one(docs)


@_bounded
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item or more go."""
    return decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_bounded
def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses become pseudonyms; n_chars follows the text."""
    out = pii.pseudonymise(docs, pii.secret(docs, spark.conf.get("overstrata.pii.key", PII_KEY)))
    return out.withColumn("n_chars", pii.length_of("text", "n_chars")) if "n_chars" in docs.columns else out


@_bounded
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", one_of_each_class),
    ("benchmark_decontamination", decontaminated),
    ("pii", pseudonymised),
    ("best_fit_packing", packed),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = Table(stage(spark, docs, sf_dir), name).df
    return STAGES[-1][1](spark, docs, sf_dir)
