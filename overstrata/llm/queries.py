"""The queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, chat, decontaminate, ngram_join, packing, pii, suffix_dedup, toxicity, urlfilter, warc

#: The key of the pseudonyms of query op6 and of the pipeline, where the session's ``overstrata.pii.key`` is unset.
PII_KEY = "overstrata demonstration key"
#: Fixed rules of query op2: host, path, verdict.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "block"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op1_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.join(spark.read.parquet(f"{sf}/documents.parquet"))


def op2_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge(spark.read.parquet(f"{sf}/pages.parquet"), rules).select("page_id", "host", "path", "rule", "verdict")


def op3_hnsw_search(spark: SparkSession, sf: str) -> DataFrame:
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    return ann.search(table.filter("vec_id % 20 = 0"), table, k=20)


def op4_warc_normaliser(spark: SparkSession, sf: str) -> DataFrame:
    return warc.round_trip(spark, spark.read.parquet(f"{sf}/pages.parquet"))


def op5_perspective_rotation(spark: SparkSession, sf: str) -> DataFrame:
    return chat.rotate(spark.read.parquet(f"{sf}/conversations.parquet"))


def op6_pii_pseudonyms(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return pii.pseudonymise(docs, pii.secret(docs, spark.conf.get("overstrata.pii.key", PII_KEY)))


def op7_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(spark.read.parquet(f"{sf}/documents.parquet"))


def op8_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.dedup(spark.read.parquet(f"{sf}/documents.parquet"))


def op9_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.matches(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))


def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    return toxicity.score(docs, model, spans=True).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "offending")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from . import sql

    return dict(sql.ORACLES)
