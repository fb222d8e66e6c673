"""Mutation batches and override feeds as streams. An addition: the engine's model itself has no event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.edit import apply_batch


def winners_stream(origins: DataFrame, watermark: str = "1 hour", window: str = "1 hour", time: str = "ts") -> DataFrame:
    """The last package of each id in each window; late rows beyond the watermark are dropped by Spark."""
    return origins.withWatermark(time, watermark).groupBy(F.window(time, window), "runtime_id").agg(F.max("package_index").alias("winner_package"), F.count("*").alias("chain_length"))


def apply_stream(mutations: DataFrame, state_path: str, key: str, columns: list[str], checkpoint: str):
    """Each micro-batch makes a new version of the table below state_path; the version a batch made is named by its number,
    so a repeated batch writes the same version again. Starts with state_path/v=-1."""
    spark = mutations.sparkSession

    def step(batch: DataFrame, n: int) -> None:
        before = spark.read.parquet(f"{state_path}/v={n - 1}")
        apply_batch(before, batch, key, columns).write.mode("overwrite").parquet(f"{state_path}/v={n}")

    return mutations.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
