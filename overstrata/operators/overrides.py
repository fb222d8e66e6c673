"""Override chains and winners: all records of one runtime id in package order; the last one wins, deleted or not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import model as M
from ..functions import columns as K


def chains(origins: DataFrame, *keep: str) -> DataFrame:
    """(runtime_id, chain): structs of package_index and the kept columns, in package order. A chain has at most one row a package."""
    return origins.groupBy("runtime_id").agg(F.array_sort(F.collect_list(F.struct("package_index", *keep))).alias("chain"))


def counts(origins: DataFrame) -> DataFrame:
    """(runtime_id, chain_length)."""
    return origins.groupBy("runtime_id").agg(F.count("*").alias("chain_length"))


def winners(origins: DataFrame, *keep: str) -> DataFrame:
    """(runtime_id, chain_length, winner_package, kept columns of the winner). One partial and one final aggregation."""
    best = F.max_by(F.struct(*keep), "package_index").alias("w") if keep else F.lit(None).alias("w")
    out = origins.groupBy("runtime_id").agg(F.count("*").alias("chain_length"), F.max("package_index").alias("winner_package"), best)
    return out.select("runtime_id", "chain_length", "winner_package", *[F.col(f"w.{k}") for k in keep])


def live_winners(origins: DataFrame, *keep: str) -> DataFrame:
    """Winners that aren't marked deleted."""
    return winners(origins, *dict.fromkeys([*keep, "flags"])).filter(~K.has_flags("flags", M.DELETED))


def nth_origin(origins: DataFrame, n: int) -> DataFrame:
    """The n-th (from 0) record of each chain that is long enough."""
    return origins.withColumn("_n", F.row_number().over(W.partitionBy("runtime_id").orderBy("package_index"))).filter(F.col("_n") == n + 1).drop("_n")


def winning_record_at(origins: DataFrame, i: int, *keep: str) -> DataFrame:
    """The i-th winner by unsigned runtime id."""
    return winners(origins, *keep).orderBy("runtime_id").offset(i).limit(1)


def streaming_winners(overrides: DataFrame) -> DataFrame:
    """(runtime_id, package_index): the last package that lists an id, from resolved streaming overrides."""
    return overrides.groupBy("runtime_id").agg(F.max("package_index").alias("package_index"))
