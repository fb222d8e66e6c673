"""Diagnostics as rows: (code, severity, package_index, record_id, related)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model as M
from ..functions import columns as K

ERROR, WARNING, INFORMATION = "Error", "Warning", "Information"


def _issue(df: DataFrame, code: str, severity: str, package, record, related=None) -> DataFrame:
    null = F.lit(None).cast("long")
    return df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), K.c(package).alias("package_index") if package is not None else F.lit(None).cast("int").alias("package_index"), (K.c(record) if record is not None else null).alias("record_id"), (K.c(related) if related is not None else null).alias("related"))


def next_id_collisions(packages: DataFrame, records: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Packages whose next id isn't above all their own records'."""
    n = dependencies.groupBy("package_index").agg(F.count("*").alias("n_deps"))
    top = records.join(n, "package_index", "left").filter(K.package_index("record_id") == F.coalesce("n_deps", F.lit(0)))
    top = top.groupBy("package_index").agg(F.max(K.local_id("record_id")).alias("top"))
    return _issue(packages.join(top, "package_index").filter("next_local_identifier <= top"), "PCP-NEXT-ID-COLLISION", ERROR, "package_index", "next_local_identifier", "top")


def missing_streaming_overrides(streaming: DataFrame, records: DataFrame) -> DataFrame:
    """Listed ids that their package has no record of."""
    return _issue(streaming.join(records.select("package_index", "record_id"), ["package_index", "record_id"], "left_anti"), "PCP-STREAMING-OVERRIDE-MISSING", WARNING, "package_index", "record_id")


def orphaned_paths(records: DataFrame) -> DataFrame:
    """Records below a group of children whose parent record is absent from the package."""
    parents = records.select("package_index", "record_id", F.explode("path").alias("g")).filter(F.col("g.group_type").isin(*M.RECORD_LABELLED))
    parents = parents.select("package_index", F.col("record_id").alias("child"), K.label_id("g.label").alias("record_id")).distinct()
    return _issue(parents.join(records.select("package_index", "record_id"), ["package_index", "record_id"], "left_anti"), "PCP-ORPHANED-RECORD-PATH", ERROR, "package_index", "child", "record_id")


def load_class_rules(packages: DataFrame) -> DataFrame:
    """Compact and overlay packages beyond their limits."""
    p = packages
    a = _issue(p.filter((F.col("load_class") == M.COMPACT) & (F.col("owned_record_count") > M.MAX_COMPACT_OWNED)), "CompactRecordLimitExceeded", ERROR, "package_index", None, "owned_record_count")
    b = _issue(p.filter((F.col("load_class") == M.COMPACT) & (F.col("next_local_identifier") > 0x1000)), "CompactNextIdentifierOutOfRange", ERROR, "package_index", None, "next_local_identifier")
    d = _issue(p.filter((F.col("load_class") == M.OVERLAY) & (F.col("owned_record_count") > 0)), "OverlayOwnsRecords", ERROR, "package_index", None, "owned_record_count")
    return a.union(b).union(d)


def indexed_package(packages: DataFrame, records: DataFrame, dependencies: DataFrame, streaming: DataFrame) -> DataFrame:
    return next_id_collisions(packages, records, dependencies).union(missing_streaming_overrides(streaming, records)).union(orphaned_paths(records))


def load_order(origins: DataFrame) -> DataFrame:
    """Chains of several records: an error if the signature changes, else a note. (code, severity, runtime_id, chain_length)"""
    c = origins.groupBy("runtime_id").agg(F.count("*").alias("chain_length"), F.min("signature").alias("a"), F.max("signature").alias("b")).filter("chain_length > 1")
    changed = F.col("a") != F.col("b")
    return c.select(F.when(changed, "PCP-OVERRIDE-TYPE-MISMATCH").otherwise("PCP-OVERRIDE-CHAIN").alias("code"), F.when(changed, ERROR).otherwise(INFORMATION).alias("severity"), "runtime_id", "chain_length")


def has_errors(issues: DataFrame) -> bool:
    return issues.filter(F.col("severity") == ERROR).limit(1).count() > 0
