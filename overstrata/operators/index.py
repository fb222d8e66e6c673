"""Indexes of packages as DataFrames: look-ups, paths, hierarchy and integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as K


def record(records: DataFrame, record_id: int, key: str = "record_id") -> DataFrame:
    return records.filter(F.col(key) == record_id)


def by_signature(records: DataFrame, signature: bytes | str, order: str = "record_ord", column: str = "signature") -> DataFrame:
    """Records of a signature, in source order."""
    return records.filter(F.col(column) == F.lit(signature)).orderBy(order)


def numbered(records: DataFrame, order: str = "record_ord", package: str | None = "package_index", out: str = "position") -> DataFrame:
    """records with their place in their package, from 0 in source order; orders themselves are offsets, with gaps."""
    from .merge import dense_number

    return dense_number(records, order, (package,) if package else (), out=out)


def record_at(records: DataFrame, *i: int, order: str = "record_ord", package: str | None = "package_index") -> DataFrame:
    """The records at places of each package."""
    return numbered(records, order, package).filter(F.col("position").isin(*i))


def path_of(records: DataFrame, record_id: int, *keep: str) -> DataFrame:
    return record(records, record_id).select(*keep, "path")


def with_flags(records: DataFrame, mask: int, column: str = "flags") -> DataFrame:
    return records.filter(K.has_flags(column, mask))


def in_group_type(records: DataFrame, kind: int) -> DataFrame:
    """Records below a group of a type, at any depth."""
    return records.filter(F.exists("path", lambda g: g["group_type"] == kind))


def descendants(records: DataFrame, label: bytes) -> DataFrame:
    """Records below any group labelled with a record's id, where the type's labels are ids."""
    from .. import model as M

    return records.filter(F.exists("path", lambda g: g["group_type"].isin(*M.RECORD_LABELLED) & (g["label"] == F.lit(label))))


def number_occurrences(subrecords: DataFrame, *order: str, key: tuple[str, ...] = ("record_id",), signature: str = "signature") -> DataFrame:
    """occurrence: 0, 1, ... of each signature in its record, in the record's order."""
    from pyspark.sql import Window as W

    return subrecords.withColumn("occurrence", F.row_number().over(W.partitionBy(*key, signature).orderBy(*order)) - 1)


def nth_occurrence(subrecords: DataFrame, n: int) -> DataFrame:
    return subrecords.filter(F.col("occurrence") == n)


def duplicates(records: DataFrame, *key: str) -> DataFrame:
    """Keys that stand on several rows, with their number."""
    return records.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def integrity(records: DataFrame, packages: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(code, package_index, record_id, expected, actual) of violations: repeated ids, late headers, wrong counts."""
    none = F.lit(None).cast("long")
    again = duplicates(records, "package_index", "record_id").select(F.lit("DuplicateRecordId").alias("code"), "package_index", "record_id", F.lit(1).cast("long").alias("expected"), F.col("n").alias("actual"))
    late = records.filter(F.col("signature") == F.lit(b"PKHD")).select(F.lit("UnexpectedPackageHeader").alias("code"), "package_index", "record_id", none.alias("expected"), none.alias("actual"))
    deps = dependencies.groupBy("package_index").agg(F.count("*").alias("n_deps"))
    counted = records.join(deps, "package_index", "left").groupBy("package_index").agg(F.count("*").alias("actual"), F.count_if(K.package_index("record_id") == F.coalesce("n_deps", F.lit(0))).alias("owned"))
    both = packages.select("package_index", "record_count", "owned_record_count").join(counted, "package_index", "left").fillna(0, ["actual", "owned"])
    total = both.filter("record_count <> actual").select(F.lit("RecordCountMismatch").alias("code"), "package_index", none.alias("record_id"), F.col("record_count").alias("expected"), "actual")
    owned = both.filter("owned_record_count <> owned").select(F.lit("OwnedRecordCountMismatch").alias("code"), "package_index", none.alias("record_id"), F.col("owned_record_count").alias("expected"), F.col("owned").alias("actual"))
    return again.unionByName(late).unionByName(total).unionByName(owned)
