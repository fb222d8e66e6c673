"""Package metadata as tables: class rules, relations, streaming overrides, version matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model as M
from ..functions import columns as K


def first_owned_local(load_class: str | F.Column = "load_class") -> F.Column:
    return F.when(K.c(load_class) == M.COMPACT, M.FIRST_COMPACT_LOCAL).otherwise(M.FIRST_FULL_LOCAL)


def set_load_class(packages: DataFrame, package_id: bytes, value: int) -> DataFrame:
    """A package without records that still has a full one's first id starts at that of its new class."""
    mine = F.col("package_id") == F.lit(package_id)
    fresh = mine & (F.col("record_count") == 0) & (F.col("next_local_identifier") == M.FIRST_FULL_LOCAL)
    start = M.FIRST_COMPACT_LOCAL if value == M.COMPACT else M.FIRST_FULL_LOCAL
    return packages.withColumns({"next_local_identifier": F.when(fresh, start).otherwise(F.col("next_local_identifier")), "load_class": F.when(mine, value).otherwise(F.col("load_class"))})


def set_fields(packages: DataFrame, package_id: bytes, **values) -> DataFrame:
    if not 0 <= values.get("next_local_identifier", 0) <= M.MAX_LOCAL:
        raise M.PackageError("NextLocalIdentifierOutOfRange", value=values["next_local_identifier"])
    mine = F.col("package_id") == F.lit(package_id)
    return packages.withColumns({k: F.when(mine, F.lit(v)).otherwise(F.col(k)) for k, v in values.items()})


def add_relation(relations: DataFrame, package_index: int, package_id: bytes, name: str, requirement: str | None = None, packages: DataFrame | None = None, limit: int | None = M.MAX_DEPENDENCIES) -> DataFrame:
    """The relation at the end of the package's list. A repeated one, one with the package itself (of ``packages``:
    package_index, package_id), or one beyond the limit is an error; incompatibilities have none."""
    from ..codec import Relation

    checked = Relation(package_id, name, requirement)
    spark = relations.sparkSession
    mine = relations.filter(F.col("package_index") == package_index)
    known, n, after = mine.agg(F.count_if(F.col("package_id") == F.lit(package_id)), F.count("*"), F.coalesce(F.max("ord") + 1, F.lit(0))).first()
    if known:
        raise M.PackageError("DuplicateRelationship", package=package_id.hex())
    if limit is not None and n >= limit:
        raise M.PackageError("TooManyDependencies", count=n + 1)
    if packages is not None and not packages.filter((F.col("package_index") == package_index) & (F.col("package_id") == F.lit(package_id))).isEmpty():
        raise M.PackageError("SelfRelationship", package=package_id.hex())
    return relations.unionByName(spark.createDataFrame([(package_index, after, bytearray(package_id), name, checked.requirement)], M.RELATIONS))


def replace_relations(relations: DataFrame, package_index: int, new: Sequence[tuple[bytes, str, str | None]], packages: DataFrame | None = None, limit: int | None = M.MAX_DEPENDENCIES) -> DataFrame:
    """The package's list made of (package_id, name, requirement) instead, with the same rules."""
    out = relations.filter(F.col("package_index") != package_index)
    for r in new:
        out = add_relation(out, package_index, *r, packages=packages, limit=limit)
    return out


def remove_relation(relations: DataFrame, package_index: int, package_id: bytes) -> DataFrame:
    from pyspark.sql import Window as W

    mine = F.col("package_index") == package_index
    left = relations.filter(~(mine & (F.col("package_id") == F.lit(package_id))))
    return left.withColumn("ord", F.row_number().over(W.partitionBy("package_index").orderBy("ord")) - 1)


def distinct_overrides(lists: DataFrame, column: str = "record_ids") -> DataFrame:
    """Ids in order of their first place."""
    return lists.withColumn(column, F.array_distinct(column))


def scene_table(offsets: DataFrame, world_id: int | None) -> DataFrame:
    return offsets.filter(F.col("world_id").eqNullSafe(F.lit(world_id)))


def shift(offsets: DataFrame, delta: int) -> DataFrame:
    return offsets.withColumns({"start_offset": F.col("start_offset") + delta, "end_offset": F.col("end_offset") + delta})


def summary(records: DataFrame, *by: str, size: str = "payload_bytes") -> DataFrame:
    """Records, bytes and signatures of each package."""
    return records.groupBy(*by).agg(F.count("*").alias("record_count"), F.sum(size).alias("total_bytes"), F.count_distinct("signature").alias("n_signatures"), F.max(K.c(size)).alias("largest"))
