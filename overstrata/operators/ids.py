"""Slots of a load order, and ids between a package's numbering and the common one.

Full packages have slots 0 to 253, compact ones 0 to 4095, overlays none. In a file an id's top byte is the place of its
owner among the dependencies, or their number for the package's own records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import model as M
from ..functions import columns as K


def assign_slots(packages: DataFrame) -> DataFrame:
    """packages with slot: the number of earlier packages of the class."""
    n = F.row_number().over(W.partitionBy("load_class").orderBy("package_index")) - 1
    most = F.when(F.col("load_class") == M.FULL, M.MAX_FULL).otherwise(M.MAX_COMPACT)
    slot = F.when(n < most, n).otherwise(F.raise_error(F.concat(F.lit("TooManyPackages: "), F.col("load_class"))).cast("int"))
    return packages.withColumn("slot", F.when(F.col("load_class") != M.OVERLAY, slot))


def owners(packages: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(package_index, rel_index, owner_index, owner_class, owner_slot) of each index that an id of the package may carry."""
    slots = assign_slots(packages).select("package_index", "package_id", "load_class", "slot")
    named = slots.select(F.col("package_index").alias("owner_index"), F.col("package_id").alias("owner_id"), F.col("load_class").alias("owner_class"), F.col("slot").alias("owner_slot"))
    deps = dependencies.select("package_index", F.col("ord").alias("rel_index"), F.col("package_id").alias("owner_id"))
    own = slots.select("package_index", "package_id").join(dependencies.groupBy("package_index").agg(F.count("*").cast("int").alias("n")), "package_index", "left")
    own = own.select("package_index", F.coalesce("n", F.lit(0)).alias("rel_index"), F.col("package_id").alias("owner_id"))
    return deps.unionByName(own).join(named, "owner_id").drop("owner_id")


def runtime_id(load_class: str, slot: str, local: F.Column) -> F.Column:
    compact = F.when(local <= 0xFFF, F.lit(M.COMPACT_BASE).bitwiseOR(F.shiftleft(F.col(slot).cast("long"), 12)).bitwiseOR(local)).otherwise(F.raise_error(F.lit("CompactLocalIdentifierOutOfRange")).cast("long"))
    none = F.raise_error(F.lit("OverlayOwnsRecords")).cast("long")
    return F.when(F.col(load_class) == M.FULL, F.shiftleft(F.col(slot).cast("long"), 24).bitwiseOR(local)).when(F.col(load_class) == M.COMPACT, compact).otherwise(none)


def resolve(rows: DataFrame, packages: DataFrame, dependencies: DataFrame, column: str = "record_id") -> DataFrame:
    """rows with runtime_id, from (package_index, record_id). An index beyond the dependencies is an error."""
    table = owners(packages, dependencies)
    keyed = rows.withColumn("rel_index", K.package_index(column))
    out = keyed.join(table, ["package_index", "rel_index"], "left")
    known = F.when(F.col("owner_index").isNull(), F.raise_error(F.concat(F.lit("InvalidPackageIndex: "), K.show_id(column))).cast("long"))
    return out.withColumn("runtime_id", known.otherwise(runtime_id("owner_class", "owner_slot", K.local_id(column)))).drop("rel_index", "owner_index", "owner_class", "owner_slot")


def serialize(rows: DataFrame, packages: DataFrame, dependencies: DataFrame, column: str = "runtime_id") -> DataFrame:
    """rows with record_id as the row's package writes it, from (package_index, runtime_id); null if it can't reach the owner."""
    table = owners(packages, dependencies).select("package_index", "rel_index", "owner_class", "owner_slot")
    r = F.col(column)
    compact = r >= M.COMPACT_BASE
    slot = F.when(compact, F.shiftright(r.bitwiseAND(F.lit(0xFFFFFF).cast("long")), 12)).otherwise(F.shiftright(r, 24))
    local = F.when(compact, r.bitwiseAND(F.lit(0xFFF).cast("long"))).otherwise(r.bitwiseAND(F.lit(M.MAX_LOCAL).cast("long")))
    keyed = rows.withColumns({"owner_class": F.when(compact, M.COMPACT).otherwise(M.FULL), "owner_slot": slot.cast("int"), "_local": local})
    out = keyed.join(table, ["package_index", "owner_class", "owner_slot"], "left")
    return out.withColumn("record_id", F.shiftleft(F.col("rel_index").cast("long"), 24).bitwiseOR(F.col("_local"))).drop("owner_class", "owner_slot", "rel_index", "_local")
