"""Byte ranges of scenes: the index that lets a reader load one scene, and reads through it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import codec as B
from .. import model as M
from ..functions import columns as K
from ..model import PackageError
from .merge import dense_number  # noqa: F401  (numbering of ordered rows)


def scene_offsets(groups: DataFrame, records: DataFrame) -> DataFrame:
    """(package_index, world_id, scene_id, start_offset, end_offset, ord) of each group of temporary children.

    A scene starts at its record and ends with the smallest group of children of the same label around the temporary
    ones. That group is an ancestor, so the path gives it and no interval join is needed. The world is the outermost
    world group above the scene's record.
    """
    ends = groups.select("package_index", "header_offset", F.col("end_offset").alias("around_end"))
    temp = groups.filter(F.col("group_type") == M.TEMPORARY_CHILDREN).withColumn("scene_id", K.label_id("label"))
    around = F.filter("path", lambda g: (g["group_type"] == M.SCENE) & (g["label"] == F.col("label")))
    temp = temp.withColumn("around", F.try_element_at(around, F.lit(-1))["header_offset"])  # the innermost is the smallest
    temp = temp.join(ends.withColumnRenamed("header_offset", "around"), ["package_index", "around"], "left")
    world = F.try_element_at(F.filter("path", lambda g: g["group_type"] == M.WORLD), F.lit(1))["label"]
    scene = records.select("package_index", F.col("record_id").alias("scene_id"), F.col("header_offset").alias("start_offset"), K.label_id(world).alias("world_id"), F.lit(True).alias("_found"))
    out = temp.join(scene, ["package_index", "scene_id"], "left")
    start = F.when(F.col("_found").isNull(), F.raise_error(F.concat(F.lit("SceneRecordMissingForOffset: "), K.show_id("scene_id"))).cast("long")).otherwise(F.col("start_offset"))
    return out.select("package_index", "world_id", "scene_id", start.alias("start_offset"), F.coalesce("around_end", "end_offset").alias("end_offset"), F.col("pre_order").alias("ord"))


def read_range(records: DataFrame, start: int, end: int, skip_persistent: bool = True) -> DataFrame:
    """Records in a byte range, without those below groups of persistent children."""
    out = records.filter((F.col("header_offset") >= start) & (F.col("header_offset") < end))
    return out.filter(~F.exists("path", lambda g: g["group_type"] == M.PERSISTENT_CHILDREN)) if skip_persistent else out


def running_sum(rows: DataFrame, order: str, value: str, out: str, width: int = 1 << 16) -> DataFrame:
    """rows with the sum of ``value`` over all rows before, by a dense long column.

    Sums of ranges of the order come first and a window works inside each, so no task sees all rows. Rows are read three times.
    """
    from .merge import range_width

    width = range_width(rows, order, width)
    part = rows.withColumn("_b", F.floor(F.col(order) / width))
    base = part.groupBy("_b").agg(F.sum(value).alias("_s"))
    base = base.select("_b", (F.sum("_s").over(W.orderBy("_b")) - F.col("_s")).alias("_base"))
    inner = F.sum(value).over(W.partitionBy("_b").orderBy(order).rowsBetween(W.unboundedPreceding, 0)) - F.col(value)
    return part.join(base, "_b").withColumn(out, F.col("_base") + inner).drop("_b", "_base")


def layout(entries: DataFrame, content_offset: int = 0) -> DataFrame:
    """entries (pre_order dense from 0, own_bytes, path of pre_orders) with header_offset and group_byte_count.

    A file is the entries' own bytes in pre-order, so offsets are a running sum, and a group's size is the sum below it.
    """
    placed = running_sum(entries, "pre_order", "own_bytes", "header_offset").withColumn("header_offset", F.col("header_offset") + content_offset)
    below = entries.select(F.explode("ancestors").alias("pre_order"), "own_bytes").groupBy("pre_order").agg(F.sum("own_bytes").alias("below"))
    return placed.join(below, "pre_order", "left").withColumn("total_bytes", F.col("own_bytes") + F.coalesce("below", F.lit(0))).drop("below")


# --- images ---------------------------------------------------------------------------------------


def scene_tables(source: B.Memory | B.File) -> list[B.SceneTable]:
    """Tables of a package image, worlds and scenes as first seen."""
    _, records, groups = B.build_index(source)
    where = {r.id: (r, path) for r, path in records}
    out: dict[int | None, list[B.SceneOffset]] = {}
    for g, path in groups:
        if g.type != M.TEMPORARY_CHILDREN:
            continue
        scene = M.label_id(g.label)
        if scene not in where:
            raise PackageError("SceneRecordMissingForOffset", scene=scene)
        r, above = where[scene]
        world = next((M.label_id(x.label) for x in above if x.type == M.WORLD), None)
        around = [x for x in path if x.type == M.SCENE and x.label == g.label]
        out.setdefault(world, []).append(B.SceneOffset(scene, r.offset, (around[-1] if around else g).end))
    return [B.SceneTable(w, tuple(o)) for w, o in out.items()]


def rebuild_image(image: bytes) -> bytes:
    """The image with fresh scene tables; offsets count the header's own change of length."""
    p = B.open_package(B.Memory(image))
    bare = B.rewrite_header(image, p.header.with_(scene_tables=()))
    tables = scene_tables(B.Memory(bare))
    if not tables:
        return bare
    start = B.open_package(B.Memory(bare))
    change = p.record.last_change_set
    grown = len(p.header.with_(scene_tables=tuple(tables)).encode(change)) - start.content_offset
    return p.header.with_(scene_tables=tuple(tables)).shifted(grown).encode(change) + bare[start.content_offset :]
