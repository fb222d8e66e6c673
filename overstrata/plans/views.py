"""Ordinary tables seen as packages: events are override records, customers a group tree, orders records with line
items as subrecords, documents records of packages by source, conversations change histories."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import model as M
from ..functions import columns as K
from ..operators import ids, ranges
from ..operators.merge import dense_number
from ..operators.tables import Table, keep_until_exit, shared_dir


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pid(n: F.Column) -> F.Column:
    """A package id from a small number."""
    return F.unhex(F.lpad(F.hex(n.cast("long") + 1), 32, "0"))


# --- events: packages by event type ---------------------------------------------------------------


def event_packages(spark: SparkSession, sf: str) -> DataFrame:
    """Event types in order: the second is compact, the fourth an overlay, the others full. As many rows as types."""
    types = load(spark, sf, "events").select("event_type").distinct()
    n = F.row_number().over(W.orderBy("event_type")) - 1
    cls = F.when(F.col("package_index") == 1, M.COMPACT).when(F.col("package_index") == 3, M.OVERLAY).otherwise(M.FULL)
    return types.withColumn("package_index", n).withColumn("load_class", cls).withColumn("package_id", pid(F.col("package_index")))


def event_dependencies(packages: DataFrame) -> DataFrame:
    """Each package depends on all before it, in order."""
    p = packages.select("package_index", F.explode(F.expr("filter(sequence(0, package_index), x -> x < package_index)")).alias("ord"))
    return p.select("package_index", "ord", pid(F.col("ord")).alias("package_id"))


def event_records(spark: SparkSession, sf: str, packages: DataFrame) -> DataFrame:
    """The latest event of each user in each package is the package's record of the user.

    A compact package has 12-bit local ids; users beyond them belong to the first package. Users beyond 24 bits are an error.
    """
    e = load(spark, sf, "events").join(F.broadcast(packages.select("event_type", "package_index")), "event_type")
    local = F.col("user_id") + M.FIRST_FULL_LOCAL
    owner = F.least(F.pmod("user_id", F.lit(3)), F.col("package_index"))
    owner = F.when((owner == 1) & (local > M.MAX_COMPACT_LOCAL), 0).otherwise(owner).cast("long")
    keyed = e.select("package_index", K.record_id(owner, local).alias("record_id"), "event_id", "ts", "value")
    latest = keyed.groupBy("package_index", "record_id").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))
    return latest.withColumns({"signature": F.when(F.col("event_id") % 7 == 0, "USRB").otherwise("USRA"), "flags": F.when(F.col("event_id") % 11 == 0, 1).otherwise(0).cast("long")})


def event_origins(spark: SparkSession, sf: str) -> DataFrame:
    packages = event_packages(spark, sf)
    return ids.resolve(event_records(spark, sf, packages), packages, event_dependencies(packages))


EVENTS_SQL = """types AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS package_index FROM (SELECT DISTINCT event_type FROM events)),
    placed AS (SELECT package_index, CASE WHEN least(user_id % 3, package_index) = 1 AND user_id + 2048 > 4095 THEN 0 ELSE least(user_id % 3, package_index) END AS owner,
        2048 + user_id AS local, event_id, value FROM events JOIN types USING (event_type)),
    recs AS (SELECT package_index, owner, local, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM placed GROUP BY package_index, owner, local),
    origins AS (SELECT package_index, owner * 16777216 + local AS record_id, event_id, value,
        CASE WHEN event_id % 7 = 0 THEN 'USRB' ELSE 'USRA' END AS signature, CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS flags,
        CASE owner WHEN 0 THEN local WHEN 1 THEN 4261412864 + local ELSE 16777216 + local END AS runtime_id FROM recs)"""


# --- customers: a tree of groups ------------------------------------------------------------------

REGION, NATION, CUSTOMER = 2048, 4096, 1_000_000


def tree(spark: SparkSession, sf: str) -> DataFrame:
    """Entries (package_index, pre_order, kind, record_id, label_of, group_type, own_bytes, above) of regions, nations and customers.

    A region's record is followed by its world group, in that a nation's record by its scene group with one group of
    temporary children, the customers. above: (id, type) of the groups around, the outermost first.
    """
    region, nation, customer = (load(spark, sf, t) for t in ("region", "nation", "customer"))
    cust = customer.join(F.broadcast(nation.select("n_nationkey", "n_regionkey")), F.col("c_nationkey") == F.col("n_nationkey"))
    cust = dense_number(cust.select("c_custkey", "c_name", "n_nationkey", "n_regionkey"), "c_custkey", ("n_nationkey",))
    sizes = cust.groupBy("n_nationkey").agg(F.count("*").alias("n"))
    # A fixed handful of regions and nations carries the numbers of all that comes before.
    nat = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).join(sizes, "n_nationkey", "left").withColumn("n", F.coalesce("n", F.lit(0)) + 3)
    order = W.orderBy("n_regionkey", "n_nationkey")
    nat = nat.withColumn("before", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)))
    regions = region.withColumn("rank", F.row_number().over(W.orderBy("r_regionkey")) - 1)
    nat = nat.join(regions.select("r_regionkey", "rank"), "r_regionkey").withColumn("base", F.coalesce("before", F.lit(0)) + 2 * (F.col("rank") + 1))
    above_region = nat.groupBy("r_regionkey").agg(F.sum("n").alias("inside"))
    regions = regions.join(above_region, "r_regionkey", "left").withColumn("inside", F.coalesce("inside", F.lit(0)))
    regions = regions.withColumn("base", F.coalesce(F.sum(F.col("inside") + 2).over(W.orderBy("r_regionkey").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    none = F.expr("cast(array() as array<struct<id:long,type:int>>)")
    step = lambda i, t: F.struct(i.cast("long").alias("id"), F.lit(t).alias("type"))
    rid, nid = F.col("r_regionkey") + REGION, F.col("n_nationkey") + NATION
    name = lambda c: F.octet_length(c).cast("long") + M.RECORD_HEADER_BYTES + M.SUBRECORD_HEADER_BYTES
    null, nol = F.lit(None).cast("int"), F.lit(None).cast("long")

    def entry(df: DataFrame, at: F.Column, record: F.Column, label: F.Column, kind: F.Column, size: F.Column, above: F.Column) -> DataFrame:
        return df.select(F.lit(0).alias("package_index"), at.cast("long").alias("pre_order"), record.cast("long").alias("record_id"), label.cast("long").alias("label_of"), kind.alias("group_type"), size.cast("long").alias("own_bytes"), above.alias("above"))

    head = F.lit(M.GROUP_HEADER_BYTES)
    world = F.array(step(rid, M.WORLD))
    scene = F.array(step(rid, M.WORLD), step(nid, M.SCENE))
    crid = F.col("n_regionkey") + REGION
    temp = F.array(step(crid, M.WORLD), step(nid, M.SCENE), step(nid, M.TEMPORARY_CHILDREN))
    out = entry(regions, F.col("base"), rid, nol, null, name("r_name"), none)
    out = out.union(entry(regions, F.col("base") + 1, nol, rid, F.lit(M.WORLD), head, none))
    out = out.union(entry(nat, F.col("base"), nid, nol, null, name("n_name"), world))
    out = out.union(entry(nat, F.col("base") + 1, nol, nid, F.lit(M.SCENE), head, world))
    out = out.union(entry(nat, F.col("base") + 2, nol, nid, F.lit(M.TEMPORARY_CHILDREN), head, scene))
    placed = cust.join(F.broadcast(nat.select("n_nationkey", F.col("base").alias("nbase"))), "n_nationkey")
    return out.union(entry(placed, F.col("nbase") + 3 + F.col("_n"), F.col("c_custkey") + CUSTOMER, nol, null, name("c_name"), temp))


def tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(records, groups) of the tree, with offsets and paths."""
    t = Table(tree(spark, sf), "tree").df  # read several times below
    groups = t.filter("group_type is not null")
    # Groups are few: two a nation and one a region. Their numbers by (id, type) turn ``above`` into pre-order numbers.
    number = groups.groupBy().agg(F.map_from_entries(F.collect_list(F.struct(F.struct(F.col("label_of").alias("id"), F.col("group_type").alias("type")), "pre_order"))).alias("m"))
    rows = t.join(F.broadcast(number.withColumn("_k", F.lit(0))), F.col("package_index") == F.col("_k")).withColumn("ancestors", F.expr("transform(above, x -> m[x])")).drop("m", "_k")
    placed = Table(ranges.layout(rows), "placed").df
    offsets = placed.filter("group_type is not null").groupBy().agg(F.map_from_entries(F.collect_list(F.struct("pre_order", "header_offset"))).alias("o"))
    placed = placed.join(F.broadcast(offsets.withColumn("_k", F.lit(0))), F.col("package_index") == F.col("_k"))
    path = F.transform(F.arrays_zip("above", "ancestors"), lambda x: F.struct(F.element_at(F.col("o"), x["ancestors"]).alias("header_offset"), K.le32(x["above"]["id"]).alias("label"), x["above"]["type"].alias("group_type")))
    placed = placed.withColumn("path", path).drop("o", "_k", "above", "ancestors")
    records = placed.filter("record_id is not null").select("package_index", F.col("pre_order").alias("record_ord"), "record_id", "header_offset", "own_bytes", "path")
    groups = placed.filter("group_type is not null").select("package_index", "pre_order", "header_offset", (F.col("header_offset") + F.col("total_bytes")).alias("end_offset"), F.col("total_bytes").alias("group_byte_count"), K.le32("label_of").alias("label"), "group_type", "path")
    return records, groups


TREE_SQL = """keyed AS (
        SELECT r_regionkey AS rk, 0 AS s1, -1 AS nk, 0 AS s2, -1::BIGINT AS ck, 2048 + r_regionkey AS record_id, NULL::INT AS group_type, NULL::INT AS label, 60 + strlen(r_name) AS own FROM region
        UNION ALL SELECT r_regionkey, 1, -1, 0, -1, NULL, 1, 2048 + r_regionkey, 16 FROM region
        UNION ALL SELECT n_regionkey, 2, n_nationkey, 0, -1, 4096 + n_nationkey, NULL, NULL, 60 + strlen(n_name) FROM nation
        UNION ALL SELECT n_regionkey, 2, n_nationkey, 1, -1, NULL, 6, 4096 + n_nationkey, 16 FROM nation
        UNION ALL SELECT n_regionkey, 2, n_nationkey, 2, -1, NULL, 9, 4096 + n_nationkey, 16 FROM nation
        UNION ALL SELECT n_regionkey, 2, n_nationkey, 3, c_custkey, 1000000 + c_custkey, NULL, NULL, 60 + strlen(c_name) FROM customer JOIN nation ON c_nationkey = n_nationkey),
    entries AS (SELECT *, (row_number() OVER w - 1)::BIGINT AS pre_order, (sum(own) OVER w - own)::BIGINT AS header_offset FROM keyed WINDOW w AS (ORDER BY rk, s1, nk, s2, ck ROWS UNBOUNDED PRECEDING)),
    grp AS (SELECT g.rk, g.nk, g.group_type, g.label, g.pre_order, g.header_offset, sum(e.own)::BIGINT AS total_bytes FROM entries g JOIN entries e ON e.rk = g.rk
        AND CASE g.group_type WHEN 1 THEN e.s1 >= 1 WHEN 6 THEN e.nk = g.nk AND e.s1 = 2 AND e.s2 >= 1 ELSE e.nk = g.nk AND e.s1 = 2 AND e.s2 >= 2 END
        WHERE g.group_type IS NOT NULL GROUP BY ALL)"""


# --- orders: records with line items as subrecords ------------------------------------------------


def line_fields(spark: SparkSession, sf: str) -> DataFrame:
    """(record_id, half, ord, signature, payload): each order's lines in a full-row order, odd and even line numbers apart.

    (order, line number) is no key, so the whole row orders them.
    """
    li = load(spark, sf, "lineitem")
    full = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    rows = li.select(F.col("l_orderkey").alias("record_id"), F.pmod("l_linenumber", F.lit(2)).alias("half"), F.col("l_returnflag").alias("signature"), F.pmod("l_partkey", F.lit(5)).cast("string").alias("payload"), *full)
    n = F.row_number().over(W.partitionBy("record_id", "half").orderBy(*full))
    return rows.select("record_id", "half", (n - 1).alias("ord"), "signature", "payload")


def field_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """(record_id, dst_fields, src_fields): odd lines are the destination's fields, even ones the source's."""
    f = line_fields(spark, sf)
    side = lambda h: F.transform(F.array_sort(F.collect_list(F.when(F.col("half") == h, F.struct("ord", "signature", "payload")))), lambda x: F.struct(x["signature"].alias("signature"), x["payload"].alias("payload")))
    return f.groupBy("record_id").agg(side(1).alias("dst_fields"), side(0).alias("src_fields"))


FIELDS_SQL = """fields AS (SELECT l_orderkey AS record_id, l_linenumber % 2 AS half, l_returnflag AS signature, (l_partkey % 5)::VARCHAR AS payload,
        row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS ord FROM lineitem),
    dst AS (SELECT * FROM fields WHERE half = 1), src AS (SELECT * FROM fields WHERE half = 0)"""


# --- orders: written as package files and read again ----------------------------------------------

PER_PACKAGE = 1 << 16


def order_packages(spark: SparkSession, sf: str) -> str:
    """A folder with the orders as packages of up to 65,536 records each, in one group; the folder goes with the session."""
    from .. import codec as B
    from ..sources import package_sink, package_source

    o = load(spark, sf, "orders")
    local = F.pmod("o_orderkey", F.lit(PER_PACKAGE)) + M.FIRST_FULL_LOCAL
    field = lambda s, v: F.struct(F.lit(s).alias("signature"), v.alias("payload"))
    fields = F.array(field(b"EDID", F.encode("o_orderpriority", "UTF-8")), field(b"VALU", K.le32("o_custkey")))
    step = "array(named_struct('header_offset', 0L, 'label', X'4954454D', 'group_type', 0))"
    rows = o.select(
        F.floor(F.col("o_orderkey") / PER_PACKAGE).cast("int").alias("package_index"), (local + 1).cast("long").alias("pre_order"), F.lit(b"ITEM").alias("signature"), K.encode_fields(fields).alias("payload"),
        F.lit(0).cast("long").alias("flags"), local.cast("long").alias("record_id"), F.unhex(F.lit("0000803F")).alias("version_raw"), F.unhex(F.lit("00" * 32)).alias("last_change_set"), F.expr(step).alias("path"),
    )

    @F.udf("binary", useArrow=True)
    def header(index, n):
        return B.Header((int(index) + 1).to_bytes(16, "big"), next_local=PER_PACKAGE + M.FIRST_FULL_LOCAL, record_count=int(n), owned_record_count=int(n), schema_namespace="orders").encode()

    folder = f"{shared_dir(spark)}/overstrata-packages-{uuid.uuid4().hex[:12]}"
    keep_until_exit(spark, folder)
    B.file_system(folder)[0].create_dir(B.file_system(folder)[1])
    counts = rows.groupBy("package_index").agg(F.count("*").alias("n"))
    packages = counts.select("package_index", F.concat(F.lit(folder + "/"), F.lpad(F.col("package_index").cast("string"), 8, "0"), F.lit(".pcp")).alias("path"), header("package_index", "n").alias("header"))
    groups = counts.select("package_index", F.lit(0).cast("long").alias("pre_order"), F.lit(0).cast("long").alias("header_offset"), F.lit(b"ITEM").alias("label"), F.lit(0).alias("group_type"), F.expr(f"filter({step}, x -> false)").alias("path"))
    package_source.register(spark)
    package_sink.encode_packages(packages, groups, rows).select("path", "content").write.format("overstrata").mode("append").save()
    return folder
