"""Queries of the core operators over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model as M
from ..functions import columns as K
from ..operators import compose, edit, graph, history, ids, index, merge, metadata, overrides, ranges, validate
from ..operators.tables import Table
from ..sources import package_source
from . import views as V

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- override chains ------------------------------------------------------------------------------

E, T, FIELDS = V.EVENTS_SQL, V.TREE_SQL, V.FIELDS_SQL


@query(f"""WITH {E} SELECT runtime_id, count(*) AS chain_length, max(package_index) AS winner_package, arg_max(event_id, package_index) AS event_id
    FROM origins GROUP BY runtime_id""")
def override_chain_winner(spark, sf):
    return overrides.winners(V.event_origins(spark, sf), "event_id")


@query(f"WITH {E} SELECT runtime_id, row_number() OVER (PARTITION BY runtime_id ORDER BY package_index) - 1 AS position, package_index, event_id FROM origins")
def override_chain_members(spark, sf):
    c = overrides.chains(V.event_origins(spark, sf), "event_id")
    return c.select("runtime_id", F.posexplode("chain").alias("position", "o")).select("runtime_id", F.col("position").cast("long").alias("position"), "o.package_index", "o.event_id")


@query(f"WITH {E} SELECT runtime_id, package_index, event_id FROM origins QUALIFY row_number() OVER (PARTITION BY runtime_id ORDER BY package_index) = 2")
def override_chain_nth_origin(spark, sf):
    return overrides.nth_origin(V.event_origins(spark, sf), 1).select("runtime_id", "package_index", "event_id")


@query(f"WITH {E} SELECT runtime_id, count(*) AS chain_length FROM origins GROUP BY runtime_id")
def override_count(spark, sf):
    return overrides.counts(V.event_origins(spark, sf))


@query(f"""WITH {E}, w AS (SELECT runtime_id, arg_max(event_id, package_index) AS event_id, arg_max(flags, package_index) AS flags FROM origins GROUP BY runtime_id)
    SELECT runtime_id, event_id FROM w WHERE flags & 1 = 0""")
def live_winners(spark, sf):
    return overrides.live_winners(V.event_origins(spark, sf), "event_id").select("runtime_id", "event_id")


@query(f"""WITH {E} SELECT runtime_id, max(package_index) AS winner_package, arg_max(event_id, package_index) AS event_id FROM origins
    GROUP BY runtime_id ORDER BY runtime_id LIMIT 1 OFFSET 3""")
def winning_record_at(spark, sf):
    return overrides.winning_record_at(V.event_origins(spark, sf), 3, "event_id").select("runtime_id", "winner_package", "event_id")


@query(f"WITH {E} SELECT runtime_id, max(package_index) AS package_index FROM origins WHERE value < 20 GROUP BY runtime_id")
def streaming_winner(spark, sf):
    return overrides.streaming_winners(V.event_origins(spark, sf).filter("value < 20"))


@query(f"WITH {E} SELECT package_index, record_id, runtime_id, upper(lpad(to_hex(runtime_id), 8, '0')) AS shown FROM origins")
def runtime_id_translate(spark, sf):
    return V.event_origins(spark, sf).select("package_index", "record_id", "runtime_id", K.show_id("runtime_id").alias("shown"))


@query(f"""WITH {E}, r AS (SELECT DISTINCT runtime_id FROM origins)
    SELECT package_index, runtime_id, CASE WHEN runtime_id >= 4261412864 THEN CASE WHEN package_index >= 1 THEN 16777216 + (runtime_id & 4095) END
        WHEN runtime_id >= 16777216 THEN CASE WHEN package_index >= 2 THEN 2 * 16777216 + (runtime_id & 16777215) END ELSE runtime_id END AS record_id
    FROM r, (SELECT package_index FROM types) p""")
def runtime_id_serialize(spark, sf):
    packages = V.event_packages(spark, sf)
    known = V.event_origins(spark, sf).select("runtime_id").distinct()
    # Every id as each of the packages would write it; they are numbered from 0.
    rows = known.withColumn("package_index", F.explode(F.sequence(F.lit(0), F.lit(packages.count() - 1))))
    return ids.serialize(rows, packages, V.event_dependencies(packages)).select("package_index", "runtime_id", "record_id")


@query("""WITH p AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS package_index FROM (SELECT DISTINCT source FROM documents)),
    q AS (SELECT *, package_index % 3 AS load_class FROM p)
    SELECT source, package_index, load_class, CASE WHEN load_class < 2 THEN row_number() OVER (PARTITION BY load_class ORDER BY package_index) - 1 END AS slot FROM q""")
def slot_assignment(spark, sf):
    return ids.assign_slots(_sources(spark, sf)).select("source", "package_index", "load_class", "slot")


def _sources(spark, sf):
    """Sources as packages, by name; as many rows as sources."""
    from pyspark.sql import Window as W

    s = V.load(spark, sf, "documents").select("source").distinct().withColumn("package_index", F.row_number().over(W.orderBy("source")) - 1)
    return s.withColumn("load_class", F.pmod("package_index", F.lit(3)))


# --- index ----------------------------------------------------------------------------------------


@query("SELECT doc_id, source, n_chars FROM documents WHERE lang = 'fr'")
def records_by_signature(spark, sf):
    return index.by_signature(V.load(spark, sf, "documents"), "fr", order="doc_id", column="lang").select("doc_id", "source", "n_chars")


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 5")
def record_point_lookup(spark, sf):
    return index.record(V.load(spark, sf, "documents"), 5, key="doc_id").select("doc_id", "lang", "source", "n_chars")


@query("SELECT position, doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents) WHERE position IN (0, 17, 150)")
def record_positional(spark, sf):
    return index.record_at(V.load(spark, sf, "documents").select("doc_id"), 0, 17, 150, order="doc_id", package=None).select("position", "doc_id")


_FLAGS = "cast(o_orderkey % 2 + 2 * (o_custkey % 2) + 4 * (o_orderkey % 8) as long)"


@query("SELECT o_orderkey, o_orderkey % 2 + 2 * (o_custkey % 2) + 4 * (o_orderkey % 8) AS flags, 4 * (o_orderkey % 8) AS application_bits FROM orders WHERE o_orderkey % 2 = 1 AND o_custkey % 2 = 1")
def flag_filter(spark, sf):
    o = V.load(spark, sf, "orders").select("o_orderkey", F.expr(_FLAGS).alias("flags"))
    return index.with_flags(o, M.DELETED | M.PERSISTENT).withColumn("application_bits", K.application_bits("flags"))


@query(f"WITH {FIELDS} SELECT record_id, ord, signature, payload FROM dst")
def subrecord_explode(spark, sf):
    a = V.field_arrays(spark, sf)
    return a.select("record_id", F.posexplode("dst_fields").alias("ord", "f")).select("record_id", F.col("ord").cast("long").alias("ord"), "f.signature", "f.payload")


@query(f"""WITH {FIELDS} SELECT record_id, signature, ord, payload FROM dst QUALIFY row_number() OVER (PARTITION BY record_id, signature ORDER BY ord) = 2""")
def subrecord_nth_occurrence(spark, sf):
    f = V.line_fields(spark, sf).filter("half = 1")
    return index.nth_occurrence(index.number_occurrences(f, "ord"), 1).select("record_id", "signature", F.col("ord").cast("long").alias("ord"), "payload")


@query(f"""WITH {FIELDS}, n AS (SELECT *, row_number() OVER (PARTITION BY record_id, signature ORDER BY ord) - 1 AS occurrence FROM dst)
    SELECT record_id, ord, signature, CASE WHEN signature = 'R' AND occurrence = 1 THEN 'edited' ELSE payload END AS payload FROM n""")
def subrecord_replace_nth(spark, sf):
    a = V.field_arrays(spark, sf).withColumn("fields", edit.replace_nth(F.col("dst_fields"), "R", 1, F.lit("edited")))
    return a.select("record_id", F.posexplode("fields").alias("ord", "f")).select("record_id", F.col("ord").cast("long").alias("ord"), "f.signature", "f.payload")


@query("""SELECT 'DuplicateRecordId' AS code, l_linenumber::BIGINT AS package_index, l_orderkey AS record_id, count(*) AS actual FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
    UNION ALL SELECT 'RecordCountMismatch', l_linenumber, NULL, count(*) FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY l_linenumber""")
def index_integrity(spark, sf):
    # Line numbers as packages whose headers promise the right counts, but for the even ones.
    li = V.load(spark, sf, "lineitem").select(F.col("l_linenumber").alias("package_index"), F.col("l_orderkey").alias("record_id"), F.lit(b"ITEM").alias("signature"))
    counts = li.groupBy("package_index").agg(F.count("*").alias("n"), F.count_if(K.package_index("record_id") == 0).alias("owned"))
    packages = counts.select("package_index", (F.col("n") + (F.col("package_index") + 1) % 2).alias("record_count"), F.col("owned").alias("owned_record_count"))
    none = spark.createDataFrame([], M.RELATIONS)
    return index.integrity(li, packages, none).select("code", F.col("package_index").cast("long").alias("package_index"), "record_id", "actual")


# --- groups and bytes -----------------------------------------------------------------------------


@query(f"WITH {T} SELECT record_id, 2048 + rk AS world_id, pre_order FROM entries WHERE ck >= 0 AND rk = 2")
def group_path_records(spark, sf):
    r, _ = V.tables(spark, sf)
    inside = index.in_group_type(r, M.TEMPORARY_CHILDREN).withColumn("world_id", K.label_id(F.get("path", F.lit(0))["label"]))
    return inside.filter(F.col("world_id") == V.REGION + 2).select("record_id", "world_id", F.col("record_ord").alias("pre_order"))


@query(f"WITH {T} SELECT record_id FROM entries WHERE record_id IS NOT NULL AND nk = 7 AND s2 = 3")
def group_descendants(spark, sf):
    r, _ = V.tables(spark, sf)
    return index.descendants(r, M.label_from_id(V.NATION + 7)).select("record_id")


@query(f"""WITH {T}, c AS (SELECT * FROM entries WHERE ck >= 0)
    SELECT DISTINCT record_id FROM (SELECT record_id FROM c UNION ALL SELECT 2048 + rk FROM c UNION ALL SELECT 4096 + nk FROM c)""")
def group_ancestors(spark, sf):
    """All customers with the records above them."""
    r, _ = V.tables(spark, sf)
    edges = r.select(F.col("record_id").alias("a"), F.explode("path").alias("g")).select("a", K.label_id("g.label").alias("b")).distinct()
    start = r.filter(F.col("record_id") >= V.CUSTOMER).select(F.col("record_id").alias("node"))
    return graph.closure(edges, start).select(F.col("node").alias("record_id"))


@query(f"WITH {T} SELECT pre_order, group_type, label, total_bytes AS group_byte_count FROM grp")
def group_sizes(spark, sf):
    _, g = V.tables(spark, sf)
    return g.select("pre_order", "group_type", K.label_id("label").alias("label"), "group_byte_count")


@query(f"WITH {T} SELECT pre_order, record_id, label, header_offset FROM entries")
def entry_offsets(spark, sf):
    t = ranges.running_sum(Table(V.tree(spark, sf), "tree").df, "pre_order", "own_bytes", "header_offset")
    return t.select("pre_order", "record_id", F.col("label_of").alias("label"), "header_offset")


@query(f"""WITH {T} SELECT 2048 + t.rk AS world_id, t.label AS scene_id, n.header_offset AS start_offset, c.header_offset + c.total_bytes AS end_offset
    FROM grp t JOIN grp c ON c.nk = t.nk AND c.group_type = 6 JOIN entries n ON n.record_id = t.label WHERE t.group_type = 9""")
def scene_offset_index(spark, sf):
    r, g = V.tables(spark, sf)
    return ranges.scene_offsets(g, r).select("world_id", "scene_id", "start_offset", "end_offset")


@query(f"""WITH {T}, s AS (SELECT n.header_offset AS a, c.header_offset + c.total_bytes AS b FROM grp c JOIN entries n ON n.record_id = c.label WHERE c.group_type = 6 AND c.label = 4103)
    SELECT record_id, header_offset FROM entries, s WHERE record_id IS NOT NULL AND header_offset >= a AND header_offset < b""")
def range_read(spark, sf):
    r, g = V.tables(spark, sf)
    at = ranges.scene_offsets(g, r).filter(F.col("scene_id") == V.NATION + 7).first()
    return ranges.read_range(r, at.start_offset, at.end_offset).select("record_id", "header_offset")


@query(f"WITH {T} SELECT group_type, CASE group_type WHEN 1 THEN 'WorldChildren' WHEN 6 THEN 'SceneChildren' ELSE 'SceneTemporaryChildren' END AS name, count(*) AS n, sum(total_bytes)::BIGINT AS bytes FROM grp GROUP BY ALL")
def group_type_summary(spark, sf):
    _, g = V.tables(spark, sf)
    return g.groupBy("group_type", K.group_type_name("group_type").alias("name")).agg(F.count("*").alias("n"), F.sum("group_byte_count").alias("bytes"))


@query("SELECT c_custkey, c_custkey % 300 - 150 AS x, c_nationkey - 12 AS y, upper(lpad(to_hex(c_custkey), 8, '0')) AS shown FROM customer")
def label_forms(spark, sf):
    c = V.load(spark, sf, "customer")
    u16 = lambda v: F.substring(K.le32(F.pmod(v, F.lit(65536))), 1, 2)
    label = F.concat(u16(F.col("c_nationkey") - 12), u16(F.col("c_custkey") % 300 - 150))
    return c.select("c_custkey", K.label_grid(label).alias("g"), K.show_id("c_custkey").alias("shown")).select("c_custkey", F.col("g.x").cast("long").alias("x"), F.col("g.y").alias("y"), "shown")


# --- validation -----------------------------------------------------------------------------------


@query(f"""WITH {E}, t AS (SELECT package_index, max(local) AS top FROM recs WHERE owner = package_index GROUP BY package_index)
    SELECT 'PCP-NEXT-ID-COLLISION' AS code, package_index, 2100 AS record_id, top AS related FROM t WHERE top >= 2100""")
def validate_next_id(spark, sf):
    p = V.event_packages(spark, sf)
    r = V.event_records(spark, sf, p)
    heads = p.select("package_index", F.lit(2100).cast("long").alias("next_local_identifier"))
    return validate.next_id_collisions(heads, r, V.event_dependencies(p)).drop("severity")


@query(f"""WITH {T}, r AS (SELECT * FROM entries WHERE record_id IS NOT NULL AND record_id NOT IN (2049, 4099)),
    e AS (SELECT record_id, 2048 + rk AS parent FROM r WHERE s1 = 2 UNION ALL SELECT record_id, 4096 + nk FROM r WHERE s2 = 3)
    SELECT 'PCP-ORPHANED-RECORD-PATH' AS code, record_id, parent AS related FROM e WHERE parent IN (2049, 4099)""")
def validate_orphans(spark, sf):
    r, _ = V.tables(spark, sf)
    left = r.filter(~F.col("record_id").isin(V.REGION + 1, V.NATION + 3))
    return validate.orphaned_paths(left).select("code", "record_id", "related")


@query(f"""WITH {E}, s AS (SELECT DISTINCT p.package_index, o.record_id FROM origins o, (SELECT package_index FROM types) p WHERE o.value < 20 AND p.package_index >= o.package_index)
    SELECT 'PCP-STREAMING-OVERRIDE-MISSING' AS code, package_index, record_id FROM s ANTI JOIN origins USING (package_index, record_id)""")
def validate_streaming_missing(spark, sf):
    # Each package lists what it or an earlier one has; what it has no record of itself is missing.
    p = V.event_packages(spark, sf)
    r = V.event_records(spark, sf, p)
    listed = r.filter("value < 20").select(F.explode(F.sequence("package_index", F.lit(p.count() - 1))).alias("package_index"), "record_id").distinct()
    return validate.missing_streaming_overrides(listed, r).select("code", "package_index", "record_id")


@query(f"""WITH {E} SELECT CASE WHEN count(DISTINCT signature) > 1 THEN 'PCP-OVERRIDE-TYPE-MISMATCH' ELSE 'PCP-OVERRIDE-CHAIN' END AS code,
    CASE WHEN count(DISTINCT signature) > 1 THEN 'Error' ELSE 'Information' END AS severity, runtime_id, count(*) AS chain_length FROM origins GROUP BY runtime_id HAVING count(*) > 1""")
def validate_override_types(spark, sf):
    return validate.load_order(V.event_origins(spark, sf))


@query("""WITH p AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS package_index, count(*) AS n FROM documents GROUP BY source)
    SELECT CASE WHEN package_index % 3 = 1 THEN 'CompactRecordLimitExceeded' ELSE 'OverlayOwnsRecords' END AS code, package_index, n * 100 AS related FROM p
    WHERE (package_index % 3 = 1 AND n * 100 > 4096) OR package_index % 3 = 2""")
def validate_load_class(spark, sf):
    n = V.load(spark, sf, "documents").groupBy("source").agg((F.count("*") * 100).alias("owned_record_count"))
    p = _sources(spark, sf).join(n, "source").withColumn("next_local_identifier", F.lit(1).cast("long"))
    return validate.load_class_rules(p).select("code", "package_index", "related")


# --- versions and dependencies --------------------------------------------------------------------


@query("""WITH v AS (SELECT DISTINCT p_size % 4 AS a, p_size % 3 AS b, p_size % 7 AS c, p_size % 2 AS k FROM part)
    SELECT a || '.' || b || '.' || c AS version, CASE k WHEN 0 THEN '>=1.1.0, <3.0.0' ELSE '^2.1' END AS requirement,
        CASE k WHEN 0 THEN (a > 1 OR (a = 1 AND b >= 1)) AND a < 3 ELSE a = 2 AND b >= 1 END AS matches FROM v""")
def semver_match(spark, sf):
    p = V.load(spark, sf, "part")
    part = lambda n: F.pmod("p_size", F.lit(n)).cast("string")
    v = p.select(F.concat_ws(".", part(4), part(3), part(7)).alias("version"), F.when(F.pmod("p_size", F.lit(2)) == 0, ">=1.1.0, <3.0.0").otherwise("^2.1").alias("requirement")).distinct()
    return v.withColumn("matches", graph.semver_matches("requirement", "version"))


def _nations(spark, sf):
    """(packages, dependencies): odd nations depend on nation (7 n + 3) mod 30, of which some are none; threes ask for version 2."""
    n = V.load(spark, sf, "nation").select(F.col("n_nationkey").alias("n"))
    packages = n.select(F.col("n").alias("package_id"), F.concat(F.pmod("n", F.lit(3)) + 1, F.lit(".0.0")).alias("package_version"))
    deps = n.filter("n % 2 = 1").select(F.col("n").alias("package_id"), F.pmod(F.col("n") * 7 + 3, F.lit(30)).alias("dep_package_id"), F.when(F.pmod("n", F.lit(3)) == 0, ">=2.0.0").alias("requirement"))
    return packages, deps.filter("package_id <> dep_package_id")


@query("""WITH RECURSIVE deps AS (SELECT n_nationkey AS package_id, (n_nationkey * 7 + 3) % 30 AS related, n_nationkey % 3 = 0 AS two FROM nation WHERE n_nationkey % 2 = 1 AND n_nationkey <> (n_nationkey * 7 + 3) % 30),
    base AS (SELECT package_id, CASE WHEN n_nationkey IS NULL THEN 'MissingDependency' ELSE 'DependencyVersionMismatch' END AS code, related FROM deps LEFT JOIN nation ON n_nationkey = related
        WHERE n_nationkey IS NULL OR (two AND n_nationkey % 3 + 1 < 2)),
    bad AS (SELECT DISTINCT package_id FROM base UNION SELECT d.package_id FROM deps d JOIN bad ON d.related = bad.package_id)
    SELECT package_id, code, 'Error' AS severity, related FROM base
    UNION ALL SELECT DISTINCT d.package_id, 'DependencyUnavailable', 'Error', d.related FROM deps d JOIN bad ON d.related = bad.package_id JOIN nation ON n_nationkey = d.related""")
def dependency_availability(spark, sf):
    packages, deps = _nations(spark, sf)
    return graph.availability(packages, deps)


@query("""WITH deps AS (SELECT n_nationkey AS package_index, (n_nationkey * 7 + 3) % 30 AS related, n_nationkey % 3 = 0 AS two FROM nation WHERE n_nationkey % 2 = 1 AND n_nationkey <> (n_nationkey * 7 + 3) % 30)
    SELECT package_index, CASE WHEN n_nationkey IS NULL OR n_nationkey >= package_index THEN 'MissingDependency' ELSE 'DependencyVersionMismatch' END AS code, related FROM deps LEFT JOIN nation ON n_nationkey = related
    WHERE n_nationkey IS NULL OR n_nationkey >= package_index OR (two AND n_nationkey % 3 + 1 < 2)""")
def load_order_violations(spark, sf):
    packages, deps = _nations(spark, sf)
    p = packages.withColumn("package_index", F.col("package_id"))
    d = deps.select(F.col("package_id").alias("package_index"), F.lit(0).alias("ord"), F.col("dep_package_id").alias("package_id"), "requirement")
    none = spark.createDataFrame([], "package_index int, ord int, package_id int, requirement string")
    return graph.load_order_violations(p, d, none).select("package_index", "code", "related")


@query("SELECT (row_number() OVER (ORDER BY n_nationkey // 4, n_nationkey DESC) - 1)::INT AS position, n_nationkey AS package FROM nation")
def load_order_repair(spark, sf):
    """(position, package) of the repaired order of nations, where n depends on n + 1 but for every fourth."""
    names = [r.n_nationkey for r in V.load(spark, sf, "nation").orderBy("n_nationkey").collect()]  # the packages of one load order
    order, _ = graph.repair_order(names, {n: [n + 1] for n in names if n % 4 != 3 and n + 1 in names})
    return spark.createDataFrame(list(enumerate(order)), "position int, package int")


# --- merge ----------------------------------------------------------------------------------------


def _halves(spark, sf):
    o = V.load(spark, sf, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("custkey"), F.col("o_orderpriority").alias("priority"))
    dst = o.filter("record_id % 3 <> 0")
    src = o.filter("record_id % 2 = 0").withColumn("custkey", F.col("custkey") + 1).withColumn("gone", F.expr("record_id % 10 = 0 and record_id % 3 <> 0"))
    return dst, src


_UPSERT = """d AS (SELECT o_orderkey AS record_id, o_custkey AS custkey, o_orderpriority AS priority FROM orders WHERE o_orderkey % 3 <> 0),
    s AS (SELECT o_orderkey AS record_id, o_custkey + 1 AS custkey, o_orderpriority AS priority FROM orders WHERE o_orderkey % 2 = 0),
    m AS (SELECT coalesce(d.record_id, s.record_id) AS record_id, CASE WHEN s.record_id IS NULL THEN 'keep' WHEN d.record_id IS NULL THEN 'add' WHEN s.record_id % 10 = 0 THEN 'delete' ELSE 'override' END AS op,
        d.custkey AS dc, d.priority AS dp, s.custkey AS sc, s.priority AS sp FROM d FULL JOIN s USING (record_id))"""


@query(f"WITH {_UPSERT} SELECT record_id, op, CASE WHEN op IN ('add', 'override') THEN sc ELSE dc END AS custkey, CASE WHEN op IN ('add', 'override') THEN sp ELSE dp END AS priority FROM m")
def merge_upsert(spark, sf):
    dst, src = _halves(spark, sf)
    return merge.upsert(dst, src, "record_id", ["custkey", "priority"], deleted=F.col("gone"))


@query(f"WITH {_UPSERT} SELECT op, count(*) AS n FROM m GROUP BY op")
def merge_operation_counts(spark, sf):
    return merge_upsert(spark, sf).groupBy("op").agg(F.count("*").alias("n"))


@query(f"WITH {_UPSERT} SELECT record_id, custkey FROM m WHERE op = 'add'".replace("custkey FROM m", "sc AS custkey FROM m"))
def merge_additions_only(spark, sf):
    dst, src = _halves(spark, sf)
    return merge.upsert(dst, src, "record_id", ["custkey", "priority"], deleted=F.lit(False), include_overrides=False).filter("op = 'add'").select("record_id", "custkey")


@query("""SELECT o_orderkey AS record_id, 2047 + row_number() OVER (ORDER BY o_orderkey) AS new_id FROM orders WHERE o_orderkey % 6 = 0""")
def merge_id_allocation(spark, sf):
    _, src = _halves(spark, sf)
    return merge.allocate_ids(src, 2048, 0, order="record_id", own=F.expr("record_id % 3 = 0")).select("record_id", "new_id")


@query(f"""WITH {_UPSERT} SELECT row_number() OVER (ORDER BY record_id) - 1 AS n, op, record_id, sha256(CASE WHEN op = 'delete' THEN '' ELSE sc || '|' || sp END) AS digest FROM m WHERE op <> 'keep'""")
def merge_operation_log(spark, sf):
    rows = merge_upsert(spark, sf)
    text = F.when(F.col("op") == "delete", "").otherwise(F.concat_ws("|", "custkey", "priority"))
    rows = rows.withColumns({"digest": F.sha2(F.encode(text, "UTF-8"), 256), "previous": F.lit(None).cast("string")})
    return merge.operation_log(rows, "record_id").drop("previous")


@query(f"WITH {T} SELECT record_id FROM entries WHERE record_id IS NOT NULL AND rk = 1")
def merge_selected_subtree(spark, sf):
    r, _ = V.tables(spark, sf)
    return merge.select_records(r, V.REGION + 1, descendants=True).filter("not parent_missing").select("record_id")


@query(f"WITH {T} SELECT record_id, CASE WHEN s2 = 3 THEN 4096 + nk + 16777216 ELSE 2048 + rk + 16777216 END AS parent FROM entries WHERE record_id IS NOT NULL AND s1 = 2")
def merge_reference_rewrite(spark, sf):
    # Each record names its parent in a reference field; the parents have new ids.
    r, _ = V.tables(spark, sf)
    fields = r.filter(F.size("path") > 0).select("record_id", F.lit(b"ENTY").alias("record_signature"), F.lit(b"BASE").alias("signature"), F.element_at("path", -1)["label"].alias("payload"))
    id_map = r.select("record_id", (F.col("record_id") + (1 << 24)).alias("new_id"))
    return merge.rewrite_references(fields, id_map, [("ENTY", "BASE")]).select("record_id", K.from_le("payload").alias("parent"))


# --- composition ----------------------------------------------------------------------------------


def _composed(spark, sf, rule):
    a = compose.compose_override(V.field_arrays(spark, sf), [rule])
    return a.select("record_id", F.posexplode("fields").alias("ord", "f")).select("record_id", F.col("ord").cast("long").alias("ord"), "f.signature", "f.payload")


def _composed_sql(rows: str) -> str:
    return f"WITH {FIELDS}, ids AS (SELECT DISTINCT record_id FROM fields), r AS ({rows}) SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY k, ord) - 1 AS ord, signature, payload FROM r"


@query(_composed_sql("""SELECT d.record_id, CASE WHEN d.ord < coalesce(f.at, 1000000) THEN 1 ELSE 3 END AS k, d.ord, signature, payload FROM dst d
    LEFT JOIN (SELECT record_id, min(ord) AS at FROM dst WHERE signature = 'R' GROUP BY record_id) f USING (record_id) WHERE signature <> 'R'
    UNION ALL SELECT record_id, 2, ord, signature, payload FROM src WHERE signature = 'R'"""))
def compose_replace(spark, sf):
    return _composed(spark, sf, compose.Rule("R", compose.REPLACE))


@query(_composed_sql("SELECT record_id, 1 AS k, ord, signature, payload FROM dst"))
def compose_keep(spark, sf):
    return _composed(spark, sf, compose.Rule("R", compose.KEEP))


@query(_composed_sql("SELECT record_id, 1 AS k, ord, signature, payload FROM dst UNION ALL SELECT record_id, 2, ord, signature, payload FROM src WHERE signature = 'R'"))
def compose_append(spark, sf):
    return _composed(spark, sf, compose.Rule("R", compose.APPEND))


_DEDUP = """SELECT record_id, 1 AS k, ord, signature, payload FROM dst UNION ALL SELECT record_id, 2, min(ord), signature, payload FROM src ANTI JOIN dst USING (record_id, signature, payload)
    WHERE signature = 'R' GROUP BY record_id, signature, payload"""


@query(_composed_sql(_DEDUP))
def compose_append_dedup(spark, sf):
    return _composed(spark, sf, compose.Rule("R", compose.APPEND, deduplicate=True))


@query(_composed_sql(_DEDUP))
def compose_chain(spark, sf):
    """The fold of a chain of two records, which is the composition of the second onto the first."""
    a = V.field_arrays(spark, sf)
    chain = F.array(*[F.struct(F.col(c).alias("fields")) for c in ("dst_fields", "src_fields")])
    c = compose.compose_chain(a.withColumn("chain", chain), [compose.Rule("R", compose.APPEND, deduplicate=True)])
    return c.select("record_id", F.posexplode("fields").alias("ord", "f")).select("record_id", F.col("ord").cast("long").alias("ord"), "f.signature", "f.payload")


_LISTS = f"""WITH {FIELDS}, ids AS (SELECT DISTINCT record_id FROM fields), l AS (SELECT record_id, coalesce((SELECT list(payload ORDER BY ord) FROM dst WHERE dst.record_id = ids.record_id), []) AS d,
    coalesce((SELECT list(payload ORDER BY ord) FROM src WHERE src.record_id = ids.record_id), []) AS s FROM ids)"""


def _lists(spark, sf):
    a = V.field_arrays(spark, sf)
    return a.select("record_id", *[F.transform(f"{c}_fields", lambda x: x["payload"]).alias(c) for c in ("dst", "src")])


@query(f"{_LISTS} SELECT record_id, array_to_string(list_concat(d, s), ',') AS items FROM l")
def list_append_all(spark, sf):
    return _lists(spark, sf).select("record_id", F.array_join(K.append_all("dst", "src"), ",").alias("items"))


@query(f"{_LISTS} SELECT record_id, array_to_string(list_concat(d, s[len(d) + 1:]), ',') AS items FROM l")
def list_append_new_indices(spark, sf):
    return _lists(spark, sf).select("record_id", F.array_join(K.append_new_indices("dst", "src"), ",").alias("items"))


@query(f"""WITH {FIELDS}, u AS (SELECT record_id, 1 AS k, ord, payload FROM dst UNION ALL SELECT record_id, 2, min(ord), payload FROM src ANTI JOIN dst USING (record_id, payload) GROUP BY record_id, payload)
    SELECT record_id, string_agg(payload, ',' ORDER BY k, ord) AS items FROM u GROUP BY record_id""")
def list_append_unique(spark, sf):
    return _lists(spark, sf).select("record_id", F.array_join(K.append_unique("dst", "src"), ",").alias("items"))


def _le(x: str) -> str:
    h = f"upper(lpad(to_hex(({x})::BIGINT), 8, '0'))"
    return f"(substr({h}, 7, 2) || substr({h}, 5, 2) || substr({h}, 3, 2) || substr({h}, 1, 2))"


@query(f"""WITH s AS (SELECT DISTINCT user_id, event_type FROM events)
    SELECT user_id, {_le('count(*)')} || string_agg({_le('strlen(event_type)')} || hex(event_type), '' ORDER BY event_type) AS encoded FROM s GROUP BY user_id""")
def set_canonical(spark, sf):
    e = V.load(spark, sf, "events").groupBy("user_id").agg(F.collect_set(F.encode("event_type", "UTF-8")).alias("items"))
    return e.select("user_id", F.hex(K.encode_set("items")).alias("encoded"))


@query(f"""WITH s AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
    SELECT user_id, {_le('count(*)')} || string_agg({_le('strlen(event_type)')} || hex(event_type) || '04000000' || {_le('n')}, '' ORDER BY event_type) AS encoded FROM s GROUP BY user_id""")
def map_canonical(spark, sf):
    e = V.load(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = e.groupBy("user_id").agg(F.collect_list(F.struct(F.encode("event_type", "UTF-8").alias("k"), K.le32("n").alias("v"))).alias("pairs"))
    return m.select("user_id", F.hex(K.encode_map("pairs")).alias("encoded"))


# --- history --------------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def content_digest(spark, sf):
    return V.load(spark, sf, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("digest"))


@query(f"""WITH o AS (SELECT o_orderkey, {_le('strlen(o_orderpriority)')} || hex(o_orderpriority) AS f FROM orders)
    SELECT o_orderkey, sha256(unhex(hex('ITEM') || {_le('8 + strlen(o_orderpriority)')} || '00000000' || {_le('o_orderkey')} || '0000803F' || repeat('00', 32) || hex('EDID') || f)) AS digest FROM o JOIN orders USING (o_orderkey)""")
def record_digest(spark, sf):
    o = V.load(spark, sf, "orders").select("o_orderkey", F.array(F.struct(F.lit(b"EDID").alias("signature"), F.encode("o_orderpriority", "UTF-8").alias("payload"))).alias("fields"))
    rows = o.select("o_orderkey", F.col("o_orderkey").alias("record_id"), F.lit(b"ITEM").alias("signature"), F.lit(0).cast("long").alias("flags"), F.unhex(F.lit("0000803F")).alias("version_raw"), "fields")
    return compose.digest(rows).select("o_orderkey", K.show_hex("digest").alias("digest"))


def _changes(spark, sf):
    """Each turn of a conversation is a change set on top of the turn before it."""
    c = V.load(spark, sf, "conversations")
    key = lambda t: F.sha2(F.encode(F.concat_ws(":", "conv_id", t), "UTF-8"), 256)
    return c.withColumns({"node": key(F.col("turn")), "parent": key(F.col("turn") - 1)})


@query("""WITH RECURSIVE e AS (SELECT conv_id, turn FROM conversations), a AS (SELECT e.conv_id, e.turn, p.turn AS up, 1 AS depth FROM e JOIN e p ON p.conv_id = e.conv_id AND p.turn = e.turn - 1
        UNION ALL SELECT a.conv_id, a.turn, p.turn, a.depth + 1 FROM a JOIN e p ON p.conv_id = a.conv_id AND p.turn = a.up - 1)
    SELECT conv_id, turn, max(depth) AS n_ancestors FROM a GROUP BY conv_id, turn""")
def change_set_ancestry(spark, sf):
    c = _changes(spark, sf)
    known = c.select(F.col("node").alias("parent"))
    edges = c.select("node", "parent").join(known, "parent", "left_semi").select("node", "parent").distinct()
    pairs = graph.ancestry(edges)
    return c.select("conv_id", "turn", "node").distinct().join(pairs.groupBy("node").agg(F.count("*").alias("n_ancestors")), "node").select("conv_id", "turn", F.col("n_ancestors").cast("int").alias("n_ancestors"))


@query(f"""SELECT conv_id, turn, sha256(unhex(hex('PCP-CHANGE-SET') || '00' || '00000000' || lpad(upper(to_hex(conv_id + 1)), 32, '0') || repeat('FF', 16) || {_le('turn')} || '00000000'
    || {_le('strlen(role)')} || hex(role) || {_le('strlen(text)')} || hex(text) || '01000000' || '00' || {_le('turn')} || sha256(text))) AS id FROM conversations""")
def change_set_ids(spark, sf):
    c = V.load(spark, sf, "conversations")
    op = F.struct(F.lit(0).alias("kind"), F.col("turn").alias("record_id"), F.lit(None).cast("binary").alias("previous"), F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest"))
    rows = c.select("conv_id", "turn", F.expr("cast(array() as array<binary>)").alias("parents"), V.pid(F.col("conv_id")).alias("destination"), F.unhex(F.lit("FF" * 16)).alias("source"), F.col("role").alias("author"), F.col("text").alias("message"), F.col("turn").alias("timestamp"), F.array(op).alias("operations"))
    return rows.select("conv_id", "turn", K.show_hex(history.change_set_id()).alias("id"))


# --- edits and metadata ---------------------------------------------------------------------------


@query("""WITH base AS (SELECT o_orderkey AS record_id, o_orderstatus AS status FROM orders WHERE o_orderkey % 5 <> 0)
    SELECT record_id, CASE WHEN record_id % 7 = 0 THEN 'X' ELSE status END AS status FROM base WHERE record_id % 11 <> 0
    UNION ALL SELECT o_orderkey, 'N' FROM orders WHERE o_orderkey % 5 = 0""")
def batch_mutations(spark, sf):
    o = V.load(spark, sf, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_orderstatus").alias("status"))
    kind = F.when(F.expr("record_id % 5 = 0"), edit.INSERT).when(F.expr("record_id % 11 = 0"), edit.DELETE).when(F.expr("record_id % 7 = 0"), edit.REPLACE)
    m = o.withColumn("kind", kind).filter("kind is not null").withColumn("status", F.when(F.col("kind") == edit.INSERT, "N").otherwise("X"))
    return edit.apply_batch(o.filter("record_id % 5 <> 0"), m, "record_id", ["status"])


@query(f"""WITH {T}, d AS (SELECT *, 10 + ck % 3 AS delta FROM entries WHERE ck >= 0 AND ck % 4 = 0)
    SELECT g.header_offset, sum(delta)::BIGINT AS delta FROM grp g JOIN d ON d.rk = g.rk AND (g.group_type = 1 OR d.nk = g.nk) GROUP BY g.header_offset""")
def group_deltas(spark, sf):
    r, _ = V.tables(spark, sf)
    changed = r.filter(F.col("record_id") >= V.CUSTOMER).withColumn("c", F.col("record_id") - V.CUSTOMER).filter("c % 4 = 0").select("package_index", "record_id", (F.col("c") % 3 + 10).alias("delta"))
    return edit.group_deltas(r, changed).select("header_offset", "delta")


@query("SELECT source, count(*) AS record_count, sum(n_chars)::BIGINT AS total_bytes, count(DISTINCT lang) AS n_signatures, max(n_chars) AS largest FROM documents GROUP BY source")
def metadata_summary(spark, sf):
    d = V.load(spark, sf, "documents").withColumnRenamed("lang", "signature")
    return metadata.summary(d, "source", size="n_chars")


@query("""WITH p AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS package_index FROM (SELECT DISTINCT source FROM documents))
    SELECT source, CASE WHEN package_index % 3 = 1 THEN 1 ELSE 2048 END AS first_local FROM p""")
def metadata_first_local(spark, sf):
    return _sources(spark, sf).select("source", metadata.first_owned_local().alias("first_local"))


@query("""WITH o AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL)
    SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS listed FROM o GROUP BY user_id""")
def metadata_distinct_overrides(spark, sf):
    e = V.load(spark, sf, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("record_ids"))
    return metadata.distinct_overrides(e).select("user_id", F.array_join("record_ids", ",").alias("listed"))


@query(f"WITH {T} SELECT rk AS region, nk AS nation, count(*) AS n, sum(own)::BIGINT AS bytes FROM entries WHERE ck >= 0 GROUP BY ROLLUP (rk, nk)")
def hierarchy_rollup(spark, sf):
    t = V.tree(spark, sf).filter(F.col("record_id") >= V.CUSTOMER)
    t = t.select((F.get("above", F.lit(0))["id"] - V.REGION).cast("int").alias("region"), (F.get("above", F.lit(1))["id"] - V.NATION).cast("int").alias("nation"), "own_bytes")
    return t.rollup("region", "nation").agg(F.count("*").alias("n"), F.sum("own_bytes").alias("bytes"))


# --- package files --------------------------------------------------------------------------------


@query("SELECT (o_orderkey // 65536)::INT AS package_index, o_orderkey % 65536 + 2048 AS record_id, 'ITEM' AS signature, o_orderpriority AS priority, o_custkey AS custkey FROM orders")
def package_records(spark, sf):
    """Orders written as package files, read back through the data source and decoded."""
    r = package_source.read(spark, V.order_packages(spark, sf), "records", split_bytes=4 << 20)
    f = package_source.subrecords(r).groupBy("package_index", "record_id").agg(*[F.max(F.when(F.col("signature") == F.lit(s), F.col("payload"))).alias(a) for s, a in ((b"EDID", "e"), (b"VALU", "v"))])
    named = r.select("package_index", "record_id", K.show_signature("signature").alias("signature"))
    return named.join(f, ["package_index", "record_id"]).select("package_index", "record_id", "signature", F.decode("e", "UTF-8").alias("priority"), K.from_le("v").alias("custkey"))


@query("""SELECT o_orderkey // 65536 AS package_index, 0 AS group_type, (16 + sum(52 + 8 + strlen(o_orderpriority) + 8 + 4))::BIGINT AS group_byte_count, 0 AS depth FROM orders GROUP BY o_orderkey // 65536""")
def package_groups(spark, sf):
    g = package_source.read(spark, V.order_packages(spark, sf), "groups")
    return g.select(F.col("package_index").cast("long").alias("package_index"), "group_type", "group_byte_count", "depth")


@query("SELECT o_orderkey // 65536 AS package_index, count(*) AS record_count, 'orders' AS schema_namespace, '0.1.0' AS package_version, 0 AS load_class FROM orders GROUP BY o_orderkey // 65536")
def package_headers(spark, sf):
    p = package_source.read(spark, V.order_packages(spark, sf), "packages")
    return p.select(F.col("package_index").cast("long").alias("package_index"), "record_count", "schema_namespace", "package_version", "load_class")


@query("SELECT o_orderkey // 65536 AS package_index, count(*) AS n_fields, sum(CASE WHEN s = 'EDID' THEN strlen(o_orderpriority) ELSE 4 END)::BIGINT AS n_bytes, s AS signature FROM orders, (VALUES ('EDID'), ('VALU')) t(s) GROUP BY o_orderkey // 65536, s")
def package_subrecords(spark, sf):
    s = package_source.read(spark, V.order_packages(spark, sf), "subrecords")
    return s.groupBy(F.col("package_index").cast("long").alias("package_index"), K.show_signature("signature").alias("signature")).agg(F.count("*").alias("n_fields"), F.sum(F.octet_length("payload")).alias("n_bytes"))


from . import files  # noqa: E402, F401  registers its queries
