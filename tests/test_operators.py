import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from overstrata import codec as B
from overstrata import model as M
from overstrata.functions import columns as K
from overstrata.operators import compose, edit, graph, history, ids, index, merge, metadata, overrides, ranges, validate
from overstrata.operators.compose import Rule
from overstrata.sources import package_sink, package_source

from packages import item, package, pid, u32
from test_codec import scenes


@pytest.fixture(scope="module")
def order(spark, tmp_path_factory):
    """A base of 40 items, an override package and a compact one, as files in load order."""
    d = tmp_path_factory.mktemp("packages")
    images = [
        package(1, [B.group(b"ITEM", 0, [item(0x800 + i, f"Item{i}", i) for i in range(40)])], owned=40, next_local=0x900),
        package(2, [B.group(b"ITEM", 0, [item(0x800, "Overridden", 99), item(0x801, "Gone", 1, flags=M.DELETED), item(0x01000800, "Own", 5)])], deps=(1,), owned=1, total=3, streaming_overrides=(0x800, 0x777)),
        package(12, [item(0x800, "Compact", 7)], owned=1, load_class=M.COMPACT, next_local=0x801),
        package(93, [item(0x800, "Overlay", 8)], deps=(1,), total=1, load_class=M.OVERLAY, next_local=0x800),
    ]
    paths = []
    for i, x in enumerate(images):
        paths.append(str(d / f"{i}.pcp"))
        (d / f"{i}.pcp").write_bytes(x)
    return paths, images


def read(spark, order, table, **k):
    return package_source.read(spark, order[0], table, **k)


def test_source_tables(spark, order):
    r = read(spark, order, "records").collect()
    assert len(r) == 45 and {x.package_index for x in r} == {0, 1, 2, 3}
    small = read(spark, order, "records", split_bytes=200)
    assert small.rdd.getNumPartitions() > 10 and sorted((x.package_index, x.record_id, bytes(x.payload)) for x in small.collect()) == sorted((x.package_index, x.record_id, bytes(x.payload)) for x in r)
    assert read(spark, order, "groups", split_bytes=200).count() == 2
    assert read(spark, order, "records", payload="false").filter("payload is not null").count() == 0
    p = read(spark, order, "packages").orderBy("package_index").collect()
    assert [x.load_class for x in p] == [0, 0, 1, 2] and bytes(p[1].package_id) == pid(2)
    assert read(spark, order, "dependencies").count() == 2 and [x.record_id for x in read(spark, order, "streaming_overrides").orderBy("ord").collect()] == [0x800, 0x777]
    s = read(spark, order, "subrecords")
    assert s.count() == 90
    again = package_source.subrecords(read(spark, order, "records"))
    assert again.count() == 90 and again.filter("signature = X'56414C55'").count() == 45
    whole = package_source.read_binary(spark, order[0][0])
    assert bytes(whole.first().content) == order[1][0]


def test_load_order(spark, order):
    packages, deps = read(spark, order, "packages"), read(spark, order, "dependencies")
    slots = {r.package_index: r.slot for r in ids.assign_slots(packages).collect()}
    assert slots == {0: 0, 1: 1, 2: 0, 3: None}
    origins = ids.resolve(read(spark, order, "records"), packages, deps)
    w = {r.runtime_id: r for r in overrides.winners(origins, "payload", "flags").collect()}
    assert w[0x800].chain_length == 3 and b"Overlay" in w[0x800].payload and 0x01000800 in w and 0xFE000800 in w
    assert w[0x801].flags == M.DELETED  # a deleted record wins
    assert 0x801 not in {r.runtime_id for r in overrides.live_winners(origins).collect()}
    back = ids.serialize(origins.select("package_index", "runtime_id", F.col("record_id").alias("was")), packages, deps)
    assert back.filter("was <> record_id or record_id is null").count() == 0
    lost = ids.serialize(spark.createDataFrame([(0, 0x01000800)], "package_index int, runtime_id long"), packages, deps).first()
    assert lost.record_id is None
    bad = spark.createDataFrame([(0, 0x05000800)], "package_index int, record_id long")
    with pytest.raises(Exception, match="InvalidPackageIndex"):
        ids.resolve(bad, packages, deps).collect()
    assert {(r.code, r.runtime_id) for r in validate.load_order(origins).collect()} == {("PCP-OVERRIDE-CHAIN", 0x800), ("PCP-OVERRIDE-CHAIN", 0x801)}
    s = ids.resolve(read(spark, order, "streaming_overrides"), packages, deps)
    assert {r.runtime_id: r.package_index for r in overrides.streaming_winners(s).collect()} == {0x800: 1, 0x777: 1}
    issues = validate.indexed_package(packages, read(spark, order, "records"), deps, read(spark, order, "streaming_overrides"))
    assert [(r.code, r.record_id) for r in issues.collect() if r.code.startswith("PCP-STREAMING")] == [("PCP-STREAMING-OVERRIDE-MISSING", 0x777)]
    assert index.integrity(read(spark, order, "records"), packages, deps).count() == 0


def test_availability_and_load_checks(spark):
    p = spark.createDataFrame([(0, 41, "1.5.0"), (1, 42, "2.0.0-rc.1"), (2, 43, "1.0.0"), (3, 44, "1.0.0"), (4, 45, "1.0.0")], "package_index int, package_id long, package_version string")
    d = spark.createDataFrame([(42, 41, ">=1.0.0, <2.0.0"), (43, 42, ">=2.0.0-rc.1"), (44, 99, None), (45, 44, "*")], "package_id long, dep_package_id long, requirement string")
    i = spark.createDataFrame([(43, 41, "<1.4.0"), (42, 43, None)], "package_id long, inc_package_id long, requirement string")
    got = {(r.package_id, r.code, r.severity, r.related) for r in graph.availability(p, d, i).collect()}
    assert got == {(44, "MissingDependency", "Error", 99), (45, "DependencyUnavailable", "Error", 44), (42, "IncompatiblePackage", "Warning", 43)}
    rel = lambda x, c: x.join(p.select("package_index", "package_id"), "package_id").select("package_index", F.lit(0).alias("ord"), F.col(c).alias("package_id"), "requirement")
    strict = {r.code for r in graph.load_order_violations(p, rel(d, "dep_package_id"), rel(i, "inc_package_id")).collect()}
    editor = {r.code for r in graph.load_order_violations(p, rel(d, "dep_package_id"), rel(i, "inc_package_id"), strict=False).collect()}
    assert strict - editor == {"IncompatiblePackages"} and editor == {"MissingDependency"}


def test_closure_ends_in_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "a int, b int")
    assert {r.node for r in graph.closure(e, spark.createDataFrame([(1,)], "node int")).collect()} == {1, 2, 3}
    assert graph.ancestry(e.select(F.col("a").alias("node"), F.col("b").alias("parent"))).count() == 10


def test_columns_match_the_codec(spark):
    df = spark.createDataFrame([(bytearray(b"\xc3\xa9\x00\x01"), 0xFE000800, -3, 7)], "b binary, n long, x int, y int")
    r = df.select(K.le32("n").alias("le"), K.from_le("b").alias("back"), K.label_int("b").alias("i"), K.show_signature("b").alias("sig"), K.show_id("n").alias("hex"), K.show_package_id(F.unhex(F.lit("000102030405060708090a0b0c0d0e0f"))).alias("pid")).first()
    assert bytes(r.le) == u32(0xFE000800) and r.back == struct.unpack("<I", b"\xc3\xa9\x00\x01")[0] and r.sig == M.show_signature(b"\xc3\xa9\x00\x01")
    assert r.hex == "FE000800" and r.pid == M.show_package_id(bytes(range(16))) and r.i == M.label_int(b"\xc3\xa9\x00\x01")
    items = [b"b", b"", b"a"]
    q = spark.createDataFrame([([bytearray(x) for x in items],)], "a array<binary>")
    r = q.select(K.encode_list("a").alias("l"), K.encode_set("a").alias("s"), K.encode_map(F.transform("a", lambda x: F.struct(x.alias("k"), x.alias("v")))).alias("m")).first()
    assert bytes(r.l) == B.encode_list(items) and bytes(r.s) == B.encode_set(items) and bytes(r.m) == B.encode_map([(x, x) for x in items])
    with pytest.raises(Exception, match="DuplicateSetElement"):
        q.select(K.encode_set(F.concat("a", "a"))).collect()
    d = spark.createDataFrame([(bytearray(b"ITEM"), bytearray(b"EDIDxx"), 1, 0x800, bytearray(struct.pack("<f", 1.0)))], "s binary, p binary, f long, r long, v binary")
    assert bytes(d.select(K.record_digest("s", "p", "f", "r", "v").alias("d")).first().d) == B.record_digest(b"ITEM", b"EDIDxx", 0x800, 1, struct.pack("<f", 1.0))


def test_compose_list_rule(spark):
    enc = lambda *v: bytearray(B.encode_list([u32(x) for x in v]))
    rows = [(1, [(bytearray(b"QSTS"), enc(1, 2))], [(bytearray(b"QSTS"), enc(2, 3))]), (2, [], [(bytearray(b"QSTS"), bytearray(b"?"))]), (3, [(bytearray(b"QSTS"), enc(5))], [])]
    df = spark.createDataFrame(rows, f"k int, dst_fields {M.FIELDS}, src_fields {M.FIELDS}")
    got = {r.k: [bytes(f.payload) for f in r.fields] for r in compose.compose_override(df, [Rule(b"QSTS", compose.APPEND_LIST, mode="unique")]).collect()}
    assert got == {1: [B.encode_list([u32(1), u32(2), u32(3)])], 2: [b"?"], 3: [bytes(enc(5))]}


def test_merge_and_edit_tables(spark):
    dst = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    src = spark.createDataFrame([(2, "B", False), (3, "c", False), (1, None, True)], "k int, v string, gone boolean")
    got = {r.k: (r.op, r.v) for r in merge.upsert(dst, src, "k", ["v"], deleted=F.col("gone")).collect()}
    assert got == {1: ("delete", "a"), 2: ("override", "B"), 3: ("add", "c")}
    with pytest.raises(Exception, match="DeleteTargetMissing"):
        merge.upsert(dst.filter("k = 2"), src, "k", ["v"], deleted=F.col("gone")).collect()
    m = spark.createDataFrame([(1, "delete", None), (2, "replace", "x"), (9, "insert", "n")], "k int, kind string, v string")
    assert {r.k: r.v for r in edit.apply_batch(dst, m, "k", ["v"]).collect()} == {2: "x", 9: "n"}
    for bad, why in ((m.union(m.filter("k = 2")), "DuplicateMutation"), (spark.createDataFrame([(1, "insert", "x")], m.schema), "RecordExists"), (spark.createDataFrame([(7, "delete", None)], m.schema), "RecordMissing")):
        with pytest.raises(Exception, match=why):
            edit.apply_batch(dst, bad, "k", ["v"]).collect()
    ref = spark.createDataFrame([(1, bytearray(b"ITEM"), bytearray(b"BASE"), bytearray(u32(5)))], "record_id long, record_signature binary, signature binary, payload binary")
    with pytest.raises(Exception, match="UnmappedSourceRecord"):
        merge.rewrite_references(ref, spark.createDataFrame([(6, 7)], "record_id long, new_id long"), [("ITEM", "BASE")]).collect()


def test_packages_as_rows(spark, order, tmp_path):
    dst = package(21, [B.group(b"ITEM", 0, [item(0x800, "Original", 10)])], owned=1, next_local=0x801)
    src = package(22, [B.group(b"ITEM", 0, [item(0x800, "Over", 20), item(0x01000800, "New", 30)])], deps=(21,), owned=1, total=2)
    pairs = spark.createDataFrame([(1, bytearray(dst), bytearray(src))], "k int, destination binary, source binary")
    out = merge.merge_packages(pairs, author="a", message="m", timestamp=1).select("merged.*").first()
    assert out.n_operations == 2 and out.injected == {0x01000800: 0x801}
    mutations = spark.createDataFrame([("p", 0, "delete", 0x800, None, None, None, 0, 1.0)], "path string, ord int, kind string, record_id long, payload binary, signature binary, group_offset long, flags long, version double")
    done = edit.edit_packages(spark.createDataFrame([("p", bytearray(dst))], "path string, content binary"), mutations).first()
    assert B.open_package(B.Memory(bytes(done.content))).header.record_count == 0
    target = str(tmp_path / "out.pcp")
    package_source.register(spark)
    spark.createDataFrame([(target, bytearray(dst))], "path string, content binary").write.format("overstrata").mode("append").save()
    assert open(target, "rb").read() == dst and len(list(tmp_path.iterdir())) == 1
    with pytest.raises(Exception, match="PackageHeaderMustComeFirst|TruncatedEntry"):
        spark.createDataFrame([(target, bytearray(b"not a package"))], "path string, content binary").write.format("overstrata").mode("append").save()
    assert open(target, "rb").read() == dst


def test_encode_packages(spark, order):
    heads = spark.createDataFrame([(i, bytearray(B.Memory(x).data[: B.open_package(B.Memory(x)).content_offset])) for i, x in enumerate(order[1])], "package_index int, header binary")
    p = read(spark, order, "packages").join(heads, "package_index")
    got = package_sink.encode_packages(p, read(spark, order, "groups"), read(spark, order, "records")).orderBy("package_index").collect()
    assert [bytes(r.content) for r in got] == order[1]


def test_ranges(spark, tmp_path):
    path = tmp_path / "s.pcp"
    path.write_bytes(scenes())
    g, r = (package_source.read(spark, str(path), t) for t in ("groups", "records"))
    got = {(x.world_id, x.scene_id, x.start_offset, x.end_offset) for x in ranges.scene_offsets(g, r).collect()}
    want = {(t.world_id, o.scene_id, o.start, o.end) for t in ranges.scene_tables(B.Memory(scenes())) for o in t.offsets}
    assert got == want and len(got) == 3
    _, scene, start, end = sorted(got)[0]
    assert [x.record_id for x in ranges.read_range(r, start, end).orderBy("header_offset").collect()] == [0x801, 0x805]
    part = package_source.read(spark, str(path), "records", start=start, end=end, skip_group_types="8")
    assert sorted(x.record_id for x in part.collect()) == [0x801, 0x805]
    assert {x.record_id for x in index.descendants(r, M.label_from_id(0x802)).collect()} == {0x806, 0x807}
    assert index.in_group_type(r, M.PERSISTENT_CHILDREN).count() == 3
    left = r.filter(F.col("record_id") != 0x802)
    assert {(x.record_id, x.related) for x in validate.orphaned_paths(left).collect()} == {(0x806, 0x802), (0x807, 0x802)}


def test_history_tables(spark):
    h = B.History()
    a = h.insert(B.ChangeSet.create((), pid(1), pid(2), "dév", "", 1234, [B.Operation(B.ADD, 0x800, digest=bytes([7]) * 32)]))
    b = h.insert(B.ChangeSet.create((a,), pid(1), pid(3), "d", "x", -5, [B.Operation(B.OVERRIDE, 0x800, a, bytes([8]) * 32), B.Operation(B.DELETE, 0x801, a)]))
    t = history.read_history(spark, h.to_bytes())
    assert t.filter(F.col("id") != history.change_set_id()).count() == 0 and history.violations(t).count() == 0
    assert history.write_history(t) == h.to_bytes()
    assert history.is_ancestor(t, a, b) and not history.is_ancestor(t, b, a) and history.is_ancestor(t, b"?" * 32, b"?" * 32)
    assert history.insert(t, t).count() == 2 and history.ancestors(t).count() == 1
    broken = t.withColumn("author", F.lit("")).filter(F.col("id") == F.lit(b))
    assert {r.code for r in history.violations(broken).collect()} == {"EmptyAuthor", "ChangeSetIdMismatch", "MissingParent"}


def test_metadata(spark, order):
    p = read(spark, order, "packages")
    empty = p.filter("package_index = 3").withColumn("record_count", F.lit(0).cast("long"))
    got = metadata.set_load_class(empty, pid(93), M.COMPACT).first()
    assert (got.load_class, got.next_local_identifier) == (M.COMPACT, 1)
    assert metadata.set_fields(p, pid(1), author="me").filter("author = 'me'").count() == 1
    d = read(spark, order, "dependencies")
    more = metadata.add_relation(d, 1, pid(7), "seven")
    assert more.filter("package_index = 1").count() == 2
    with pytest.raises(M.PackageError):
        metadata.add_relation(more, 1, pid(7), "seven")
    assert [r.ord for r in metadata.remove_relation(more, 1, pid(1)).filter("package_index = 1").collect()] == [0]
    assert validate.load_class_rules(p.withColumn("owned_record_count", F.lit(5000).cast("long"))).count() == 2


def test_streams(spark, tmp_path):
    from overstrata.streaming import mutations as S

    state, feed = str(tmp_path / "state"), str(tmp_path / "feed")
    spark.createDataFrame([(1, "a")], "k int, v string").write.parquet(f"{state}/v=-1")
    m = spark.createDataFrame([(2, "insert", "b"), (1, "replace", "A")], "k int, kind string, v string")
    m.write.parquet(feed)
    q = S.apply_stream(spark.readStream.schema(m.schema).parquet(feed), state, "k", ["v"], str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.k: r.v for r in spark.read.parquet(f"{state}/v=0").collect()} == {1: "A", 2: "b"}
    o = spark.createDataFrame([("2024-01-01 00:00:00", 5, 0), ("2024-01-01 00:10:00", 5, 2)], "ts string, runtime_id long, package_index int").withColumn("ts", F.to_timestamp("ts"))
    o.write.parquet(str(tmp_path / "o"))
    w = S.winners_stream(spark.readStream.schema(o.schema).parquet(str(tmp_path / "o")))
    q = w.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.winner_package, r.chain_length) for r in spark.sql("select * from w").collect()] == [(2, 2)]


def test_pushed_filters_and_columns(spark, tmp_path):
    """Excluded payloads are never read, and the plan names the filters."""
    path = tmp_path / "s.pcp"
    path.write_bytes(scenes())
    whole = {r.record_id: bytes(r.signature) for r in package_source.read(spark, str(path)).collect()}
    sig = whole[0x801]
    for cond, want in ((F.col("signature") == F.lit(sig), {i for i, s in whole.items() if s == sig}), (F.col("record_id").isin(0x801, 0x805), {0x801, 0x805}), ((F.col("header_offset") > 400) & (F.col("record_id") <= 0x806), None)):
        df = package_source.read(spark, str(path), pushdown=True).filter(cond)
        got = {r.record_id for r in df.collect()}
        assert got == ({r.record_id for r in package_source.read(spark, str(path)).filter(cond).collect()} if want is None else want)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Filter" not in plan.split("BatchScan")[0], plan
    few = package_source.read(spark, str(path), columns="record_id,signature")
    assert few.columns == ["record_id", "signature"] and few.count() == len(whole)
    assert package_source.read(spark, str(path), "subrecords", pushdown=True).filter("record_id = 2049").select("record_id").distinct().count() <= 1


def test_places_in_packages(spark, tmp_path):
    """Positions count from 0 in each package, whatever the offsets."""
    for i in range(2):
        (tmp_path / f"{i}.pcp").write_bytes(scenes())
    r = package_source.read(spark, str(tmp_path))
    ids = [x.record_id for x in package_source.read(spark, str(tmp_path / "0.pcp")).orderBy("header_offset").collect()]
    got = {(x.package_index, x.position, x.record_id) for x in index.record_at(r, 0, 3, 9).collect()}
    assert got == {(p, i, ids[i]) for p in (0, 1) for i in (0, 3, 9)}


def test_encoded_collections_in_columns(spark):
    from overstrata.functions import columns as K

    rows = [(i, [bytes([j % 251]) * (j % 5) for j in range(n)]) for i, n in enumerate((0, 1, 3, 400))]
    df = spark.createDataFrame(rows, "i int, items array<binary>")
    got = {r.i: (bytes(r.e), [bytes(x) for x in r.d]) for r in df.select("i", K.encode_list("items").alias("e")).select("i", "e", K.decode_list("e").alias("d")).collect()}
    assert got == {i: (B.encode_list(x), x) for i, x in rows}
    pairs = [(b"b", b"2"), (b"a", b""), (b"c", b"33")]
    m = spark.createDataFrame([(pairs,)], "p array<struct<k:binary,v:binary>>").select(K.decode_map(K.encode_map("p")).alias("m")).first().m
    assert [(bytes(x.k), bytes(x.v)) for x in m] == sorted(pairs)
    good = B.encode_list([b"ab", b"c"])
    small = B.Limits(elements=2, element_bytes=3, total_bytes=30)
    bad = {good[:-1]: "TruncatedCollection", good[:3]: "TruncatedCollection", good + b"x": "TrailingCollectionBytes", b"\xff" * 8: "TooManyElements", B.encode_list([b"long one"]): "ElementTooLarge", B.encode_list([b"a", b"a"]): "DuplicateSetElement", b"\1\0\0\0" + b"\xff" * 4: "ElementTooLarge"}
    for raw, code in bad.items():
        with pytest.raises(Exception, match=code):
            spark.createDataFrame([(raw,)], "b binary").select(K.decode_set("b", small)).collect()
    for items, code in (([b"1"] * 3, "TooManyElements"), ([b"long one"], "ElementTooLarge"), ([b"abc", b"abc"], None)):
        df = spark.createDataFrame([(items,)], "items array<binary>").select(K.encode_list("items", small))
        if code is None:
            assert bytes(df.first()[0]) == B.encode_list(items)
        else:
            with pytest.raises(Exception, match=code):
                df.collect()


def test_floats_in_columns(spark):
    import struct

    from overstrata.functions import columns as K

    values = [0.0, -0.0, 1.0, -2.5, 0.1, 1e-45, -3e-40, 1.17549435e-38, 3.4028235e38, float("inf"), float("-inf"), float("nan"), 8.0, 16777217.0, 7.999999]
    got = [bytes(r[0]) for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v float").orderBy("i").select(K.le_f32("v")).collect()]
    assert got == [struct.pack("<f", np.float32(v)) for v in values]


def test_signatures_of_composed_records(spark):
    row = [(1, "ITEM", "ITEM", [(b"A", b"1")], [(b"A", b"2")]), (2, "ITEM", "SCEN", [(b"A", b"1")], [(b"A", b"2")])]
    df = spark.createDataFrame(row, "i int, d string, s string, dst_fields array<struct<signature:binary,payload:binary>>, src_fields array<struct<signature:binary,payload:binary>>")
    ok = compose.compose_override(df.filter("i = 1"), [compose.Rule(b"A", compose.REPLACE)], signatures=("d", "s")).first()
    assert bytes(ok.fields[0].payload) == b"2"
    with pytest.raises(Exception, match="OverrideSignatureMismatch"):
        compose.compose_override(df, [compose.Rule(b"A", compose.REPLACE)], signatures=("d", "s")).collect()
    chain = df.select("i", F.array(F.struct(F.col("d").alias("signature"), F.col("dst_fields").alias("fields")), F.struct(F.col("s").alias("signature"), F.col("src_fields").alias("fields"))).alias("chain"))
    assert bytes(compose.compose_chain(chain.filter("i = 1"), [compose.Rule(b"A", compose.REPLACE)]).first().fields[0].payload) == b"2"
    with pytest.raises(Exception, match="OverrideSignatureMismatch"):
        compose.compose_chain(chain, [compose.Rule(b"A", compose.REPLACE)]).collect()


def test_lists_in_chains(spark):
    """Encoded lists along a chain of three records, against the fold of the codec."""
    lists = [[b"1", b"2", b"2"], [b"2", b"3"], [b"4", b"1", b"5", b"6"]]
    rec = [(b"NAME", b"x"), (b"QSTS", None)]
    chain = [[(s, B.encode_list(x) if p is None else p) for s, p in rec] for x in lists]
    df = spark.createDataFrame([([(c,) for c in chain],), ([(chain[0][:1],), (chain[1],), (chain[0][:1],)],)], "chain array<struct<fields:array<struct<signature:binary,payload:binary>>>>")
    for mode in ("all", "new_indices", "unique"):
        got = [{bytes(f.signature): bytes(f.payload) for f in r.fields} for r in compose.compose_chain(df, [compose.Rule(b"QSTS", compose.APPEND_LIST, mode=mode)]).collect()]
        want = B.append_list(B.append_list(chain[0][1][1], chain[1][1][1], mode), chain[2][1][1], mode)
        assert got == [{b"NAME": b"x", b"QSTS": want}, {b"NAME": b"x", b"QSTS": chain[1][1][1]}]
    twice = spark.createDataFrame([([([*chain[0], *chain[0]],), (chain[1],)],)], df.schema)
    with pytest.raises(Exception, match="ListSubrecordMultiplicity"):
        compose.compose_chain(twice, [compose.Rule(b"QSTS", compose.APPEND_LIST)]).collect()


def test_lists_of_chains_are_read_once(spark):
    """A rule's expression holds one decoding of each side, and no row pays for more: written out again, they had multiplied."""
    df = spark.createDataFrame([], "chain array<struct<fields:array<struct<signature:binary,payload:binary>>>>")
    composed = compose.compose_chain(df, [compose.Rule(b"QSTS", compose.APPEND_LIST)]).select("fields")
    once = spark.createDataFrame([], "raw binary").select(K.decode_list("raw").alias("items"))
    folds = lambda d: d._jdf.queryExecution().analyzed().toString().count("array_append(")
    assert folds(once) == 1 and folds(composed) == 2


def test_bytes_that_are_no_list(spark):
    """Every cut of a list, odd sizes and counts, as the codec has them; nothing stays nothing."""
    good = B.encode_list([b"ab", b"", b"c" * 300])
    odd = [good[:5], good[:9], good[:-1], b"\2\0\0\0\0\0\0\0\xff\0\0\0", b"\1\0\0\0\0\0\0\x80", b"\0\0\0\0x", b"\0\0\0\1" + bytes(8)]
    limits = B.Limits(elements=10, element_bytes=1000, total_bytes=2000)
    for raw in odd:
        with pytest.raises(M.PackageError) as e:
            B.decode_list(raw, limits)
        with pytest.raises(Exception, match=e.value.code):
            spark.createDataFrame([(bytearray(raw),)], "b binary").select(K.decode_list("b", limits)).collect()
    rows = [(0, bytearray(good)), (1, None), (2, bytearray(4))]
    got = {r.i: r.d and [bytes(x) for x in r.d] for r in spark.createDataFrame(rows, "i int, b binary").select("i", K.decode_list("b").alias("d")).collect()}
    assert got == {0: [b"ab", b"", b"c" * 300], 1: None, 2: []}
    for n in (255, 256, 65_537):
        df = spark.createDataFrame([(bytearray(n),)], "b binary").select(K.encode_list(F.array("b")).alias("e"))
        assert bytes(df.first().e) == B.encode_list([bytes(n)])
