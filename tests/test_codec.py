import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from overstrata import codec as B
from overstrata import model as M
from overstrata.model import PackageError
from overstrata.operators import edit as E
from overstrata.operators import graph as G
from overstrata.operators import merge as X
from overstrata.operators import ranges as R
from overstrata.operators.compose import APPEND, APPEND_LIST, KEEP, REPLACE, Rule
from overstrata.semver import Version, matches
from overstrata.sources.package_sink import create_package, write_atomically

from packages import entity, item, package, pid, u32, values

REFS = X.ReferenceRewriter([("ITEM", "BASE")])


def code(f, *a, **k):
    with pytest.raises(PackageError) as e:
        f(*a, **k)
    return e.value.code


def merge(dst, src, **k):
    return X.merge_package(dst, src, author="developer", message="m", timestamp=1234, rewriter=k.pop("rewriter", REFS), **k)


def test_group_header_bytes():
    raw = B.group(b"ITEM", 0, [])
    assert raw == bytes.fromhex("47525550 10000000 4954454D 00000000")
    assert code(B.decode_group_header, b"NOPE" + raw[4:]) == "InvalidGroupSignature"


def test_values_and_displays():
    assert M.show_signature(b"A\x00 z") == "A\\x00\\x20z"
    assert M.show_package_id(bytes(range(16))) == "00010203-0405-0607-0809-0a0b0c0d0e0f"
    assert M.label_grid(M.label_from_grid(-3, 7)) == (-3, 7) and M.label_from_grid(1, 2) == struct.pack("<hh", 2, 1)
    assert M.label_int(M.label_from_int(-5)) == -5
    assert code(M.record_id, 0, 1 << 24) == "LocalIdentifierOutOfRange"
    assert code(M.signature, "ABCDE") == "SignatureLength" and code(M.signature, "ABCÉ") == "SignatureNotAscii"
    f = M.Flags(0b111)
    assert f.contains(M.DELETED | M.PERSISTENT) and f.application_bits == 4
    assert M.group_type_name(77) == "Unknown(77)" and M.group_type_name(9) == "SceneTemporaryChildren"


@pytest.mark.parametrize(
    ("req", "version", "want"),
    [
        (">=2.0.0-rc.1, <2.0.0", "2.0.0-rc.1", True), (">=2.0.0-rc.1", "2.0.0-rc.1", True), ("*", "2.0.0-rc.1", False), ("*", "9.9.9", True),
        ("1.2.3", "1.9.0", True), ("1.2.3", "2.0.0", False), ("^0.2.3", "0.2.9", True), ("^0.2.3", "0.3.0", False), ("^0.0.3", "0.0.4", False), ("0", "0.9.0", True),
        ("~1.2.3", "1.2.9", True), ("~1.2.3", "1.3.0", False), ("~1", "1.9.0", True), ("=1.2", "1.2.7", True), (">1.2", "1.3.0", True), (">1.2", "1.2.9", False),
        ("<=1.2", "1.2.9", True), ("1.*", "1.5.0", True), ("1.2.*", "1.3.0", False), (">1.0.0, <2.0.0", "1.5.0+build", True), (">=1.0.0-a", "1.0.1-a", False),
    ],
)
def test_requirements(req, version, want):
    assert matches(req, version) is want


def test_version_order():
    order = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.1"]
    assert sorted(order, key=Version) == order
    assert code(Version, "1.0") == "InvalidVersion" and code(Version, "1.0.0-01") == "InvalidVersion"


def test_metadata_round_trip():
    h = B.Header(pid(1), schema_namespace="game", version="1.2.0-beta.2", author="a", description="é").with_dependency(B.Relation(pid(2), "two", ">=1.0.0, <2.0.0")).with_incompatibility(B.Relation(pid(3), "three", "<3.0.0"))
    h = h.with_(streaming_overrides=(5, 4, 5))
    back = B.open_package(B.Memory(h.encode())).header
    assert back == h and back.streaming_overrides == (5, 4)
    assert code(h.with_dependency, B.Relation(pid(2), "again")) == "DuplicateDependency"
    assert code(h.with_dependency, B.Relation(pid(1), "me")) == "SelfDependency"
    assert code(B.Relation, bytes(16), "x") == "NilPackageId" and code(B.Relation, pid(4), "") == "EmptyRelationshipName"
    assert h.without_dependency(pid(2)).dependencies == ()
    many = tuple(B.Relation(bytes([i // 250 + 1, i % 250] + [9] * 14), "d") for i in range(255))
    assert code(h.with_, dependencies=many) == "TooManyDependencies"


def test_header_is_strict():
    payload = B.Header(pid(1)).encode()[52:]
    assert code(B.Header.decode, payload + B.subrecord(b"ZZZZ", b"")) == "UnknownHeaderField"
    assert code(B.Header.decode, payload + B.subrecord(b"CLAS", b"\0")) == "DuplicateHeaderField"
    assert code(B.Header.decode, payload[12:]) == "MissingHeaderField"
    assert code(B.open_package, B.Memory(B.record(b"NOPE", [], 0))) == "PackageHeaderMustComeFirst"


def test_load_classes():
    c = B.Header(pid(1)).with_load_class(M.COMPACT)
    assert c.next_local == 1 == c.first_owned_local
    assert c.with_load_class(M.FULL).next_local == 1  # not restored
    c.with_(owned_record_count=4096).check_load_class()
    assert code(c.with_(owned_record_count=4097).check_load_class) == "CompactRecordLimitExceeded"
    o = B.Header(pid(1), load_class=M.OVERLAY)
    o.check_load_class()
    assert code(o.with_(owned_record_count=1).check_load_class) == "OverlayOwnsRecords"


def test_index_checks():
    two = B.group(b"ITEM", 0, [item(0x800, "IronSword", 25, 9.5), item(0x801, "FineSword", 60, 8.0, 0x800)])
    image = package(1, [two], owned=2)
    _, records, groups = B.build_index(B.Memory(image))
    assert [r.id for r, _ in records] == [0x800, 0x801] and len(groups) == 1
    assert values(image)[0x801][b"BASE"] == u32(0x800)
    assert code(B.build_index, B.Memory(package(1, [two], owned=3))) == "RecordCountMismatch"
    assert code(B.build_index, B.Memory(package(1, [two], owned=1, total=2))) == "OwnedRecordCountMismatch"
    assert code(B.build_index, B.Memory(package(1, [item(1, "a", 1), item(1, "b", 2)], owned=2))) == "DuplicateRecordId"
    assert code(B.build_index, B.Memory(package(1, [B.Header(pid(2)).encode()], owned=1))) == "UnexpectedPackageHeader"
    bad = two[:4] + u32(0xFFFFFFFF) + two[8:]
    assert code(B.build_index, B.Memory(package(1, [bad], owned=2))) == "EntryExceedsRange"


def test_opening_reads_the_header_alone():
    class Traced(B.Memory):
        most = 0

        def read(self, offset, n):
            self.most = max(self.most, offset + n)
            return super().read(offset, n)

    image = package(1, [item(0x800, "x", 1)], owned=1)
    s = Traced(image)
    p = B.open_package(s)
    assert s.most <= p.content_offset < len(image)


def test_large_field():
    image = package(1, [B.record(b"ITEM", [(b"BLOB", b"\xa5" * 100_000)], 0x800)], owned=1)
    assert values(image)[0x800][b"BLOB"] == b"\xa5" * 100_000


def test_record_rules():
    assert code(B.record, b"GRUP", [], 1) == "ReservedRecordSignature"
    assert code(B.record, b"ITEM", [], 1, version=-1.0) == "InvalidRecordVersion"
    assert code(B.record, b"ITEM", [], 1, version=float("nan")) == "InvalidRecordVersion"
    B.record(b"ITEM", [], 1, version=-0.0)
    assert code(lambda: list(B.fields_of(b"ABCD\xff\0\0\0x"))) == "SubrecordExceedsRecord"
    assert code(lambda: list(B.fields_of(b"ABC"))) == "TruncatedSubrecordHeader"


def test_collections():
    assert B.decode_list(B.encode_list([b"alpha", b"beta", b"gamma"])) == [b"alpha", b"beta", b"gamma"]
    a, b = B.encode_list([b"1", b"2"]), B.encode_list([b"2", b"3"])
    assert B.decode_list(B.append_list(a, b, "all")) == [b"1", b"2", b"2", b"3"]
    assert B.decode_list(B.append_list(a, b, "unique")) == [b"1", b"2", b"3"]
    assert B.decode_list(B.append_list(B.encode_list([b"1", b"1"]), b, "unique")) == [b"1", b"1", b"2", b"3"]
    assert B.decode_list(B.append_list(a, B.encode_list([b"x", b"y", b"z"]), "new_indices")) == [b"1", b"2", b"z"]
    assert B.decode_set(B.encode_set([u32(7), u32(3), u32(11)])) == sorted([u32(7), u32(3), u32(11)])
    assert code(B.encode_set, [b"a", b"a"]) == "DuplicateSetElement" and B.decode_set(B.encode_list([b"b", b"a"])) == [b"b", b"a"]
    m = [(b"health", u32(100)), (b"energy", u32(75))]
    assert B.decode_map(B.encode_map(m)) == sorted(m) and code(B.encode_map, [m[0], m[0]]) == "DuplicateMapKey"
    assert code(B.decode_list, b"\1\0\0\0") == "TruncatedCollection" and code(B.decode_list, a + b"x") == "TrailingCollectionBytes"
    assert code(B.decode_list, a, B.Limits(elements=1)) == "TooManyElements" and code(B.decode_list, a, B.Limits(element_bytes=0)) == "ElementTooLarge"


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=20), max_size=8))
def test_list_round_trip(items):
    assert B.decode_list(B.encode_list(items)) == items


def test_history():
    a = B.ChangeSet.create((), pid(1), pid(2), "developer", "", 1234, [B.Operation(B.ADD, 0x800, digest=bytes([7]) * 32)])
    b = B.ChangeSet.create((a.id,), pid(1), pid(3), "developer", "", 1235, [B.Operation(B.OVERRIDE, 0x800, a.id, bytes([8]) * 32)])
    h = B.History()
    assert code(h.insert, b) == "MissingParent"
    h.insert(a), h.insert(b)
    assert code(h.insert, a) == "DuplicateChangeSet" and len(h.entries) == 2
    assert h.is_ancestor(a.id, b.id) and not h.is_ancestor(b.id, a.id) and h.is_ancestor(b"?" * 32, b"?" * 32)
    raw = h.to_bytes()
    assert B.History.from_bytes(raw).to_bytes() == raw
    assert code(B.History.from_bytes, raw[:-1] + bytes([raw[-1] ^ 1])) == "ChangeSetIdMismatch"
    assert code(B.History.from_bytes, raw + b"x") == "MalformedHistory"
    for bad, want in (((), pid(1), pid(1), "a"), "SourceEqualsDestination"), (((), pid(1), pid(2), ""), "EmptyAuthor"), (((), bytes(16), pid(2), "a"), "NilPackageId"):
        assert code(B.ChangeSet.create, *bad, "", 1, a.operations) == want
    assert code(B.ChangeSet.create, (), pid(1), pid(2), "a", "", 1, []) == "NoOperations"
    assert code(B.ChangeSet.create, (), pid(1), pid(2), "a", "", 1, a.operations * 2) == "DuplicateOperation"


def test_atomic_write(tmp_path):
    p = tmp_path / "x.pcp"
    a, b = package(1, [item(0x800, "A", 1)], owned=1), package(1, [item(0x800, "B", 1)], owned=1)
    write_atomically(str(p), a)
    write_atomically(str(p), b)
    with pytest.raises(PackageError):
        write_atomically(str(p), b"not a package")
    assert p.read_bytes() == b and [x.name for x in tmp_path.iterdir()] == ["x.pcp"]
    create_package(str(tmp_path / "new.pcp"), pid(5), "game")
    assert B.open_package(B.File(str(tmp_path / "new.pcp"))).header.schema_namespace == "game"


def base_pair():
    dst = package(21, [B.group(b"ITEM", 0, [item(0x800, "Original", 10)])], owned=1, next_local=0x801)
    src = package(22, [B.group(b"ITEM", 0, [item(0x800, "Overridden", 20, base=0x01000800), item(0x01000800, "Injected", 30)])], deps=(21,), owned=1, total=2)
    return dst, src


def test_merge():
    dst, src = base_pair()
    image, change, injected = merge(dst, src)
    assert injected == {0x01000800: 0x801}
    v = values(image)
    assert v[0x800][b"EDID"] == b"Overridden" and v[0x800][b"BASE"] == u32(0x801) and v[0x801][b"VALU"] == u32(30)
    p, records, _ = B.build_index(B.Memory(image))
    assert p.header.next_local == 0x802 and {r.last_change_set for r, _ in records} == {change.id}
    assert [o.kind for o in change.operations] == [B.OVERRIDE, B.ADD]


def test_merge_selection():
    dst = package(71, [B.group(b"ITEM", 0, [item(0x800, "A", 1), item(0x801, "B", 2)])], owned=2, next_local=0x802)
    src = package(72, [B.group(b"ITEM", 0, [item(0x800, "A", 100), item(0x801, "B", 200), item(0x01000800, "New", 3)])], deps=(71,), owned=1, total=3)
    v = values(merge(dst, src, options=X.Options(X.Selection(0x801)))[0])
    assert (v[0x800][b"VALU"], v[0x801][b"VALU"], len(v)) == (u32(1), u32(200), 2)
    v = values(merge(dst, src, options=X.Options(include_overrides=False))[0])
    assert v[0x800][b"VALU"] == u32(1) and v[0x802][b"EDID"] == b"New"


def test_merge_errors():
    dst, src = base_pair()
    assert code(merge, dst, package(23, [], owned=0)) == "SourceDoesNotDependOnDestination"
    assert code(merge, dst, package(23, [], deps=(21, 50), owned=0)) == "DependencyUnavailableInDestination"
    gone = package(22, [item(0x900, "x", 1, flags=1)], deps=(21,), total=1)
    assert code(merge, dst, gone) == "DeleteTargetMissing"
    assert code(merge, dst, package(22, [item(0x01000800, "x", 1, flags=1)], deps=(21,), owned=1)) == "DeleteTargetMissing"
    assert code(merge, dst, package(22, [item(0x900, "x", 1)], deps=(21,), total=1)) == "OverrideTargetMissing"
    full = package(21, [], owned=0, next_local=M.MAX_LOCAL)
    assert code(merge, full, package(22, [item(0x01000800, "x", 1)], deps=(21,), owned=1)) == "RecordIdCapacityExhausted"
    other = package(21, [item(0x800, "x", 1)], deps=(60,), total=1)
    assert code(merge, other, package(22, [item(0x800, "x", 1)], deps=(60, 21), total=1)) == "OverrideTargetsAnotherDependency"
    lost = package(22, [item(0x800, "x", 1, base=0x01000900)], deps=(21,), total=1)
    assert code(merge, dst, lost) == "UnmappedSourceRecord"


def test_composition():
    rules = (Rule(b"EDID", KEEP), Rule(b"VALU", REPLACE), Rule(b"QSTS", APPEND_LIST, mode="new_indices"), Rule(b"TAGS", APPEND, deduplicate=True))
    extra = lambda q, t: [(b"QSTS", B.encode_list([u32(x) for x in q])), *[(b"TAGS", x) for x in t]]
    a, b = item(0x800, "Original", 1, extra=extra([10, 20], [b"shared"])), item(0x800, "Ignored name", 9, extra=extra([10, 20, 30], [b"shared", b"added"]))
    dst, src = package(81, [a], owned=1, next_local=0x801), package(82, [b], deps=(81,), total=1)
    image = merge(dst, src, options=X.Options(rules=rules))[0]
    s = B.Memory(image)
    _, ((r, _),), _ = B.build_index(s)
    f = list(B.fields_of(s.read(r.payload_offset, r.size)))
    assert (f[0][1], f[1][1], B.decode_list(f[2][1]), [x for k, x in f if k == b"TAGS"]) == (b"Original", u32(9), [u32(10), u32(20), u32(30)], [b"shared", b"added"])
    chain = [X.Logical(b"ITEM", 0, 0x800, u32(0), bytes(32), list(B.fields_of(x[52:]))) for x in (a, b)]
    assert X.compose_chain(chain, rules) == X.compose_override(*chain, rules)
    assert code(X.compose_chain, [], rules) == "EmptyOverrideChain"
    chain[1].signature = b"ENTY"
    assert code(X.compose_override, *chain, rules) == "OverrideSignatureMismatch"
    # no occurrence in the source deletes the field
    assert [k for k, _ in X.compose(chain[0], X.Logical(b"ITEM", 0, 1, u32(0), bytes(32)), [Rule(b"TAGS", REPLACE)]).fields] == [b"EDID", b"VALU", b"QSTS"]
    twice = X.Logical(b"ITEM", 0, 1, u32(0), bytes(32), [(b"QSTS", b""), (b"QSTS", b"")])
    assert code(X.compose, chain[0], twice, rules) == "ListSubrecordMultiplicity"


def children(rid, kind, *entries):
    return B.group(M.label_from_id(rid), kind, entries)


def scenes(n=9):
    persistent = lambda s, e: children(s, 8, entity(e, flags=M.PERSISTENT))
    temporary = lambda s, e: children(s, 9, entity(e))
    inner = B.group(M.label_from_int(0), 2, [B.group(M.label_from_int(0), 3, [entity(0x801, sig=b"SCEN"), children(0x801, 6, persistent(0x801, 0x804), temporary(0x801, 0x805))])])
    grid = lambda s, x, y, p, t: B.group(M.label_from_grid(x, y), 5, [entity(s, sig=b"SCEN"), children(s, 6, persistent(s, p), temporary(s, t))])
    world = children(0x800, 1, inner, B.group(M.label_from_grid(0, 0), 4, [grid(0x802, 0, 0, 0x806, 0x807), grid(0x803, 0, 1, 0x808, 0x809)]))
    return package(n, [entity(0x800, sig=b"WRLD"), world], owned=10, next_local=0x80A)


def test_scene_offsets():
    image = R.rebuild_image(scenes())
    p = B.open_package(B.Memory(image))
    (t,) = p.header.scene_tables
    assert t.world_id == 0x800 and [o.scene_id for o in t.offsets] == [0x801, 0x802, 0x803]
    for o in t.offsets:
        found = [(e, path) for e, path in B.walk(B.Memory(image), o.start, o.end) if isinstance(e, B.Record)]
        assert found[0][0].id == o.scene_id
        assert len([e for e, path in found if any(g.type == 9 for g in path)]) == 1
    assert R.rebuild_image(image) == image
    empty = package(9, [entity(0x801, sig=b"SCEN"), children(0x801, 9)], owned=1)
    assert R.scene_tables(B.Memory(empty)) == [B.SceneTable(None, (B.SceneOffset(0x801, B.open_package(B.Memory(empty)).content_offset, len(empty)),))]
    assert code(R.scene_tables, B.Memory(package(9, [children(0x801, 9)], owned=0))) == "SceneRecordMissingForOffset"


def test_hierarchy_merge_and_relocation():
    dst = package(41, [entity(0x800, "scene", sig=b"SCEN"), children(0x800, 6, children(0x800, 9, entity(0x801, "old")))], owned=2, next_local=0x802)
    src = package(42, [entity(0x800, "scene", sig=b"SCEN"), children(0x800, 6, children(0x800, 9, entity(0x01000800, "new")))], deps=(41,), owned=1, total=2)
    image = merge(dst, src, options=X.Options(X.Selection(0x800, descendants=True)))[0]
    _, records, groups = B.build_index(B.Memory(image))
    assert [r.id for r, path in records if path] == [0x801, 0x802] and sum(r.signature == b"SCEN" for r, _ in records) == 1 and len(groups) == 2
    dst = package(70, [entity(0x800, "A", sig=b"SCEN"), children(0x800, 9, entity(0x802, "e")), entity(0x801, "B", sig=b"SCEN")], owned=3, next_local=0x803)
    src = package(71, [entity(0x801, "Scene B override", sig=b"SCEN"), children(0x801, 9, entity(0x802, "e"))], deps=(70,), total=2)
    image, change, _ = merge(dst, src, options=X.Options(X.Selection(0x802)))
    _, records, _ = B.build_index(B.Memory(image))
    (path,) = [path for r, path in records if r.id == 0x802]
    assert len(change.operations) == 2 and M.label_id(path[-1].label) == 0x801 and values(image)[0x801][b"NAME"] == b"Scene B override"
    orphan = package(42, [children(0x800, 6, entity(0x01000800, "new"))], deps=(41,), owned=1)
    d = package(41, [entity(0x800, sig=b"SCEN")], owned=1, next_local=0x801)
    assert code(merge, d, orphan, options=X.Options(X.Selection(0x01000800))) == "SelectedParentMissing"


def test_cursor_skips_groups():
    image = package(1, [B.group(b"SKIP", 0, [entity(1, sig=b"HIDE")]), children(2, 9, entity(2, sig=b"SEEN"))], owned=2)
    p = B.open_package(B.Memory(image))
    seen = [e.signature for e, _ in B.walk(p.source, p.content_offset, p.source.size, descend=lambda g, _: g.label != b"SKIP") if isinstance(e, B.Record)]
    assert seen == [b"SEEN"]


def test_edits():
    image = package(9, [], owned=0)
    image, (rid,) = E.edit_package(image, [E.Mutation(E.INSERT, signature=b"ENTY", payload=B.encode_fields([(b"POSX", struct.pack("<f", 1.0))]))])
    assert rid == 0x800 and B.open_package(B.Memory(image)).header.next_local == 0x801
    image = E.replace_subrecord(image, rid, b"POSX", 0, struct.pack("<f", 2.5))
    assert values(image)[rid][b"POSX"] == struct.pack("<f", 2.5)
    assert code(E.replace_subrecord, image, rid, b"POSX", 1, b"") == "SubrecordMissing"
    image, _ = E.edit_package(image, [E.Mutation(E.DELETE, rid)])
    h = B.open_package(B.Memory(image)).header
    assert (h.record_count, h.owned_record_count, h.next_local) == (0, 0, 0x801)


def test_batch():
    image = package(11, [B.group(b"ITEM", 0, [item(0x800, "a", 1), item(0x801, "b", 2)])], owned=2, next_local=0x802)
    at = B.build_index(B.Memory(image))[2][0][0].offset
    body = lambda v: B.encode_fields([(b"VALU", u32(v))])
    out, _ = E.edit_package(image, [E.Mutation(E.REPLACE, 0x800, body(10)), E.Mutation(E.DELETE, 0x801), E.Mutation(E.INSERT, 0x802, body(30), b"ITEM", at)])
    v = values(out)
    assert {k: x[b"VALU"] for k, x in v.items()} == {0x800: u32(10), 0x802: u32(30)}
    p, records, groups = B.build_index(B.Memory(out))
    assert (p.header.record_count, p.header.owned_record_count, p.header.next_local) == (2, 2, 0x803) and all(path for _, path in records)
    assert code(E.edit_package, image, [E.Mutation(E.DELETE, 0x801)] * 2) == "DuplicateMutation"
    assert code(E.edit_package, image, [E.Mutation(E.DELETE, 0x900)]) == "RecordMissing"
    assert code(E.edit_package, image, [E.Mutation(E.INSERT, 0x800, body(1), b"ITEM")]) == "RecordExists"
    # a root insert after a trailing group stays at the root
    out, _ = E.edit_package(image, [E.Mutation(E.INSERT, None, body(1), b"ITEM")])
    assert [len(path) for _, path in B.build_index(B.Memory(out))[1]] == [1, 1, 0]


def test_order_repair():
    order, moves = G.repair_order([43, 42, 41], {43: [42], 42: [41]})
    assert order == [41, 42, 43] and moves
    assert code(G.repair_order, [1, 2], {1: [2], 2: [1]}) == "DependencyCycle"
    assert code(G.repair_order, [1], {1: [9]}) == "MissingDependency"
