import struct

import pytest

from overstrata import codec as B
from overstrata import model as M
from overstrata.api import LoadOrder, Package
from overstrata.model import PackageError

from packages import entity, item, package, pid, u32


def test_edit_and_save(tmp_path):
    p = Package.create(str(tmp_path / "a.pcp"), pid(9), "game", "1.0.0")
    rid = p.insert_record(b"ENTY", B.encode_fields([(b"POSX", struct.pack("<f", 1.0))]))
    p.replace_subrecord(rid, b"POSX", 0, struct.pack("<f", 2.5))
    p.replace_payload(rid, B.encode_fields([(b"EDID", b"x")]))
    p.set_metadata(author="me", version="1.1.0")
    p.add_incompatibility(B.Relation(pid(4), "four"))
    p.replace_streaming_overrides([5, 5, 6])
    assert p.dirty and p.record_count == 1
    p.save()
    q = Package.open(p.path)
    assert not p.dirty and q.header.author == "me" and q.streaming_overrides() == (5, 6) and q.header.incompatibilities[0].name == "four"
    assert list(q.fields(q.read_record_at(q.record(rid).offset))) == [(b"EDID", b"x")]
    with pytest.raises(PackageError, match="PackageIsReadOnly"):
        q.remove_record(rid)
    p.remove_record(rid)
    assert p.record_count == 0 and p.header.next_local == 0x801 and Package.open(p.path).record_count == 1
    before = p.source.data
    with pytest.raises(PackageError, match="RecordMissing"):
        p.remove_record(rid)
    assert p.source.data == before


def test_cursor_and_index():
    image = package(1, [B.group(b"SKIP", 0, [entity(1, sig=b"HIDE")]), B.group(M.label_from_id(2), 9, [entity(2, sig=b"SEEN")])], owned=2)
    p = Package.from_bytes(image)
    a, b = p.content()
    assert [e.signature for e in p.content().enter(b).records()] == [b"SEEN"]
    with pytest.raises(PackageError, match="ExpectedRecord"):
        list(p.content().records())
    assert (p.group_count, p.record_count, p.record_at(1).id, p.group_at(0)) == (2, 2, 2, a)
    assert p.record_path(2) == (b,) and p.record(77) is None and len(p.records_by_signature(b"HIDE")) == 1
    p.rebuild_scene_offsets()
    ((world, o),) = p.scene_offsets()
    assert world is None and o.scene_id == 2
    with pytest.raises(PackageError, match="InvalidRange"):
        p.range(5, 1 << 40)


def test_load_order(spark, tmp_path):
    def put(n, image):
        (tmp_path / n).write_bytes(image)
        return str(tmp_path / n)

    a = put("a", package(1, [item(0x800, "Original", 10)], owned=1, next_local=0x801, version="1.5.0"))
    b = put("b", package(2, [item(0x800, "Overridden", 99)], deps=(1,), total=1, streaming_overrides=(0x800,)))
    c = put("c", B.Header(pid(3), incompatibilities=(B.Relation(pid(1), "a", "<2.0.0"),)).encode())
    order = LoadOrder(spark, [a, b])
    assert order.record_count() == 1 and order.override_count(0x800) == 2 and order.streaming_winner(0x800) == 1
    w = order.winning_record_at(0).first()
    assert w.winner_package == 1 and u32(99) in bytes(w.payload) and order.serialize(1, 0x800) == 0x800 == order.resolve(1, 0x800)
    assert [r.code for r in order.issues().collect()] == ["PCP-OVERRIDE-CHAIN"]
    with pytest.raises(PackageError, match="MissingDependency"):
        LoadOrder(spark, [b, a])
    assert LoadOrder.repair(spark, [b, a])[0] == [a, b]
    with pytest.raises(PackageError, match="IncompatiblePackages"):
        LoadOrder(spark, [a, c])
    assert LoadOrder(spark, [a, c], editor=True).record_count() == 1
    with pytest.raises(PackageError, match="DuplicatePackage"):
        LoadOrder(spark, [a, a])
