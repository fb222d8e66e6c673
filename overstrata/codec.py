"""Bytes of packages, encoded collections and history files. Plain Python: Spark runs it inside tasks."""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

from . import model as M
from .model import PackageError
from .semver import Requirement, Version

NO_CHANGE = bytes(32)


# --- chunks ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Record:
    """A record's header with its place; the payload is read on demand."""

    signature: bytes
    size: int
    flags: int
    id: int
    version_raw: bytes
    last_change_set: bytes
    offset: int = 0

    @property
    def version(self) -> float:
        return struct.unpack("<f", self.version_raw)[0]

    @property
    def payload_offset(self) -> int:
        return self.offset + M.RECORD_HEADER_BYTES

    @property
    def end(self) -> int:
        return self.payload_offset + self.size


@dataclass(frozen=True)
class Group:
    size: int
    label: bytes
    type: int
    offset: int = 0

    @property
    def payload_offset(self) -> int:
        return self.offset + M.GROUP_HEADER_BYTES

    @property
    def end(self) -> int:
        return self.offset + self.size


def record_header(h: Record) -> bytes:
    return h.signature + struct.pack("<III", h.size, h.flags, h.id) + h.version_raw + h.last_change_set


def decode_record_header(raw: bytes, offset: int = 0) -> Record:
    size, flags, rid = struct.unpack_from("<III", raw, 4)
    h = Record(bytes(raw[:4]), size, flags, rid, bytes(raw[16:20]), bytes(raw[20:52]), offset)
    check_version(h.version)
    return h


def check_version(v: float) -> None:
    if not math.isfinite(v) or v < 0:
        raise PackageError("InvalidRecordVersion", version=v)


def group_header(g: Group) -> bytes:
    return M.GROUP_SIGNATURE + struct.pack("<I", g.size) + g.label + struct.pack("<i", g.type)


def decode_group_header(raw: bytes, offset: int = 0) -> Group:
    if bytes(raw[:4]) != M.GROUP_SIGNATURE:
        raise PackageError("InvalidGroupSignature", signature=M.show_signature(bytes(raw[:4])))
    (size,), (kind,) = struct.unpack_from("<I", raw, 4), struct.unpack_from("<i", raw, 12)
    if size < M.GROUP_HEADER_BYTES:
        raise PackageError("InvalidGroupSize", size=size)
    return Group(size, bytes(raw[8:12]), kind, offset)


def subrecord(sig: bytes, payload: bytes) -> bytes:
    if len(payload) > 0xFFFFFFFF:
        raise PackageError("SubrecordTooLarge", size=len(payload))
    return sig + struct.pack("<I", len(payload)) + payload


def fields_of(payload: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(signature, bytes) of each subrecord."""
    at = 0
    while at < len(payload):
        if len(payload) - at < M.SUBRECORD_HEADER_BYTES:
            raise PackageError("TruncatedSubrecordHeader", at=at)
        (n,) = struct.unpack_from("<I", payload, at + 4)
        if n > len(payload) - at - M.SUBRECORD_HEADER_BYTES:
            raise PackageError("SubrecordExceedsRecord", at=at, size=n)
        yield bytes(payload[at : at + 4]), bytes(payload[at + 8 : at + 8 + n])
        at += 8 + n


def subrecord_ranges(payload: bytes) -> list[tuple[bytes, int, int]]:
    """(signature, start, end) of each framed subrecord."""
    out, at = [], 0
    for sig, body in fields_of(payload):
        out.append((sig, at, at + 8 + len(body)))
        at += 8 + len(body)
    return out


def encode_fields(fields: Iterable[tuple[bytes, bytes]]) -> bytes:
    return b"".join(subrecord(s, p) for s, p in fields)


def record(sig: bytes, fields: Iterable[tuple[bytes, bytes]] | bytes, rid: int, flags: int = 0, version: float | bytes = 1.0, change: bytes = NO_CHANGE) -> bytes:
    if sig == M.GROUP_SIGNATURE:
        raise PackageError("ReservedRecordSignature")
    raw = version if isinstance(version, bytes) else struct.pack("<f", version)
    check_version(struct.unpack("<f", raw)[0])
    body = fields if isinstance(fields, bytes) else encode_fields(fields)
    if len(body) > 0xFFFFFFFF:
        raise PackageError("RecordTooLarge", size=len(body))
    return record_header(Record(sig, len(body), flags, rid, raw, change)) + body


def group(label: bytes, kind: int, entries: Iterable[bytes]) -> bytes:
    body = b"".join(entries)
    if len(body) + M.GROUP_HEADER_BYTES > 0xFFFFFFFF:
        raise PackageError("GroupTooLarge", size=len(body))
    return group_header(Group(len(body) + M.GROUP_HEADER_BYTES, label, kind)) + body


def record_digest(sig: bytes, body: bytes, rid: int, flags: int, version_raw: bytes) -> bytes:
    """SHA-256 of the record's bytes with its last change set zeroed."""
    return hashlib.sha256(record_header(Record(sig, len(body), flags, rid, version_raw, NO_CHANGE)) + body).digest()


# --- sources --------------------------------------------------------------------------------------


class Memory:
    """Random access to bytes."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def read(self, offset: int, n: int) -> bytes:
        if offset < 0 or offset + n > self.size:
            raise PackageError("ReadBeyondSource", offset=offset, size=n)
        return self.data[offset : offset + n]


def file_system(path: str):
    """(file system, path in it) of a local path or a URI."""
    import pyarrow.fs as pafs

    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


class File:
    """Random access to a file of any file system that pyarrow opens."""

    def __init__(self, path: str):
        fs, at = file_system(path)
        self.f = fs.open_input_file(at)
        self.size = self.f.size()

    def read(self, offset: int, n: int) -> bytes:
        data = self.f.read_at(n, offset)
        if len(data) != n:
            raise PackageError("ReadBeyondSource", offset=offset, size=n)
        return data


def entries(source: Memory | File, start: int = 0, end: int | None = None) -> Iterator[Record | Group]:
    """Entries side by side in a range; payloads are skipped, not read."""
    end = source.size if end is None else end
    if start > end or end > source.size:
        raise PackageError("InvalidRange", start=start, end=end)
    at = start
    while at < end:
        left = end - at
        if left < M.GROUP_HEADER_BYTES:
            raise PackageError("TruncatedEntry", offset=at)
        raw = source.read(at, min(left, M.RECORD_HEADER_BYTES))
        if raw[:4] == M.GROUP_SIGNATURE:
            entry: Record | Group = decode_group_header(raw, at)
        else:
            if left < M.RECORD_HEADER_BYTES:
                raise PackageError("TruncatedEntry", offset=at)
            entry = decode_record_header(raw, at)
        if entry.end > end:
            raise PackageError("EntryExceedsRange", offset=at, end=entry.end, limit=end)
        yield entry
        at = entry.end


def walk(source: Memory | File, start: int, end: int, path: tuple[Group, ...] = (), descend=None) -> Iterator[tuple[Record | Group, tuple[Group, ...]]]:
    """Entries with their ancestors, in pre-order. descend(group, path): whether to go into a group."""
    stack = [(entries(source, start, end), path)]
    while stack:
        it, here = stack[-1]
        entry = next(it, None)
        if entry is None:
            stack.pop()
            continue
        yield entry, here
        if isinstance(entry, Group) and (descend is None or descend(entry, here)):
            stack.append((entries(source, entry.payload_offset, entry.end), (*here, entry)))


# --- package header -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Relation:
    """A dependency or an incompatibility."""

    package_id: bytes
    name: str
    requirement: str | None = None

    def __post_init__(self):
        if self.package_id == bytes(16):
            raise PackageError("NilPackageId")
        if not self.name:
            raise PackageError("EmptyRelationshipName")
        if "\0" in self.name:
            raise PackageError("RelationshipNameContainsNul")
        if self.requirement is not None:
            object.__setattr__(self, "requirement", str(Requirement(self.requirement)))

    def encode(self) -> bytes:
        return self.package_id + (b"" if self.requirement is None else self.requirement.encode() + b"\0") + self.name.encode()

    @classmethod
    def decode(cls, raw: bytes, sig: bytes) -> Relation:
        if len(raw) <= 16:
            raise PackageError("InvalidRelationship", signature=sig.decode())
        head, nul, tail = raw[16:].partition(b"\0")
        return cls(raw[:16], _text(tail if nul else head, sig), _text(head, sig) if nul else None)


@dataclass(frozen=True)
class SceneOffset:
    scene_id: int
    start: int
    end: int

    def __post_init__(self):
        if self.start >= self.end:
            raise PackageError("InvalidSceneOffset", scene=self.scene_id)

    def shifted(self, delta: int) -> SceneOffset:
        if not (0 <= self.start + delta and self.end + delta < 1 << 64):
            raise PackageError("SceneOffsetOverflow", scene=self.scene_id)
        return SceneOffset(self.scene_id, self.start + delta, self.end + delta)


@dataclass(frozen=True)
class SceneTable:
    """Scenes of a world; None is the interior. World 0 can't be told from the interior once encoded."""

    world_id: int | None
    offsets: tuple[SceneOffset, ...] = ()

    def __post_init__(self):
        if len({o.scene_id for o in self.offsets}) != len(self.offsets):
            raise PackageError("DuplicateSceneOffset")

    def encode(self) -> bytes:
        return struct.pack("<II", self.world_id or 0, len(self.offsets)) + b"".join(struct.pack("<IQQ", o.scene_id, o.start, o.end) for o in self.offsets)

    @classmethod
    def decode(cls, raw: bytes) -> SceneTable:
        if len(raw) < 8:
            raise PackageError("InvalidSceneOffsetTableSize", size=len(raw))
        world, n = struct.unpack_from("<II", raw)
        if len(raw) != 8 + 20 * n:
            raise PackageError("InvalidSceneOffsetTableSize", size=len(raw))
        return cls(world or None, tuple(SceneOffset(*struct.unpack_from("<IQQ", raw, 8 + 20 * i)) for i in range(n)))


def _text(raw: bytes, sig: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        raise PackageError("InvalidUtf8", signature=sig.decode()) from None


def _distinct(relations: Iterable[Relation], own: bytes, kind: str, limit: int | None) -> tuple[Relation, ...]:
    out = tuple(relations)
    if any(r.package_id == own for r in out):
        raise PackageError(f"Self{kind}")
    if len({r.package_id for r in out}) != len(out):
        raise PackageError(f"Duplicate{kind}")
    if limit is not None and len(out) > limit:
        raise PackageError("TooManyDependencies", count=len(out))
    return out


@dataclass(frozen=True)
class Header:
    """Metadata of a package. Changes make a new one, through ``with_``."""

    package_id: bytes
    load_class: int = M.FULL
    next_local: int = M.FIRST_FULL_LOCAL
    record_count: int = 0
    owned_record_count: int = 0
    author: str = ""
    description: str = ""
    schema_namespace: str = ""
    version: str = "0.1.0"
    dependencies: tuple[Relation, ...] = ()
    incompatibilities: tuple[Relation, ...] = ()
    streaming_overrides: tuple[int, ...] = ()
    scene_tables: tuple[SceneTable, ...] = field(default=())

    def __post_init__(self):
        if self.package_id == bytes(16):
            raise PackageError("NilPackageId")
        if self.load_class not in M.LOAD_CLASSES:
            raise PackageError("InvalidLoadClass", value=self.load_class)
        if self.next_local > M.MAX_LOCAL:
            raise PackageError("NextLocalIdentifierOutOfRange", value=self.next_local)
        Version(self.version)
        # 254 everywhere: with 255 a package's own index would not fit its ids.
        object.__setattr__(self, "dependencies", _distinct(self.dependencies, self.package_id, "Dependency", M.MAX_DEPENDENCIES))
        object.__setattr__(self, "incompatibilities", _distinct(self.incompatibilities, self.package_id, "Incompatibility", None))
        object.__setattr__(self, "streaming_overrides", tuple(dict.fromkeys(self.streaming_overrides)))
        if len({t.world_id for t in self.scene_tables}) != len(self.scene_tables):
            raise PackageError("DuplicateSceneOffsetTable")

    def with_(self, **changes) -> Header:
        return replace(self, **changes)

    @property
    def first_owned_local(self) -> int:
        return M.FIRST_COMPACT_LOCAL if self.load_class == M.COMPACT else M.FIRST_FULL_LOCAL

    def with_load_class(self, value: int) -> Header:
        """A package without records that still has the first id of a full one starts at its new class's."""
        h = self.with_(load_class=value)
        return h.with_(next_local=h.first_owned_local) if not self.record_count and self.next_local == M.FIRST_FULL_LOCAL else h

    def with_dependency(self, r: Relation) -> Header:
        return self.with_(dependencies=(*self.dependencies, r))

    def without_dependency(self, package_id: bytes) -> Header:
        return self.with_(dependencies=tuple(r for r in self.dependencies if r.package_id != package_id))

    def with_incompatibility(self, r: Relation) -> Header:
        return self.with_(incompatibilities=(*self.incompatibilities, r))

    def without_incompatibility(self, package_id: bytes) -> Header:
        return self.with_(incompatibilities=tuple(r for r in self.incompatibilities if r.package_id != package_id))

    def scene_table(self, world_id: int | None) -> SceneTable | None:
        return next((t for t in self.scene_tables if t.world_id == world_id), None)

    def shifted(self, delta: int) -> Header:
        return self.with_(scene_tables=tuple(SceneTable(t.world_id, tuple(o.shifted(delta) for o in t.offsets)) for t in self.scene_tables))

    def check_load_class(self) -> None:
        if self.load_class == M.COMPACT:
            if self.owned_record_count > M.MAX_COMPACT_OWNED:
                raise PackageError("CompactRecordLimitExceeded", count=self.owned_record_count)
            if self.next_local > 0x1000:
                raise PackageError("CompactNextIdentifierOutOfRange", value=self.next_local)
        if self.load_class == M.OVERLAY and self.owned_record_count:
            raise PackageError("OverlayOwnsRecords", count=self.owned_record_count)

    def encode(self, change: bytes = NO_CHANGE) -> bytes:
        self.check_load_class()
        u32 = lambda v: struct.pack("<I", v)
        # Fixed order of the fields.
        out = [(b"FMTV", u32(M.FORMAT_VERSION)), (b"PKID", self.package_id), (b"CLAS", bytes([self.load_class])), (b"NXID", u32(self.next_local)), (b"RCNT", u32(self.record_count)), (b"ORCT", u32(self.owned_record_count))]
        out += [(s, t.encode()) for s, t in ((b"AUTH", self.author), (b"DESC", self.description), (b"SCHM", self.schema_namespace)) if t]
        out.append((b"PVER", str(Version(self.version)).encode()))
        out += [(b"DEPN", r.encode()) for r in self.dependencies] + [(b"INCM", r.encode()) for r in self.incompatibilities]
        out += [(b"SOVR", u32(i)) for i in self.streaming_overrides] + [(b"SOFF", t.encode()) for t in self.scene_tables]
        return record(M.HEADER_SIGNATURE, out, 0, change=change)

    @classmethod
    def decode(cls, payload: bytes) -> Header:
        single: dict[bytes, bytes] = {}
        many: dict[bytes, list[bytes]] = {b"DEPN": [], b"INCM": [], b"SOVR": [], b"SOFF": []}
        sizes = {b"FMTV": 4, b"PKID": 16, b"CLAS": 1, b"NXID": 4, b"RCNT": 4, b"ORCT": 4, b"SOVR": 4}
        for sig, body in fields_of(payload):
            if sig not in many and sig not in (*sizes, b"AUTH", b"DESC", b"SCHM", b"PVER"):
                raise PackageError("UnknownHeaderField", signature=M.show_signature(sig))
            if sig in sizes and len(body) != sizes[sig]:
                raise PackageError("InvalidFieldSize", signature=sig.decode(), expected=sizes[sig], actual=len(body))
            if sig in many:
                many[sig].append(body)
            elif sig in single:
                raise PackageError("DuplicateHeaderField", signature=sig.decode())
            else:
                single[sig] = body
        for sig in (b"FMTV", b"PKID", b"CLAS", b"NXID", b"RCNT", b"ORCT", b"PVER"):
            if sig not in single:
                raise PackageError("MissingHeaderField", signature=sig.decode())
        u32 = lambda s: struct.unpack("<I", single[s])[0]
        if u32(b"FMTV") != M.FORMAT_VERSION:
            raise PackageError("UnsupportedFormatVersion", version=u32(b"FMTV"))
        text = lambda s: _text(single.get(s, b""), s)
        return cls(
            single[b"PKID"], single[b"CLAS"][0], u32(b"NXID"), u32(b"RCNT"), u32(b"ORCT"), text(b"AUTH"), text(b"DESC"), text(b"SCHM"), text(b"PVER"),
            tuple(Relation.decode(x, b"DEPN") for x in many[b"DEPN"]), tuple(Relation.decode(x, b"INCM") for x in many[b"INCM"]),
            tuple(struct.unpack("<I", x)[0] for x in many[b"SOVR"]), tuple(SceneTable.decode(x) for x in many[b"SOFF"]),
        )


@dataclass(frozen=True)
class Opened:
    """A package whose header alone has been read."""

    source: Memory | File
    record: Record
    header: Header

    @property
    def content_offset(self) -> int:
        return self.record.end


def open_package(source: Memory | File) -> Opened:
    first = next(entries(source), None)
    if not isinstance(first, Record) or first.signature != M.HEADER_SIGNATURE or first.id != 0:
        raise PackageError("PackageHeaderMustComeFirst")
    header = Header.decode(source.read(first.payload_offset, first.size))
    for t in header.scene_tables:
        for o in t.offsets:
            if o.start < first.end or o.end > source.size:
                raise PackageError("SceneOffsetOutOfBounds", scene=o.scene_id)
    return Opened(source, first, header)


def build_index(source: Memory | File) -> tuple[Opened, list[tuple[Record, tuple[Group, ...]]], list[tuple[Group, tuple[Group, ...]]]]:
    """The package with all its records and groups in order, checked against its header."""
    p = open_package(source)
    records, groups, seen = [], [], set()
    for e, path in walk(source, p.content_offset, source.size):
        if isinstance(e, Group):
            groups.append((e, path))
            continue
        if e.signature == M.HEADER_SIGNATURE:
            raise PackageError("UnexpectedPackageHeader", offset=e.offset)
        if e.id in seen:
            raise PackageError("DuplicateRecordId", id=f"{e.id:08X}")
        seen.add(e.id)
        records.append((e, path))
    if len(records) != p.header.record_count:
        raise PackageError("RecordCountMismatch", expected=p.header.record_count, actual=len(records))
    owned = sum(r.id >> 24 == len(p.header.dependencies) for r, _ in records)
    if owned != p.header.owned_record_count:
        raise PackageError("OwnedRecordCountMismatch", expected=p.header.owned_record_count, actual=owned)
    return p, records, groups


def rewrite_header(image: bytes, header: Header, change: bytes | None = None) -> bytes:
    """A package image with another header; scene ranges move with the content."""
    old = open_package(Memory(image))
    change = old.record.last_change_set if change is None else change
    head = header.encode(change)
    delta = len(head) - old.content_offset
    return (header.shifted(delta).encode(change) if delta else head) + image[old.content_offset :]


# --- encoded collections --------------------------------------------------------------------------


@dataclass(frozen=True)
class Limits:
    elements: int = 1_000_000
    element_bytes: int = 64 << 20
    total_bytes: int = 256 << 20


def encode_list(items: list[bytes], limits: Limits = Limits()) -> bytes:
    _bounded(items, limits)
    return struct.pack("<I", len(items)) + b"".join(struct.pack("<I", len(x)) + x for x in items)


def _bounded(items: list[bytes], limits: Limits) -> None:
    if len(items) > limits.elements:
        raise PackageError("TooManyElements", count=len(items))
    if any(len(x) > limits.element_bytes for x in items):
        raise PackageError("ElementTooLarge")
    if 4 + sum(4 + len(x) for x in items) > limits.total_bytes:
        raise PackageError("CollectionTooLarge")


def _blobs(raw: bytes, each: int, limits: Limits) -> list[bytes]:
    if len(raw) > limits.total_bytes:
        raise PackageError("CollectionTooLarge")
    if len(raw) < 4:
        raise PackageError("TruncatedCollection")
    (n,) = struct.unpack_from("<I", raw)
    if n > limits.elements:
        raise PackageError("TooManyElements", count=n)
    out, at = [], 4
    for _ in range(n * each):
        if len(raw) - at < 4:
            raise PackageError("TruncatedCollection")
        (k,) = struct.unpack_from("<I", raw, at)
        if k > limits.element_bytes:
            raise PackageError("ElementTooLarge", size=k)
        if k > len(raw) - at - 4:
            raise PackageError("TruncatedCollection")
        out.append(bytes(raw[at + 4 : at + 4 + k]))
        at += 4 + k
    if at != len(raw):
        raise PackageError("TrailingCollectionBytes", count=len(raw) - at)
    return out


def decode_list(raw: bytes, limits: Limits = Limits()) -> list[bytes]:
    return _blobs(raw, 1, limits)


def encode_set(items: Iterable[bytes], limits: Limits = Limits()) -> bytes:
    ordered = sorted(items)
    if any(a == b for a, b in zip(ordered, ordered[1:], strict=False)):
        raise PackageError("DuplicateSetElement")
    return encode_list(ordered, limits)


def decode_set(raw: bytes, limits: Limits = Limits()) -> list[bytes]:
    """Any order is accepted, repeated elements are not."""
    out = decode_list(raw, limits)
    if len(set(out)) != len(out):
        raise PackageError("DuplicateSetElement")
    return out


def encode_map(pairs: Iterable[tuple[bytes, bytes]], limits: Limits = Limits()) -> bytes:
    ordered = sorted(pairs, key=lambda kv: kv[0])
    if any(a[0] == b[0] for a, b in zip(ordered, ordered[1:], strict=False)):
        raise PackageError("DuplicateMapKey")
    flat = [x for kv in ordered for x in kv]
    if len(ordered) > limits.elements:
        raise PackageError("TooManyElements", count=len(ordered))
    _bounded(flat, replace(limits, elements=2 * limits.elements))
    return struct.pack("<I", len(ordered)) + b"".join(struct.pack("<I", len(x)) + x for x in flat)


def decode_map(raw: bytes, limits: Limits = Limits()) -> list[tuple[bytes, bytes]]:
    flat = _blobs(raw, 2, limits)
    out = list(zip(flat[::2], flat[1::2], strict=True))
    if len({k for k, _ in out}) != len(out):
        raise PackageError("DuplicateMapKey")
    return out


def append_list(dst: bytes, src: bytes, mode: str, limits: Limits = Limits()) -> bytes:
    """mode: all, new_indices or unique (which keeps what dst repeats)."""
    a, b = decode_list(dst, limits), decode_list(src, limits)
    if mode == "all":
        a = a + b
    elif mode == "new_indices":
        a = a + b[len(a) :]
    elif mode == "unique":
        seen = set(a)
        for x in b:
            if x not in seen:
                seen.add(x)
                a.append(x)
    else:
        raise PackageError("UnknownAppendMode", mode=mode)
    return encode_list(a, limits)


# --- history --------------------------------------------------------------------------------------

ADD, OVERRIDE, DELETE = 0, 1, 2
_HISTORY = b"PCVH\x01\0\0\0"  # fixed value: magic and version of a history file
_CHANGE = b"PCP-CHANGE-SET\0"  # fixed value: what an id's hash begins with


@dataclass(frozen=True)
class Operation:
    kind: int
    record_id: int
    previous: bytes | None = None
    digest: bytes | None = None

    def encode(self) -> bytes:
        return bytes([self.kind]) + struct.pack("<I", self.record_id) + (b"" if self.kind == ADD else self.previous) + (b"" if self.kind == DELETE else self.digest)


@dataclass(frozen=True)
class ChangeSet:
    parents: tuple[bytes, ...]
    destination: bytes
    source: bytes
    author: str
    message: str
    timestamp: int
    operations: tuple[Operation, ...]

    @classmethod
    def create(cls, parents, destination, source, author, message, timestamp, operations) -> ChangeSet:
        if destination == bytes(16) or source == bytes(16):
            raise PackageError("NilPackageId")
        if destination == source:
            raise PackageError("SourceEqualsDestination")
        if not author:
            raise PackageError("EmptyAuthor")
        if not operations:
            raise PackageError("NoOperations")
        if len({o.record_id for o in operations}) != len(operations):
            raise PackageError("DuplicateOperation")
        return cls(tuple(parents), destination, source, author, message, timestamp, tuple(operations))

    @property
    def id(self) -> bytes:
        blob = lambda t: struct.pack("<I", len(t.encode())) + t.encode()
        body = struct.pack("<I", len(self.parents)) + b"".join(self.parents) + self.destination + self.source + struct.pack("<q", self.timestamp)
        return hashlib.sha256(_CHANGE + body + blob(self.author) + blob(self.message) + struct.pack("<I", len(self.operations)) + b"".join(o.encode() for o in self.operations)).digest()


class History:
    """Change sets by id."""

    def __init__(self):
        self.entries: dict[bytes, ChangeSet] = {}

    def insert(self, c: ChangeSet) -> bytes:
        if any(p not in self.entries for p in c.parents):
            raise PackageError("MissingParent")
        if c.id in self.entries:
            raise PackageError("DuplicateChangeSet")
        self.entries[c.id] = c
        return c.id

    def is_ancestor(self, a: bytes, d: bytes) -> bool:
        """True of any id and itself, known or not."""
        todo, seen = [d], set()
        while todo:
            x = todo.pop()
            if x == a:
                return True
            if x not in seen and x in self.entries:
                seen.add(x)
                todo += self.entries[x].parents
        return False

    def to_bytes(self) -> bytes:
        out = [_HISTORY, struct.pack("<I", len(self.entries))]
        for key in sorted(self.entries):
            c = self.entries[key]
            out += [key, struct.pack("<I", len(c.parents)), *c.parents, c.destination, c.source, struct.pack("<q", c.timestamp)]
            for t in (c.author.encode(), c.message.encode()):
                out += [struct.pack("<I", len(t)), t]
            out += [struct.pack("<I", len(c.operations)), *(o.encode() for o in c.operations)]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, raw: bytes) -> History:
        """Entries in any order; of a repeated entry the last counts."""
        at = 0

        def take(n: int) -> bytes:
            nonlocal at
            if n > len(raw) - at:
                raise PackageError("MalformedHistory", reason="truncated")
            at += n
            return raw[at - n : at]

        u32 = lambda: struct.unpack("<I", take(4))[0]
        if take(8) != _HISTORY:
            raise PackageError("MalformedHistory", reason="unsupported header")
        out = cls()
        for _ in range(u32()):
            key = take(32)
            parents = tuple(take(32) for _ in range(u32()))
            dst, src, (ts,) = take(16), take(16), struct.unpack("<q", take(8))
            author, message = (_text(take(u32()), b"PCVH") for _ in range(2))
            ops = []
            for _ in range(u32()):
                kind, rid = take(1)[0], u32()
                if kind > DELETE:
                    raise PackageError("MalformedHistory", reason=f"operation {kind}")
                ops.append(Operation(kind, rid, None if kind == ADD else take(32), None if kind == DELETE else take(32)))
            c = ChangeSet.create(parents, dst, src, author, message, ts, ops)
            if c.id != key:
                raise PackageError("ChangeSetIdMismatch")
            out.entries[key] = c
        if at != len(raw):
            raise PackageError("MalformedHistory", reason="trailing bytes")
        if any(p not in out.entries for c in out.entries.values() for p in c.parents):
            raise PackageError("MissingParent")
        return out
