"""Value types and schemas of the content-package model.

A package is a file of nested groups, records and subrecords, all little-endian. Ids are unsigned 32-bit numbers and
travel as LONG; signatures, labels and payloads are opaque bytes and travel as BINARY.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

# Fixed values of the format.
PACKAGE_EXTENSION, SAVE_EXTENSION = "pcp", "sdp"
HEADER_SIGNATURE, GROUP_SIGNATURE = b"PKHD", b"GRUP"
FORMAT_VERSION = 4
RECORD_HEADER_BYTES, GROUP_HEADER_BYTES, SUBRECORD_HEADER_BYTES = 52, 16, 8
MAX_LOCAL, MAX_COMPACT_LOCAL = 0xFFFFFF, 0xFFF
FIRST_FULL_LOCAL, FIRST_COMPACT_LOCAL = 0x800, 1
MAX_DEPENDENCIES = 254
MAX_FULL, MAX_COMPACT, MAX_COMPACT_OWNED = 254, 4096, 4096
COMPACT_BASE = 0xFE000000
DELETED, PERSISTENT = 1, 2
FULL, COMPACT, OVERLAY = 0, 1, 2
LOAD_CLASSES = {FULL: "Full", COMPACT: "Compact", OVERLAY: "Overlay"}
GROUP_TYPES = {
    0: "Top",
    1: "WorldChildren",
    2: "InteriorBlock",
    3: "InteriorSubBlock",
    4: "ExteriorBlock",
    5: "ExteriorSubBlock",
    6: "SceneChildren",
    7: "TopicChildren",
    8: "ScenePersistentChildren",
    9: "SceneTemporaryChildren",
    10: "QuestChildren",
}
#: Group types whose label is the id of the record they belong to.
RECORD_LABELLED = (1, 6, 7, 8, 9, 10)
WORLD, SCENE, PERSISTENT_CHILDREN, TEMPORARY_CHILDREN = 1, 6, 8, 9

# Spark schemas. package_index is the place of a package in its load order.
PACKAGES = (
    "package_index int, path string, package_id binary, format_version int, load_class int, next_local_identifier long, record_count long,"
    " owned_record_count long, author string, description string, schema_namespace string, package_version string, byte_count long,"
    " content_offset long, header_last_change_set binary"
)
RELATIONS = "package_index int, ord int, package_id binary, name string, requirement string"
STREAMING_OVERRIDES = "package_index int, ord int, record_id long"
SCENE_OFFSETS = "package_index int, table_ord int, world_id long, ord int, scene_id long, start_offset long, end_offset long"
STEP = "struct<header_offset:long,label:binary,group_type:int>"
GROUPS = (
    "package_index int, pre_order long, depth int, header_offset long, payload_offset long, end_offset long, group_byte_count long,"
    f" label binary, group_type int, parent_offset long, path array<{STEP}>"
)
RECORDS = (
    "package_index int, record_ord long, pre_order long, header_offset long, payload_offset long, signature binary, flags long, record_id long,"
    f" version float, version_raw binary, last_change_set binary, payload binary, parent_offset long, path array<{STEP}>"
)
SUBRECORDS = "package_index int, record_id long, record_ord long, ord int, occurrence int, signature binary, payload binary"
ISSUES = "code string, severity string, message string, package_index int, package_id binary, related binary, record_id long"
FIELDS = "array<struct<signature:binary,payload:binary>>"


class PackageError(ValueError):
    """A violation of the format or of an operator's rules; ``code`` names it, and ``detail`` has its values."""

    def __init__(self, code: str, **detail: object):
        self.code, self.detail = code, detail
        super().__init__(code + ("" if not detail else " (" + ", ".join(f"{k}={v}" for k, v in detail.items()) + ")"))


def signature(text: str) -> bytes:
    """Four ASCII characters as bytes."""
    if not text.isascii():
        raise PackageError("SignatureNotAscii", text=text)
    if len(text) != 4:
        raise PackageError("SignatureLength", length=len(text))
    return text.encode()


def show_signature(raw: bytes) -> str:
    """Graphic ASCII as it is, anything else as \\xHH."""
    return "".join(chr(b) if 0x21 <= b <= 0x7E else f"\\x{b:02X}" for b in raw)


def show_package_id(raw: bytes) -> str:
    h = raw.hex()
    return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))


def record_id(package_index: int, local: int) -> int:
    if not 0 <= local <= MAX_LOCAL:
        raise PackageError("LocalIdentifierOutOfRange", local=local)
    return (package_index << 24) | local


def split_id(raw: int) -> tuple[int, int]:
    return raw >> 24, raw & MAX_LOCAL


def label_from_id(raw: int) -> bytes:
    return struct.pack("<I", raw)


def label_from_int(value: int) -> bytes:
    return struct.pack("<i", value)


def label_from_grid(x: int, y: int) -> bytes:
    """y stands first."""
    return struct.pack("<hh", y, x)


def label_id(raw: bytes) -> int:
    return struct.unpack("<I", raw)[0]


def label_int(raw: bytes) -> int:
    return struct.unpack("<i", raw)[0]


def label_grid(raw: bytes) -> tuple[int, int]:
    y, x = struct.unpack("<hh", raw)
    return x, y


def group_type_name(raw: int) -> str:
    return GROUP_TYPES.get(raw, f"Unknown({raw})")


@dataclass(frozen=True)
class Flags:
    bits: int = 0

    def contains(self, other: int) -> bool:
        return self.bits & other == other

    @property
    def application_bits(self) -> int:
        return self.bits & ~(DELETED | PERSISTENT) & 0xFFFFFFFF
