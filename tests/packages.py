"""Small packages built in code, for the tests."""

import struct

from overstrata import codec as B


def u32(v):
    return struct.pack("<I", v)


def pid(n):
    return bytes([n]) * 16


def item(rid, name, value, weight=None, base=None, flags=0, extra=()):
    f = [(b"EDID", name.encode()), (b"VALU", u32(value))]
    if weight is not None:
        f.append((b"WGHT", struct.pack("<f", weight)))
    if base is not None:
        f.append((b"BASE", u32(base)))
    return B.record(b"ITEM", [*f, *extra], rid, flags)


def entity(rid, name="", flags=0, sig=b"ENTY"):
    return B.record(sig, [(b"NAME", name.encode())] if name else [], rid, flags)


def package(n, entries, deps=(), owned=0, total=None, **header):
    h = B.Header(pid(n), record_count=owned if total is None else total, owned_record_count=owned, dependencies=tuple(B.Relation(pid(d), f"p{d}") for d in deps), **header)
    return h.encode() + b"".join(entries)


def values(image):
    """{record id: {signature: payload}} of a package."""
    s = B.Memory(image)
    _, records, _ = B.build_index(s)
    return {r.id: dict(B.fields_of(s.read(r.payload_offset, r.size))) for r, _ in records}
