"""Column functions: ids, labels, flags, little-endian bytes, displays, collections. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import model as M
from ..codec import Limits


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- ids ------------------------------------------------------------------------------------------


def record_id(package_index: Column | str, local: Column | str) -> Column:
    ok = c(local).between(0, M.MAX_LOCAL)
    return F.when(ok, F.shiftleft(c(package_index).cast("long"), 24).bitwiseOR(c(local).cast("long"))).otherwise(F.raise_error(F.lit("LocalIdentifierOutOfRange")).cast("long"))


def package_index(rid: Column | str) -> Column:
    return F.shiftright(c(rid), 24).cast("int")


def local_id(rid: Column | str) -> Column:
    return c(rid).bitwiseAND(F.lit(M.MAX_LOCAL).cast("long"))


def has_flags(flags: Column | str, mask: int) -> Column:
    return c(flags).bitwiseAND(F.lit(mask).cast("long")) == mask


def application_bits(flags: Column | str) -> Column:
    return c(flags).bitwiseAND(F.lit(~(M.DELETED | M.PERSISTENT) & 0xFFFFFFFF).cast("long"))


# --- bytes ----------------------------------------------------------------------------------------


def le32(x: Column | str) -> Column:
    """Four little-endian bytes of an unsigned number."""
    h = F.lpad(F.hex(c(x).cast("long")), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]))


def le_f32(x: Column | str) -> Column:
    """Four little-endian bytes of a 32-bit float: sign, exponent and fraction by arithmetic, rounded to even; NaN is 7FC00000."""
    v = c(x).cast("float").cast("double")
    a = F.abs(v)
    power = F.greatest(F.floor(F.log2(a)), F.lit(-126)).cast("int")
    power = F.when(a >= F.pow(F.lit(2.0), power + 1), power + 1).when((a < F.pow(F.lit(2.0), power)) & (power > -126), power - 1).otherwise(power)
    scaled = (a * F.pow(F.lit(2.0), 23 - power)).cast("long")  # exact: the value has 24 bits
    bits = F.when(scaled >= 1 << 23, (power.cast("long") + 127) * (1 << 23) + scaled - (1 << 23)).otherwise(scaled)
    sign = F.when((v < 0) | F.startswith(v.cast("string"), F.lit("-")), F.lit(1 << 31).cast("long")).otherwise(F.lit(0).cast("long"))
    bits = F.when(F.isnan(v), F.lit(0x7FC00000).cast("long")).when(a == float("inf"), F.lit(0x7F800000).cast("long") + sign).when(v == 0, sign).otherwise(bits + sign)
    return le32(bits)


def from_le(x: Column | str, n: int = 4) -> Column:
    """The unsigned number of n little-endian bytes (n up to 7)."""
    h = F.hex(c(x))
    return F.conv(F.concat(*[F.substring(h, 2 * i - 1, 2) for i in range(n, 0, -1)]), 16, 10).cast("long")


def label_id(label: Column | str) -> Column:
    return from_le(label)


def label_int(label: Column | str) -> Column:
    u = from_le(label)
    return F.when(u >= 1 << 31, u - (1 << 32)).otherwise(u).cast("int")


def label_grid(label: Column | str) -> Column:
    """struct(x, y); y stands first in the bytes."""

    def half(at: int) -> Column:
        u = from_le(F.substring(c(label), at, 2), 2)
        return F.when(u >= 1 << 15, u - (1 << 16)).otherwise(u).cast("int")

    return F.struct(half(3).alias("x"), half(1).alias("y"))


def group_type_name(kind: Column | str) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for k, v in M.GROUP_TYPES.items():
        out = out.when(c(kind) == k, v)
    return out.otherwise(F.concat(F.lit("Unknown("), c(kind), F.lit(")")))


# --- displays -------------------------------------------------------------------------------------


def show_id(rid: Column | str) -> Column:
    return F.lpad(F.hex(c(rid).cast("long")), 8, "0")


def show_package_id(raw: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.hex(c(raw))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def show_hex(raw: Column | str) -> Column:
    return F.lower(F.hex(c(raw)))


def show_signature(raw: Column | str) -> Column:
    """Graphic ASCII as it is, other bytes as \\xHH."""
    h = F.hex(c(raw))
    pairs = F.transform(F.sequence(F.lit(0), F.length(c(raw)) - 1), lambda i: F.substring(h, 2 * i + 1, F.lit(2)))
    return F.array_join(F.transform(pairs, lambda p: F.when((p >= "21") & (p <= "7E"), F.chr(F.conv(p, 16, 10).cast("long"))).otherwise(F.concat(F.lit("\\x"), p))), "")


def join_bytes(parts: Column | str) -> Column:
    """The concatenation of an array of BINARY, in one pass: a fold would copy what it has so far at each step."""
    return F.unhex(F.array_join(F.transform(c(parts), lambda x: F.hex(x)), ""))


# --- records --------------------------------------------------------------------------------------


def encode_fields(fields: Column | str) -> Column:
    """Bytes of an array of struct(signature, payload)."""
    framed = F.transform(c(fields), lambda x: F.concat(x["signature"], le32(F.length(x["payload"])), x["payload"]))
    return join_bytes(framed)


def record_bytes(sig: Column | str, payload: Column | str, flags: Column | str, rid: Column | str, version_raw: Column | str, change: Column | str) -> Column:
    return F.concat(c(sig), le32(F.length(c(payload))), le32(flags), le32(rid), c(version_raw), c(change), c(payload))


def record_digest(sig: Column | str, payload: Column | str, flags: Column | str, rid: Column | str, version_raw: Column | str) -> Column:
    """SHA-256 of the record with a zero change set."""
    return F.unhex(F.sha2(record_bytes(sig, payload, flags, rid, version_raw, F.unhex(F.lit("00" * 32))), 256))


# --- collections ----------------------------------------------------------------------------------


def _fail(code: str) -> Column:
    return F.raise_error(F.lit(code)).cast("binary")


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once. Inside a lambda Spark shares nothing: an expression is evaluated wherever it is written,
    and nested ones multiply."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _turned(n: Column) -> Column:
    """The unsigned 32-bit number of n's bytes in the opposite order; n is written several times."""
    mask = lambda x, m: x.bitwiseAND(F.lit(m).cast("long"))
    outer = F.shiftleft(mask(n, 0xFF), 24).bitwiseOR(F.shiftright(n, 24))
    return outer.bitwiseOR(F.shiftleft(mask(n, 0xFF00), 8)).bitwiseOR(mask(F.shiftright(n, 8), 0xFF00))


def _size_hex(n: Column) -> Column:
    """The digits of a size's four little-endian bytes."""
    return F.lpad(F.hex(_turned(n.cast("long"))), 8, "0")


def _bounded(items: Column, n: Column, limits: Limits, out: Column) -> Column:
    """out, or an error if n elements or the items' bytes are beyond the limits."""
    total = F.aggregate(items, F.lit(4).cast("long"), lambda a, x: a + F.length(x) + 4)
    return (
        F.when(n > limits.elements, _fail("TooManyElements"))
        .when(F.exists(items, lambda x: F.length(x) > limits.element_bytes), _fail("ElementTooLarge"))
        .when(total > limits.total_bytes, _fail("CollectionTooLarge"))
        .otherwise(out)
    )


def encode_list(items: Column | str, limits: Limits = Limits()) -> Column:
    """Bytes of an array of BINARY: count, then length and bytes of each."""
    body = lambda x: F.array_join(F.transform(x, lambda i: F.concat(_size_hex(F.length(i)), F.hex(i))), "")
    return let(c(items), lambda x: _bounded(x, F.size(x), limits, F.unhex(F.concat(_size_hex(F.size(x)), body(x)))))


def _blobs(raw: Column, each: int, limits: Limits) -> Column:
    """The array of a collection's blobs, ``each`` of them an element."""
    none = lambda code: F.array(_fail(code))
    size_at = lambda r, at: let(F.conv(F.hex(F.substring(r, at.cast("int"), F.lit(4))), 16, 10).cast("long"), _turned)

    def read(r: Column, n: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            left = F.octet_length(r) + 1 - s["at"]
            item = F.when((s["size"] <= left) & (s["size"] <= limits.element_bytes), F.substring(r, s["at"].cast("int"), s["size"].cast("int")))
            item = item.when((left >= 0) & (s["size"] > limits.element_bytes), _fail("ElementTooLarge")).otherwise(_fail("TruncatedCollection"))
            after = s["at"] + s["size"]
            # The items stand first: a size that leads beyond the bytes is an error there, before it is a place.
            return F.struct(F.array_append(s["items"], item).alias("items"), (after + 4).alias("at"), size_at(r, after).alias("size"))

        # at is the place of the next element's bytes, four after that of its size.
        start = F.struct(F.expr("cast(array() as array<binary>)").alias("items"), F.lit(9).cast("long").alias("at"), size_at(r, F.lit(5)).alias("size"))
        end = lambda s: F.when(s["at"] == F.octet_length(r) + 5, s["items"]).otherwise(none("TrailingCollectionBytes"))
        return F.aggregate(F.array_repeat(F.lit(0), (n * each).cast("int")), start, step, end)

    def whole(r: Column, n: Column) -> Column:
        return (
            F.when(F.octet_length(r) > limits.total_bytes, none("CollectionTooLarge"))
            .when(F.octet_length(r) < 4, none("TruncatedCollection"))
            .when(n > limits.elements, none("TooManyElements"))
            .when(n * 4 * each + 4 > F.octet_length(r), none("TruncatedCollection"))
            .when(r.isNotNull(), read(r, n))
        )

    return let(raw, lambda r: let(size_at(r, F.lit(1)), lambda n: whole(r, n)))


def decode_list(raw: Column | str, limits: Limits = Limits()) -> Column:
    """The array of BINARY that an encoded list holds. Each blob's place follows from the one before, so this is a fold;
    it copies what it has at each step, which is meant for lists of up to some thousand elements."""
    return _blobs(c(raw), 1, limits)


def decode_set(raw: Column | str, limits: Limits = Limits()) -> Column:
    """Elements in the order of the bytes; repeated ones are an error."""
    one = F.array(decode_list(raw, limits))
    return F.get(F.transform(one, lambda x: F.when(F.size(F.array_distinct(x)) < F.size(x), F.array(_fail("DuplicateSetElement"))).otherwise(x)), F.lit(0))


def decode_map(raw: Column | str, limits: Limits = Limits()) -> Column:
    """The array of struct(k, v) that an encoded map holds, in the order of the bytes; repeated keys are an error."""
    pair = lambda x: F.transform(F.filter(x, lambda _, i: i % 2 == 0), lambda k, i: F.struct(k.alias("k"), F.get(x, 2 * i + 1).alias("v")))
    one = F.transform(F.array(_blobs(c(raw), 2, limits)), pair)
    keys = lambda x: F.transform(x, lambda p: p["k"])
    wrong = lambda: F.array(F.struct(_fail("DuplicateMapKey").alias("k"), F.lit(None).cast("binary").alias("v")))
    return F.get(F.transform(one, lambda x: F.when(F.size(F.array_distinct(keys(x))) < F.size(x), wrong()).otherwise(x)), F.lit(0))


def encode_set(items: Column | str, limits: Limits = Limits()) -> Column:
    ordered = F.array_sort(c(items))
    return F.when(F.size(F.array_distinct(c(items))) == F.size(c(items)), encode_list(ordered, limits)).otherwise(_fail("DuplicateSetElement"))


def encode_map(pairs: Column | str, limits: Limits = Limits()) -> Column:
    """Bytes of an array of struct(k, v), by key."""
    ordered = F.array_sort(c(pairs))
    keys = F.transform(c(pairs), lambda p: p["k"])
    body = F.concat(le32(F.size(c(pairs))), join_bytes(F.transform(ordered, lambda p: F.concat(le32(F.length(p["k"])), p["k"], le32(F.length(p["v"])), p["v"]))))
    body = _bounded(F.concat(keys, F.transform(c(pairs), lambda p: p["v"])), F.size(keys), limits, body)
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), body).otherwise(_fail("DuplicateMapKey"))


def append_all(dst: Column | str, src: Column | str) -> Column:
    return F.concat(c(dst), c(src))


def append_new_indices(dst: Column | str, src: Column | str) -> Column:
    """dst, then what src has beyond the length of dst."""
    rest = F.greatest(F.size(c(src)) - F.size(c(dst)), F.lit(0))
    return F.concat(c(dst), F.slice(c(src), F.size(c(dst)) + 1, rest))


def append_unique(dst: Column | str, src: Column | str) -> Column:
    """dst with its own repeats, then each item of src that isn't in it, once.

    Two hash-based set functions instead of a fold, so long lists stay linear.
    """
    return F.concat(c(dst), F.array_except(c(src), c(dst)))
