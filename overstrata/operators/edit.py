"""Batches of keyed mutations on packages.

``apply_batch`` works on tables: one mutation an id, a full-outer join, new sizes of the groups touched. ``edit_package``
works on a file image in one task: all splices of a batch are made in one rebuild, and the result is validated as a whole
before it replaces anything.

An insert goes to the end of its group, or of the file; only groups that hold the target grow. At one offset inserts come
before replacements and deletes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import codec as B
from .. import model as M
from ..functions import columns as K
from ..model import PackageError

INSERT, REPLACE, DELETE = "insert", "replace", "delete"


def apply_batch(rows: DataFrame, mutations: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """rows after mutations (key, kind, columns). Several mutations of a key, an insert of a known key, or a change of
    an unknown one are errors."""
    m = mutations.groupBy(key).agg(F.count("*").alias("_n"), F.min("kind").alias("_kind"), *[F.first(c).alias(f"m_{c}") for c in columns])
    both = rows.withColumn("_here", F.lit(True)).join(m, key, "full_outer")
    bad = (
        F.when(F.col("_n") > 1, "DuplicateMutation")
        .when((F.col("_kind") == INSERT) & F.col("_here"), "RecordExists")
        .when(F.col("_kind").isin(REPLACE, DELETE) & F.col("_here").isNull(), "RecordMissing")
    )
    checked = both.filter(F.when(bad.isNotNull(), F.raise_error(F.concat(bad, F.lit(": "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.coalesce(F.col("_kind") != DELETE, F.lit(True))))
    return checked.select(key, *[F.when(F.col("_kind").isNotNull(), F.col(f"m_{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def group_deltas(records: DataFrame, deltas: DataFrame) -> DataFrame:
    """(package_index, header_offset, delta) of the groups around changed records, from (package_index, record_id, delta)."""
    steps = records.select("package_index", "record_id", F.explode("path").alias("g")).join(deltas, ["package_index", "record_id"])
    return steps.groupBy("package_index", F.col("g.header_offset").alias("header_offset")).agg(F.sum("delta").alias("delta"))


def replace_nth(fields: F.Column, signature: bytes | str, n: int, payload: F.Column) -> F.Column:
    """The array of fields with the payload of the n-th occurrence of a signature changed."""
    before = lambda i: F.size(F.filter(F.slice(fields, 1, i + 1), lambda x: x["signature"] == F.lit(signature)))
    return F.transform(fields, lambda x, i: F.when((x["signature"] == F.lit(signature)) & (before(i) == n + 1), F.struct(x["signature"].alias("signature"), payload.alias("payload"))).otherwise(x))


# --- images ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Mutation:
    """replace: a new payload; insert: a signature, a payload and the header offset of its group (None: the file); delete."""

    kind: str
    record_id: int | None = None
    payload: bytes = b""
    signature: bytes = b""
    group_offset: int | None = None
    flags: int = 0
    version: float = 1.0


def edit_package(image: bytes, batch: Sequence[Mutation]) -> tuple[bytes, list[int]]:
    """(the new image, ids of inserted records). An error leaves nothing changed, as nothing is written before."""
    source = B.Memory(image)
    p, records, groups = B.build_index(source)
    where, own = {r.id: (r, path) for r, path in records}, len(p.header.dependencies)
    by_offset = {g.offset: (g, path) for g, path in groups}
    named = [m.record_id for m in batch if m.record_id is not None]
    if len(set(named)) != len(named):
        raise PackageError("DuplicateMutation")
    next_local, made = p.header.next_local, []
    splices: list[tuple[int, int, int, bytes, tuple[B.Group, ...]]] = []
    count, owned = p.header.record_count, p.header.owned_record_count
    for n, m in enumerate(batch):
        list(B.fields_of(m.payload))  # must be framed
        if m.kind == INSERT:
            if m.record_id is None:
                rid = M.record_id(own, next_local)
            else:
                rid = m.record_id
            at, local = M.split_id(rid)
            if at > own:
                raise PackageError("InvalidPackageIndex", id=f"{rid:08X}")
            if rid in where or rid in made:
                raise PackageError("RecordExists", id=f"{rid:08X}")
            if at == own:
                if p.header.load_class == M.OVERLAY:
                    raise PackageError("OverlayOwnsRecords")
                next_local, owned = max(next_local, local + 1), owned + 1
            if m.group_offset is None:
                end, path = source.size, ()
            elif m.group_offset in by_offset:
                g, above = by_offset[m.group_offset]
                end, path = g.end, (*above, g)
            else:
                raise PackageError("GroupMissing", offset=m.group_offset)
            made.append(rid)
            count += 1
            splices.append((end, 0, n, end, B.record(m.signature, m.payload, rid, m.flags, m.version), path))
            continue
        if m.record_id not in where:
            raise PackageError("RecordMissing", id=m.record_id)
        r, path = where[m.record_id]
        if m.kind == DELETE:
            count, owned = count - 1, owned - (r.id >> 24 == own)
            splices.append((r.offset, 1, n, r.end, b"", path))
        elif m.kind == REPLACE:
            splices.append((r.offset, 1, n, r.end, B.record(r.signature, m.payload, r.id, r.flags, r.version_raw, r.last_change_set), path))
        else:
            raise PackageError("UnknownMutation", kind=m.kind)
    splices.sort(key=lambda s: s[:3])
    delta: dict[int, int] = {}
    for start, _, _, end, new, path in splices:
        for g in path:
            delta[g.offset] = delta.get(g.offset, 0) + len(new) - (end - start)
    for at, d in delta.items():
        g = by_offset[at][0]
        if g.size + d > 0xFFFFFFFF:
            raise PackageError("GroupTooLarge", offset=at)
        splices.append((at, -1, 0, at + M.GROUP_HEADER_BYTES, B.group_header(B.Group(g.size + d, g.label, g.type)), ()))
    out, at = [], p.content_offset
    for start, _, _, end, new, _ in sorted(splices, key=lambda s: s[:3]):
        if start < at:
            raise PackageError("OverlappingMutations", offset=start)
        out += [image[at:start], new]
        at = end
    header = p.header.with_(next_local=next_local, record_count=count, owned_record_count=owned, scene_tables=())
    new_image = header.encode(p.record.last_change_set) + b"".join(out) + image[at:]
    B.build_index(B.Memory(new_image))
    return new_image, made


def replace_subrecord(image: bytes, record_id: int, signature: bytes, n: int, payload: bytes) -> bytes:
    """The image with the n-th subrecord of a signature changed; it is an error if there is none."""
    source = B.Memory(image)
    _, records, _ = B.build_index(source)
    r = next((r for r, _ in records if r.id == record_id), None)
    if r is None:
        raise PackageError("RecordMissing", id=record_id)
    fields, seen = list(B.fields_of(source.read(r.payload_offset, r.size))), 0
    for i, (sig, _) in enumerate(fields):
        if sig == signature:
            if seen == n:
                fields[i] = (sig, payload)
                break
            seen += 1
    else:
        raise PackageError("SubrecordMissing", signature=signature)
    return edit_package(image, [Mutation(REPLACE, record_id, B.encode_fields(fields))])[0]


def edit_packages(packages: DataFrame, mutations: DataFrame) -> DataFrame:
    """packages (path, content) after mutations (path, ord, kind, record_id, payload, signature, group_offset, flags, version).

    Mutations are gathered by package, whose file is one artefact; packages are edited side by side.
    """

    @F.udf("binary", useArrow=True)
    def run(content, batch):
        ms = [Mutation(m["kind"], m["record_id"], bytes(m["payload"] or b""), bytes(m["signature"] or b""), m["group_offset"], m["flags"] or 0, 1.0 if m["version"] is None else m["version"]) for m in batch or ()]
        return edit_package(bytes(content), ms)[0]

    names = ["ord", "kind", "record_id", "payload", "signature", "group_offset", "flags", "version"]
    batches = mutations.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("batch"))
    return packages.join(batches, "path").withColumn("content", run("content", "batch")).drop("batch")


def show(records: DataFrame) -> DataFrame:
    """Records with readable ids and signatures."""
    return records.withColumns({"record_id": K.show_id("record_id"), "signature": K.show_signature("signature")})
