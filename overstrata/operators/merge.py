"""Merge of a source package into a destination: a keyed upsert of records, and the placing of entries in a file.

The record part is a DataFrame pipeline: selection, id allocation, rewriting of references, full-outer upsert, digests and
the log of operations. The file part (``merge_package``) works on one pair of packages inside one task, as a file is one
ordered artefact; many pairs run side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import codec as B
from .. import model as M
from ..functions import columns as K
from ..model import PackageError
from .compose import APPEND, APPEND_LIST, KEEP, REPLACE, Rule
from .graph import closure

# --- records as DataFrames ------------------------------------------------------------------------


def select_records(records: DataFrame, record: int | None = None, descendants: bool = False) -> DataFrame:
    """(record_id) selected: all, one, or one with what lies below its groups, each with all its ancestors.

    Ancestors are the records that label the groups of a path; a missing one is an error row (parent_missing).
    """
    ids = records.select("record_id")
    if record is not None:
        own = records.filter(F.col("record_id") == record)
        if descendants:
            own = own.union(records.filter(F.exists("path", lambda g: g["group_type"].isin(*M.RECORD_LABELLED) & (K.label_id(g["label"]) == record))))
        steps = records.select("record_id", F.explode("path").alias("g")).filter(F.col("g.group_type").isin(*M.RECORD_LABELLED))
        edges = steps.select(F.col("record_id").alias("a"), K.label_id("g.label").alias("b")).distinct()
        ids = closure(edges, own.select(F.col("record_id").alias("node"))).withColumnRenamed("node", "record_id")
    found = records.select("record_id", F.lit(True).alias("_here"))
    return ids.join(found, "record_id", "left").select("record_id", F.col("_here").isNull().alias("parent_missing")).distinct()


def allocate_ids(records: DataFrame, next_local: int, owned_index: int, order: str = "record_ord", id_column: str = "record_id", own: F.Column | None = None) -> DataFrame:
    """(record_id, new_id) of owned records: next_local and up in source order.

    Numbers come from counts of ranges of the order and a window in each, so no task sees all rows.
    """
    rows = records if own is None else records.filter(own)
    numbered = dense_number(rows.select(id_column, order), order)
    return numbered.select(F.col(id_column).alias("record_id"), K.record_id(F.lit(owned_index), F.col("_n") + next_local).alias("new_id"))


def range_width(rows: DataFrame, order: str, most: int) -> int:
    """How far ``most`` rows reach in a long order on average."""
    low, high, n = rows.agg(F.min(order), F.max(order), F.count("*")).first()
    return most if not n or low is None else max(most, -(-(high - low + 1) * most // n))


def dense_number(rows: DataFrame, order: str, part: Sequence[str] = (), width: int = 1 << 16, out: str = "_n") -> DataFrame:
    """rows with _n: 0, 1, ... by a long column without repeats, anew in each part.

    Counts of ranges of the order come first, and a window works inside each range: no task sees all rows of a part.
    Ranges are as wide as ``width`` rows take on average, so sparse orders don't make more of them.
    """
    width = range_width(rows, order, width)
    ranged = rows.withColumn("_b", F.floor(F.col(order) / width))
    sizes = ranged.groupBy(*part, "_b").agg(F.count("*").alias("_c"))
    base = sizes.select(*part, "_b", (F.sum("_c").over(W.partitionBy(*part).orderBy("_b")) - F.col("_c")).alias("_base"))
    number = F.col("_base") + F.row_number().over(W.partitionBy(*part, "_b").orderBy(order)) - 1
    return ranged.join(base, [*part, "_b"]).withColumn(out, number).drop("_b", "_base")


def rewrite_references(fields: DataFrame, id_map: DataFrame, references: Sequence[tuple[str, str]]) -> DataFrame:
    """Subrecords (record_signature, signature, payload, ...) with ids in the named reference fields mapped.

    id_map: (record_id, new_id), for owned records and for dependencies alike. An unmapped id is an error.
    """
    is_ref = F.lit(False)
    for rec, sub in references:
        is_ref = is_ref | ((F.col("record_signature") == F.lit(rec.encode())) & (F.col("signature") == F.lit(sub.encode())))
    keyed = fields.withColumn("_old", F.when(is_ref, K.from_le("payload")))
    out = keyed.join(id_map.select(F.col("record_id").alias("_old"), F.col("new_id").alias("_new")), "_old", "left")
    lost = F.col("_old").isNotNull() & F.col("_new").isNull()
    bad = F.raise_error(F.concat(F.lit("UnmappedSourceRecord: "), K.show_id("_old"))).cast("binary")
    return out.withColumn("payload", F.when(lost, bad).when(F.col("_old").isNotNull(), K.le32("_new")).otherwise(F.col("payload"))).drop("_old", "_new")


def upsert(dst: DataFrame, src: DataFrame, key: str, columns: Sequence[str], deleted: F.Column | None = None, include_overrides: bool = True, composed: dict[str, F.Column] | None = None) -> DataFrame:
    """Rows of both with ``op``: keep, add, override or delete. Values of added and overridden rows are the source's,
    or ``composed`` (expressions over d_* and s_*). A delete without a target is an error; with include_overrides=False
    only new keys act.
    """
    s = src.select(F.col(key), *[F.col(x).alias(f"s_{x}") for x in columns], (deleted if deleted is not None else F.lit(False)).alias("_deleted"), F.lit(True).alias("_s"))
    d = dst.select(F.col(key), *[F.col(x).alias(f"d_{x}") for x in columns], F.lit(True).alias("_d"))
    both = d.join(s, key, "full_outer")
    here, there = F.col("_d").isNotNull(), F.col("_s").isNotNull()
    missing = F.raise_error(F.concat(F.lit("DeleteTargetMissing: "), F.col(key).cast("string")))
    act = there if include_overrides else there & ~here
    op = F.when(act & F.col("_deleted") & ~here, missing).when(act & F.col("_deleted"), "delete").when(act & here, "override").when(act, "add").otherwise("keep")
    taken = F.col("op").isin("add", "override")
    value = lambda x: F.when(taken & (F.col("op") == "override"), composed[x]).when(taken, F.col(f"s_{x}")) if composed and x in composed else F.when(taken, F.col(f"s_{x}"))
    return both.withColumn("op", op).select(key, "op", *[value(x).otherwise(F.col(f"d_{x}")).alias(x) for x in columns])


def operation_log(rows: DataFrame, order: str) -> DataFrame:
    """(n, op, record_id, previous, digest) of acted rows, in source order."""
    return dense_number(rows.filter(F.col("op") != "keep"), order).select(F.col("_n").alias("n"), "op", "record_id", "previous", "digest")


# --- packages as files ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Selection:
    record: int | None = None
    descendants: bool = False


@dataclass(frozen=True)
class Options:
    selection: Selection = Selection()
    include_overrides: bool = True
    rules: tuple[Rule, ...] | None = None  # None: overrides replace the whole record


@dataclass
class Logical:
    """A decoded record."""

    signature: bytes
    flags: int
    id: int
    version_raw: bytes
    last_change_set: bytes
    fields: list[tuple[bytes, bytes]] = field(default_factory=list)

    @classmethod
    def read(cls, source: B.Memory, r: B.Record) -> Logical:
        return cls(r.signature, r.flags, r.id, r.version_raw, r.last_change_set, list(B.fields_of(source.read(r.payload_offset, r.size))))

    def encode(self) -> bytes:
        return B.record(self.signature, self.fields, self.id, self.flags, self.version_raw, self.last_change_set)

    def digest(self) -> bytes:
        return B.record_digest(self.signature, B.encode_fields(self.fields), self.id, self.flags, self.version_raw)


class Rewriter:
    """The caller's hook for ids inside payloads and labels. The plain one changes nothing."""

    def field(self, record: bytes, sub: bytes, payload: bytes, ids: Callable[[int], int]) -> bytes:
        return payload

    def label_is_id(self, kind: int) -> bool:
        return kind in M.RECORD_LABELLED


class ReferenceRewriter(Rewriter):
    """Maps the fields that a schema names as references."""

    def __init__(self, references: Sequence[tuple[str, str]]):
        self.references = {(a.encode(), b.encode()) for a, b in references}

    def field(self, record: bytes, sub: bytes, payload: bytes, ids: Callable[[int], int]) -> bytes:
        return M.label_from_id(ids(M.label_id(payload))) if (record, sub) in self.references else payload


def compose(dst: Logical, src: Logical, rules: Sequence[Rule]) -> Logical:
    """Composition of two decoded records; their signatures may differ here."""
    out = list(dst.fields)
    for r in rules:
        sig = r.signature if isinstance(r.signature, bytes) else r.signature.encode()
        mine, theirs = [f for f in out if f[0] == sig], [f for f in src.fields if f[0] == sig]
        if r.strategy == KEEP:
            continue
        if r.strategy == REPLACE:
            at = next((i for i, f in enumerate(out) if f[0] == sig), len(out))
            out = out[:at] + theirs + [f for f in out[at:] if f[0] != sig]
        elif r.strategy == APPEND:
            for f in theirs:
                if not (r.deduplicate and f in out):
                    out.append(f)
        elif r.strategy == APPEND_LIST:
            if len(mine) > 1 or len(theirs) > 1:
                raise PackageError("ListSubrecordMultiplicity", signature=sig)
            if theirs and not mine:
                out.append(theirs[0])
            elif theirs:
                out = [(sig, B.append_list(f[1], theirs[0][1], r.mode)) if f[0] == sig else f for f in out]
    return Logical(dst.signature, src.flags, dst.id, src.version_raw, src.last_change_set, out)


def compose_override(dst: Logical, src: Logical, rules: Sequence[Rule]) -> bytes:
    if dst.signature != src.signature:
        raise PackageError("OverrideSignatureMismatch")
    return compose(dst, src, rules).encode()


def compose_chain(chain: Sequence[Logical], rules: Sequence[Rule]) -> bytes:
    if not chain:
        raise PackageError("EmptyOverrideChain")
    now = chain[0]
    for r in chain[1:]:
        if r.signature != now.signature:
            raise PackageError("OverrideSignatureMismatch")
        now = compose(now, r, rules)
    return now.encode()


@dataclass
class Node:
    """A group of an ordered tree; a record is its id alone."""

    label: bytes
    kind: int
    children: list = field(default_factory=list)


def read_tree(source: B.Memory, start: int, end: int) -> list:
    return [e.id if isinstance(e, B.Record) else Node(e.label, e.type, read_tree(source, e.payload_offset, e.end)) for e in B.entries(source, start, end)]


def graft(into: list, what: list) -> None:
    """Groups meet the first sibling of their label and type and go on inside; all else is appended."""
    for e in what:
        twin = next((x for x in into if isinstance(x, Node) and isinstance(e, Node) and (x.label, x.kind) == (e.label, e.kind)), None)
        if twin is None:
            into.append(e)
        else:
            graft(twin.children, e.children)


def prune(tree: list, gone: set[int]) -> list:
    """Without some records; groups stay, even if empty."""
    return [Node(e.label, e.kind, prune(e.children, gone)) if isinstance(e, Node) else e for e in tree if isinstance(e, Node) or e not in gone]


def encode_tree(tree: list, records: dict[int, bytes]) -> bytes:
    return b"".join(B.group(e.label, e.kind, [encode_tree(e.children, records)]) if isinstance(e, Node) else records[e] for e in tree)


def merge_package(dst: bytes, src: bytes, *, author: str, message: str, timestamp: int, parents: Sequence[bytes] = (), rewriter: Rewriter | None = None, options: Options = Options()) -> tuple[bytes, B.ChangeSet, dict[int, int]]:
    """(the merged package, its change set, new ids of injected records)."""
    rewriter = rewriter or Rewriter()
    d_source, s_source = B.Memory(dst), B.Memory(src)
    d, d_records, _ = B.build_index(d_source)
    s, s_records, _ = B.build_index(s_source)
    place = {r.package_id: i for i, r in enumerate(d.header.dependencies)}
    own_d, own_s = len(d.header.dependencies), len(s.header.dependencies)
    if d.header.package_id not in {r.package_id for r in s.header.dependencies}:
        raise PackageError("SourceDoesNotDependOnDestination")
    place[d.header.package_id] = own_d
    if lost := [r for r in s.header.dependencies if r.package_id not in place]:
        raise PackageError("DependencyUnavailableInDestination", package=lost[0].package_id.hex())
    to_index = [place[r.package_id] for r in s.header.dependencies]
    # Selection, with every record that labels a group above.
    paths = {r.id: [M.label_id(g.label) for g in path if rewriter.label_is_id(g.type)] for r, path in s_records}
    chosen = set(paths)
    if options.selection.record is not None:
        root = options.selection.record
        if root not in paths:
            raise PackageError("SelectedRecordMissing", id=root)
        chosen = {root} | ({i for i, p in paths.items() if root in p} if options.selection.descendants else set())
        todo = list(chosen)
        while todo:
            for parent in paths[todo.pop()]:
                if parent not in paths:
                    raise PackageError("SelectedParentMissing", id=parent)
                if parent not in chosen:
                    chosen.add(parent)
                    todo.append(parent)
    next_local, injected = d.header.next_local, {}
    for r, _ in s_records:
        if r.id in chosen and r.id >> 24 == own_s:
            if next_local >= M.MAX_LOCAL:  # the next id would not fit
                raise PackageError("RecordIdCapacityExhausted")
            injected[r.id] = M.record_id(own_d, next_local)
            next_local += 1

    def ids(i: int) -> int:
        at, local = M.split_id(i)
        if at == own_s:
            if i not in injected:
                raise PackageError("UnmappedSourceRecord", id=f"{i:08X}")
            return injected[i]
        if at > own_s:
            raise PackageError("InvalidSourceReference", id=f"{i:08X}")
        return M.record_id(to_index[at], local)

    now = {r.id: Logical.read(d_source, r) for r, _ in d_records}
    tree = read_tree(d_source, d.content_offset, d_source.size)
    log, acted, deleted = [], {}, set()
    for r, _ in s_records:
        new = r.id >> 24 == own_s
        if r.id not in chosen or not (new or options.include_overrides):
            continue
        if not new and to_index[r.id >> 24] != own_d:
            raise PackageError("OverrideTargetsAnotherDependency", id=f"{r.id:08X}")
        target, mine = ids(r.id), Logical.read(s_source, r)
        old = now.get(target)
        if mine.flags & M.DELETED:
            if old is None:
                raise PackageError("DeleteTargetMissing", id=f"{target:08X}")
            del now[target]
            deleted.add(target)
            log.append(B.Operation(B.DELETE, target, previous=old.last_change_set))
            continue
        mine.fields = [(sub, rewriter.field(mine.signature, sub, body, ids)) for sub, body in mine.fields]
        if not new and old is None:
            raise PackageError("OverrideTargetMissing", id=f"{target:08X}")
        if not new and options.rules is not None:
            mine = compose(old, mine, options.rules)
        mine.id = target
        log.append(B.Operation(B.ADD, target, digest=mine.digest()) if new else B.Operation(B.OVERRIDE, target, previous=old.last_change_set, digest=mine.digest()))
        now[target], acted[r.id] = mine, target

    def translated(entries: list) -> list:
        out = []
        for e in entries:
            if not isinstance(e, Node):
                out += [acted[e]] if e in acted else []
            elif inner := translated(e.children):
                out.append(Node(M.label_from_id(ids(M.label_id(e.label))) if rewriter.label_is_id(e.kind) else e.label, e.kind, inner))
        return out

    tree = prune(tree, set(acted.values()) | deleted)
    graft(tree, translated(read_tree(s_source, s.content_offset, s_source.size)))
    change = B.ChangeSet.create(parents, d.header.package_id, s.header.package_id, author, message, timestamp, log)
    for op in log:
        if op.record_id in now:
            now[op.record_id].last_change_set = change.id
    head = d.header.with_(next_local=next_local, record_count=len(now), owned_record_count=sum(i >> 24 == own_d for i in now), scene_tables=())
    body = encode_tree(tree, {i: r.encode() for i, r in now.items()})
    # Ranges of the old file would be stale, so they are built again.
    from .ranges import rebuild_image

    image = head.encode(change.id) + body
    return (rebuild_image(image) if d.header.scene_tables else image), change, injected


def merge_packages(pairs: DataFrame, **request) -> DataFrame:
    """pairs (key, destination, source: package bytes) with merged bytes, change set id and history entry; a task for each pair."""

    @F.udf("struct<package:binary,change_set:binary,n_operations:int,injected:map<long,long>>", useArrow=True)
    def run(dst, src):
        image, change, injected = merge_package(bytes(dst), bytes(src), **request)
        return {"package": image, "change_set": change.id, "n_operations": len(change.operations), "injected": injected}

    return pairs.withColumn("merged", run("destination", "source"))
