"""Packages as a Spark data source.

    spark.dataSource.register(PackageDataSource)
    spark.read.format("overstrata").option("table", "records").load("/data/*.pcp")

Options: table (packages, dependencies, incompatibilities, streaming_overrides, scene_offsets, groups, records,
subrecords), payload (true; false leaves payloads unread), split_bytes (32 MB: top-level entries are dealt to partitions
of about this size), start and end (a byte range of entries), skip_group_types (a list: such groups are jumped over).
Packages get their package_index from the order of ``paths``, a list separated by commas, or of a sorted glob.

``columns`` (a list) leaves the other columns out, and payloads unread if theirs is not among them. With ``pushdown``
(false) filters on signature, record_id and header_offset are pushed down: what they exclude is passed over by its header,
its payload unread. Spark 4.1 keeps what was pushed into a source with it, so such a DataFrame is for one set of filters.

Metadata tables read only each file's header. Files up to the split size are planned by their sizes alone; larger ones by
walking top-level headers, 16 or 52 bytes each, and a top-level group beyond the split size is opened up one level.
"""

from __future__ import annotations

import glob
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import codec as B
from .. import model as M

SCHEMAS = {
    "packages": M.PACKAGES,
    "dependencies": M.RELATIONS,
    "incompatibilities": M.RELATIONS,
    "streaming_overrides": M.STREAMING_OVERRIDES,
    "scene_offsets": M.SCENE_OFFSETS,
    "groups": M.GROUPS,
    "records": M.RECORDS,
    "subrecords": M.SUBRECORDS,
}
ROWS_PER_BATCH = 4096
BATCH_BYTES = 16 << 20


def _fields(schema: str) -> list[str]:
    """The fields of a schema's text, split at its outer commas."""
    out, depth, at = [], 0, 0
    for i, ch in enumerate(schema):
        depth += {"<": 1, ">": -1}.get(ch, 0)
        if ch == "," and not depth:
            out.append(schema[at:i].strip())
            at = i + 1
    return [*out, schema[at:].strip()] if schema else []


def files(path: str) -> list[str]:
    """Paths in their order; a folder stands for its packages by name, a local glob for what it finds, sorted."""
    import pyarrow.fs as pafs

    out = []
    for part in path.split(","):
        if "://" not in part and any(c in part for c in "*?["):
            out += sorted(glob.glob(part))
            continue
        fs, at = B.file_system(part)
        if fs.get_file_info(at).type == pafs.FileType.Directory:
            found = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(at)) if f.path.endswith((f".{M.PACKAGE_EXTENSION}", f".{M.SAVE_EXTENSION}")))
            scheme = part.partition("://")[0] + "://" if "://" in part else ""
            out += [scheme + x for x in found]
        else:
            out.append(part)
    return out


def header_rows(table: str, i: int, path: str, p: B.Opened) -> list[tuple]:
    h = p.header
    if table == "packages":
        return [(i, path, h.package_id, M.FORMAT_VERSION, h.load_class, h.next_local, h.record_count, h.owned_record_count, h.author, h.description, h.schema_namespace, h.version, p.source.size, p.content_offset, p.record.last_change_set)]
    if table in ("dependencies", "incompatibilities"):
        return [(i, n, r.package_id, r.name, r.requirement) for n, r in enumerate(getattr(h, table))]
    if table == "streaming_overrides":
        return [(i, n, rid) for n, rid in enumerate(h.streaming_overrides)]
    return [(i, k, t.world_id, n, o.scene_id, o.start, o.end) for k, t in enumerate(h.scene_tables) for n, o in enumerate(t.offsets)]


class Part(InputPartition):
    """A run of entries of one file: side by side below ``path``, whose groups are (offset, label, type, size)."""

    def __init__(self, index: int, file: str, start: int, end: int, path: tuple = ()):
        self.index, self.file, self.start, self.end, self.path = index, file, start, end, path


class PackageReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.table = options.get("table", "records")
        self.names, self.schema = schema.names, to_arrow_schema(schema)
        self.all = [x.split()[0] for x in _fields(SCHEMAS.get(self.table, ""))]
        self.tests: list[tuple[str, type, object]] = []
        if self.table not in SCHEMAS:
            raise M.PackageError("UnknownTable", table=self.table)
        self.files = files(options.get("path") or options["paths"])
        self.payload = options.get("payload", "true").lower() == "true" and "payload" in self.names
        self.split = int(options.get("split_bytes", 32 << 20))
        self.start, self.end = (int(options[k]) if k in options else None for k in ("start", "end"))
        self.skip = {int(x) for x in options.get("skip_group_types", "").split(",") if x.strip()}

    def _wanted(self, r: B.Record) -> bool:
        for name, kind, value in self.tests:
            x = {"signature": r.signature, "record_id": r.id}.get(name, r.offset)
            if kind is In:
                ok = any(x == (bytes(v) if isinstance(v, bytearray) else v) for v in value)
            else:
                value = bytes(value) if isinstance(value, bytearray) else value
                ok = {EqualTo: x == value}.get(kind) if kind is EqualTo else {GreaterThan: x > value, GreaterThanOrEqual: x >= value, LessThan: x < value, LessThanOrEqual: x <= value}[kind]
            if not ok:
                return False
        return True

    def _keep(self, g: B.Group, _: tuple) -> bool:
        return g.type not in self.skip

    def partitions(self) -> list[Part]:
        if self.table in ("packages", "dependencies", "incompatibilities", "streaming_overrides", "scene_offsets"):
            return [Part(i, f, 0, 0) for i, f in enumerate(self.files)] or [Part(-1, "", 0, 0)]
        out = []
        for i, f in enumerate(self.files):
            if self.start is None and self.end is None:
                fs, at = B.file_system(f)
                if fs.get_file_info(at).size <= self.split:
                    out.append(Part(i, f, None, None))
                    continue
            source = B.File(f)
            p = B.open_package(source)
            start, end = self.start if self.start is not None else p.content_offset, self.end if self.end is not None else source.size
            self._deal(out, i, f, source, start, end, ())
        return out or [Part(-1, "", 0, 0)]

    def _deal(self, out: list, i: int, f: str, source: B.File, start: int, end: int, path: tuple) -> None:
        low = start
        for e in B.entries(source, start, end):
            big = isinstance(e, B.Group) and e.size > self.split and e.type not in self.skip
            if (e.end - low > self.split or big) and e.offset > low:
                out.append(Part(i, f, low, e.offset, path))
                low = e.offset
            if big:
                # The group's own row comes from an empty run, its entries from runs of their own.
                out.append(Part(i, f, e.offset, e.offset, path))
                self._deal(out, i, f, source, e.payload_offset, e.end, (*path, (e.offset, e.label, e.type, e.size)))
                low = e.end
        if end > low:
            out.append(Part(i, f, low, end, path))

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.index < 0:
            return
        source = B.File(part.file)
        if part.start is None:
            part = Part(part.index, part.file, B.open_package(source).content_offset if self.table in ("groups", "records", "subrecords") else 0, source.size)
        rows, size = [], 0
        for row in self._rows(part, source):
            rows.append(row)
            size += sum(len(x) for x in row if isinstance(x, bytes))
            if len(rows) == ROWS_PER_BATCH or size >= BATCH_BYTES:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        at = {n: i for i, n in enumerate(self.all)}
        columns = []
        for f in self.schema:
            values = [r[at[f.name]] for r in rows]
            if pa.types.is_list(f.type):  # paths: tuples become structs
                names = [x.name for x in f.type.value_type]
                values = [[dict(zip(names, x, strict=True)) for x in v] for v in values]
            columns.append(pa.array(values, f.type))
        return pa.RecordBatch.from_arrays(columns, schema=self.schema)

    def _rows(self, part: Part, source: B.File) -> Iterator[tuple]:
        if self.table not in ("groups", "records", "subrecords"):
            yield from header_rows(self.table, part.index, part.file, B.open_package(source))
            return
        above = tuple(B.Group(size, label, kind, offset) for offset, label, kind, size in part.path)
        if part.start == part.end:
            if self.table == "groups":
                yield self._group(part.index, B.decode_group_header(source.read(part.start, 16), part.start), above)
            return
        for e, path in B.walk(source, part.start, part.end, above, self._keep):
            if isinstance(e, B.Group):
                if self.table == "groups":
                    yield self._group(part.index, e, path)
                continue
            if self.table == "groups":
                continue
            if self.tests and not self._wanted(e):
                continue
            body = source.read(e.payload_offset, e.size) if self.payload or self.table == "subrecords" else None
            if self.table == "subrecords":
                seen: dict[bytes, int] = {}
                for n, (sig, payload) in enumerate(B.fields_of(body)):
                    yield (part.index, e.id, e.offset, n, seen.get(sig, 0), sig, payload)
                    seen[sig] = seen.get(sig, 0) + 1
            else:
                yield (part.index, e.offset, e.offset, e.offset, e.payload_offset, e.signature, e.flags, e.id, e.version, e.version_raw, e.last_change_set, body, path[-1].offset if path else None, [(g.offset, g.label, g.type) for g in path])

    @staticmethod
    def _group(i: int, g: B.Group, path: tuple) -> tuple:
        return (i, g.offset, len(path), g.offset, g.payload_offset, g.end, g.size, g.label, g.type, path[-1].offset if path else None, [(x.offset, x.label, x.type) for x in path])


class PushingReader(PackageReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what a record's header decides; the rest stays Spark's."""
        usable = {"records": {"signature", "record_id", "header_offset", "record_ord"}, "subrecords": {"record_id", "record_ord"}}.get(self.table, set())
        for f in filters:
            if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1 and f.attribute[0] in usable:
                self.tests.append((f.attribute[0], type(f), f.value))
            elif isinstance(f, IsNotNull) and len(f.attribute) == 1 and f.attribute[0] in usable:
                continue  # headers have no nulls
            else:
                yield f


class PackageDataSource(DataSource):
    """Orders (record_ord, pre_order) are header offsets: unique in a file and in its order, without a numbering pass."""

    @classmethod
    def name(cls) -> str:
        return "overstrata"

    def schema(self) -> str:
        table = self.options.get("table", "records")
        if table not in SCHEMAS:
            raise M.PackageError("UnknownTable", table=table)
        wanted = [x.strip() for x in self.options.get("columns", "").split(",") if x.strip()]
        fields = {f.split()[0]: f for f in _fields(SCHEMAS[table])}
        if unknown := [x for x in wanted if x not in fields]:
            raise M.PackageError("UnknownColumn", column=unknown[0])
        return ", ".join(fields[x] for x in wanted or fields)

    def reader(self, schema: StructType) -> DataSourceReader:
        pushing = self.options.get("pushdown", "false").lower() == "true"
        return (PushingReader if pushing else PackageReader)(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool):
        from .package_sink import PackageWriter

        return PackageWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PackageDataSource)


def read(spark: SparkSession, path: str | list[str], table: str = "records", **options) -> DataFrame:
    register(spark)
    if options.get("pushdown"):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    path = ",".join(path) if isinstance(path, list) else path
    return spark.read.format("overstrata").option("table", table).options(**{k: str(v) for k, v in options.items()}).load(path)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of whole packages, for operators on images; reads through any file system Spark knows."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def subrecords(records: DataFrame) -> DataFrame:
    """The subrecords of records, from their payloads: whole batches in and out."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ords, signatures, payloads = [], [], [], []
            for i, body in enumerate(batch.column("payload")):
                for n, (sig, payload) in enumerate(B.fields_of(body.as_py()) if body.is_valid else ()):
                    rows.append(i)
                    ords.append(n)
                    signatures.append(sig)
                    payloads.append(payload)
            take = pa.array(rows, pa.int64())
            columns = [batch.column(c).take(take) for c in ("package_index", "record_id", "record_ord")]
            columns += [pa.array(ords, pa.int32()), pa.array(signatures, pa.binary()), pa.array(payloads, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["package_index", "record_id", "record_ord", "ord", "signature", "payload"])

    kinds = {f.name: f.dataType.simpleString() for f in records.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("package_index", "record_id", "record_ord"))
    return records.select("package_index", "record_id", "record_ord", "payload").mapInArrow(split, f"{schema}, ord int, signature binary, payload binary")
