"""WARC archives: writing, normalising monolithic gzip files, and reading through an offset index.

``write`` makes archives as crawlers leave them: each file is one gzip stream of many records. ``normalise`` inflates
such a stream once, rewrites every record as a gzip member of its own, turns repeated payloads into revisit
records, and writes a sidecar index (record number, offset, length) by which ``read`` reaches single members.

Of records with equal payloads of at least ``least`` bytes the one of the largest page_id is the response. Archives
lie in the shared folder under names that no other attempt of a task uses; the table of a stage names the files of the
attempts that counted, so repeated tasks and lost executors do no harm.

Defined cases: a null html is an empty payload; a null page_id is less than any other; of repeated rows the last
of the last file is the response; line ends in a url are written as blanks; a record is held whole, however long, and
its archive is inflated in chunks; an empty table makes no archive and gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

LEVEL = 3
#: Bytes of records after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, file: str, number: int) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}:{file}:{number}>"


def _head(fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


def _http(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def response(page_id: int | None, url: str | None, payload: bytes, file: str, number: int) -> bytes:
    block = _http(len(payload)) + payload
    uri = [("WARC-Target-URI", re.sub(r"[\r\n]+", " ", url))] if url else []
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", record_id(page_id, file, number)), ("WARC-Date", DATE), *uri]
    fields += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _head(fields) + block + b"\r\n\r\n"


def revisit(fields: dict[str, str], block: bytes, refers: str) -> bytes:
    """The record without its payload, and with what it repeats."""
    http = block[: block.index(b"\r\n\r\n") + 4]
    out = [(k, "revisit" if k == "WARC-Type" else v) for k, v in fields.items() if k != "Content-Length"]
    return _head([*out, ("WARC-Refers-To", refers), ("WARC-Profile", PROFILE), ("Content-Length", str(len(http)))]) + http + b"\r\n\r\n"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def write(pages: DataFrame, folder: str) -> DataFrame:
    """(file, number, page_id, digest, n_bytes) of the records written, one gzip stream an archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        fs.create_dir(root)
        out = press = file = None
        size = number = 0
        for batch in batches:
            rows = []
            for page_id, url, html in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html"), strict=True):
                if out is None:
                    file, size, number = uuid.uuid4().hex, 0, 0
                    out, press = fs.open_output_stream(f"{root}/{file}.warc.gz", compression=None), zlib.compressobj(LEVEL, wbits=31)
                payload = (html.as_py() or "").encode()
                record = response(page_id, url, payload, file, number)
                out.write(press.compress(record))
                rows.append((file, number, page_id, digest(payload), len(payload)))
                number, size = number + 1, size + len(record)
                if size >= ARCHIVE_BYTES:
                    out.write(press.flush())
                    out.close()
                    out = None
            yield _rows(rows, ["file", "number", "page_id", "digest", "n_bytes"], [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()])
        if out is not None:
            out.write(press.flush())
            out.close()

    return pages.select("page_id", "url", "html").mapInArrow(run, "file string, number long, page_id long, digest string, n_bytes long")


def _rows(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def inflate(stream) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, read once, at most ``CHUNK`` at a time whatever it expands to."""
    d = zlib.decompressobj(47)
    while data := stream.read(CHUNK):
        while data:
            yield d.decompress(data, CHUNK)
            data = d.unused_data if d.eof else d.unconsumed_tail
            if d.eof:
                d = zlib.decompressobj(47)
    yield d.flush()


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(fields, block, the whole record) of each record of a stream."""
    held, at = bytearray(), 0

    def fill(n: int) -> bool:
        nonlocal at
        while len(held) - at < n:
            part = next(chunks, None)
            if part is None:
                return False
            if at > CHUNK:
                del held[:at]
                at = 0
            held.extend(part)
        return True

    while fill(1):
        end, seen = -1, 0
        while (end := held.find(b"\r\n\r\n", at + max(0, seen - 3))) < 0:
            seen = len(held) - at
            if not fill(seen + 1):
                raise ValueError("the archive ends within a record's head")
        lines = bytes(held[at:end]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:40]}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        head, n = end + 4 - at, int(fields["Content-Length"])
        if not fill(head + n + 4):
            raise ValueError("the archive ends within a record")
        yield fields, bytes(held[at + head : at + head + n]), bytes(held[at : at + head + n + 4])
        at += head + n + 4


def normalise(plan: DataFrame, source: str, folder: str, files: int) -> DataFrame:
    """(archive) of each rewritten archive. plan: (file, number, refers); number is null on one row of each file, else the record repeats ``refers``.

    There are as many tasks as ``files``: rows of the plan are few and small, their archives are not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        fs.create_dir(root)
        come, come_root = _open(source)
        for t, at in C.whole_groups(batches, "file_key"):
            rows = []
            by_file: dict[str, dict[int, str]] = {}
            for file, number, refers in zip(t["file"].to_pylist(), t["number"].to_pylist(), t["refers"].to_pylist(), strict=True):
                by_file.setdefault(file, {})
                if number is not None:
                    by_file[file][number] = refers
            for file, repeats in by_file.items():
                name, offset, lines = f"{root}/{uuid.uuid4().hex}", 0, []
                with come.open_input_stream(f"{come_root}/{file}.warc.gz", compression=None) as stream, fs.open_output_stream(f"{name}.warc.gz", compression=None) as out:
                    for number, (fields, block, whole) in enumerate(records(inflate(stream))):
                        if number in repeats:
                            whole = revisit(fields, block, repeats[number])
                        press = zlib.compressobj(LEVEL, wbits=31)
                        member = press.compress(whole) + press.flush()
                        out.write(member)
                        lines.append(f"{number}\t{offset}\t{len(member)}\n")
                        offset += len(member)
                with fs.open_output_stream(f"{name}.idx", compression=None) as out:
                    out.write("".join(lines).encode())
                rows.append((name.rpartition("/")[2],))
            yield _rows(rows, ["archive"], [pa.string()])

    keyed = plan.withColumn("file_key", F.xxhash64("file"))
    return keyed.repartition(max(1, files), "file_key").sortWithinPartitions("file_key", "number").mapInArrow(run, "archive string")


def read(archives: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, through the indexes."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def page(urn: str | None) -> int | None:
        part = urn.split(":")[2] if urn else "null"
        return None if part == "null" else int(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                with fs.open_input_stream(f"{root}/{archive}.idx", compression=None) as f:
                    index = [tuple(map(int, x.split("\t"))) for x in f.read().decode().splitlines()]
                rows = []
                with fs.open_input_file(f"{root}/{archive}.warc.gz") as f:
                    for _, offset, length in index:
                        f.seek(offset)
                        ((fields, block, _),) = records(iter([zlib.decompress(f.read(length), 31)]))
                        n, sha = int(fields["WARC-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if fields["WARC-Type"] == "response":
                            payload = block[block.index(b"\r\n\r\n") + 4 :]
                            n = len(payload)
                            if digest(payload) != sha:
                                raise ValueError(f"{archive}, offset {offset}: the payload isn't that of its digest")
                        rows.append((page(fields["WARC-Record-ID"]), n, sha, fields["WARC-Type"], page(fields.get("WARC-Refers-To"))))
                        if len(rows) == 5000:
                            yield _rows(rows, names, kinds)
                            rows = []
                yield _rows(rows, names, kinds)

    n = max(1, archives.count())
    return archives.repartition(n, "archive").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(spark: SparkSession, pages: DataFrame, least: int = 0, folder: str | None = None) -> DataFrame:
    """Write pages, normalise the archives and read them back. The normalised archives stay in ``folder``."""
    C.bounded_batches(pages)
    folder = folder or f"{C.shared_dir(spark)}/overstrata-warc-{uuid.uuid4().hex[:12]}"
    C.keep_until_exit(spark, folder)
    listing = C.Table(write(pages, f"{folder}/raw"), "records").df
    keepers = listing.filter(F.col("n_bytes") >= least).groupBy("digest").agg(F.max(F.struct("page_id", "file", "number")).alias("keeper"), F.count("*").alias("n")).filter("n > 1")
    keepers = C.Table(keepers, "keepers").df
    repeats = listing.join(keepers, "digest").filter("not (file = keeper.file and number = keeper.number)")
    refers = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("keeper.page_id").cast("string"), F.lit("null")), F.lit(":"), F.col("keeper.file"), F.lit(":"), F.col("keeper.number"), F.lit(">"))
    files = C.Table(listing.select("file").distinct(), "files").df
    plan = repeats.select("file", "number", refers.alias("refers")).union(files.select("file", F.lit(None).cast("long"), F.lit(None).cast("string")))
    archives = C.Table(normalise(plan, f"{folder}/raw", f"{folder}/archives", files.count()), "archives").df
    C.delete(spark, f"{folder}/raw")
    return read(archives, f"{folder}/archives")
