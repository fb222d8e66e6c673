"""Writing packages: encoding of ordered entries, and files that are replaced as a whole or not at all."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceWriter, WriterCommitMessage

from .. import codec as B
from .. import model as M


def write_atomically(path: str, image: bytes) -> None:
    """A new file beside the target is flushed, opened and indexed; only then it takes the target's name."""
    folder, name = os.path.split(os.path.abspath(path))
    pending = os.path.join(folder, f".{name}.{os.getpid()}.{os.urandom(4).hex()}.pending")
    try:
        with open(pending, "xb") as f:
            f.write(image)
            f.flush()
            os.fsync(f.fileno())
        B.build_index(B.File(pending))
        os.replace(pending, path)
        handle = os.open(folder, os.O_RDONLY)
        try:
            os.fsync(handle)
        finally:
            os.close(handle)
    finally:
        if os.path.exists(pending):
            os.unlink(pending)


def create_package(path: str, package_id: bytes, schema_namespace: str = "", version: str = "0.1.0") -> None:
    write_atomically(path, B.Header(package_id, schema_namespace=schema_namespace, version=version).encode())


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class PackageWriter(DataSourceWriter):
    """Rows (path, content): tasks write pending files in the target's folder, the commit renames them all."""

    def __init__(self, options: dict):
        self.options = options

    def write(self, iterator: Iterator) -> _Written:
        out = []
        for row in iterator:
            path, image = row["path"], bytes(row["content"])
            B.build_index(B.Memory(image))
            fs, at = B.file_system(path)
            pending = f"{at}.{os.urandom(4).hex()}.pending"
            with fs.open_output_stream(pending, compression=None) as f:
                f.write(image)
            out.append((pending, path))
        return _Written(out)

    def commit(self, messages: list) -> None:
        for m in messages:
            for pending, path in m.files:
                fs, at = B.file_system(path)
                fs.move(pending, at)

    def abort(self, messages: list) -> None:
        for m in messages:
            for pending, path in m.files if m else ():
                B.file_system(path)[0].delete_file(pending)


def encode_packages(packages: DataFrame, groups: DataFrame, records: DataFrame) -> DataFrame:
    """(package_index, content): each package's bytes from its tables.

    A file is its entries' own bytes in pre-order, so a package is one ordered concatenation; group sizes are sums over
    the paths of what lies below. A group's rows go to one task, as a file does; packages go to many.
    """
    from ..functions import columns as K

    head = M.GROUP_HEADER_BYTES
    rec = records.select("package_index", "pre_order", K.record_bytes("signature", "payload", "flags", "record_id", "version_raw", "last_change_set").alias("bytes"), "path")
    own = rec.select("package_index", F.octet_length("bytes").cast("long").alias("n"), "path").unionByName(groups.select("package_index", F.lit(head).cast("long").alias("n"), "path"))
    below = own.select("package_index", F.explode("path").alias("g"), "n").groupBy("package_index", F.col("g.header_offset").alias("header_offset")).agg(F.sum("n").alias("below"))
    sized = groups.join(below, ["package_index", "header_offset"], "left")
    size = F.coalesce("below", F.lit(0)) + head
    grp = sized.select("package_index", "pre_order", F.concat(F.lit(M.GROUP_SIGNATURE), K.le32(size), F.col("label"), K.le32(F.pmod(F.col("group_type").cast("long"), F.lit(1 << 32)))).alias("bytes"))
    body = rec.drop("path").unionByName(grp).groupBy("package_index").agg(F.array_sort(F.collect_list(F.struct("pre_order", "bytes"))).alias("e"))
    content = K.join_bytes(F.transform("e", lambda x: x["bytes"]))
    return packages.join(body, "package_index", "left").select("package_index", "path", F.concat("header", F.coalesce(content, F.unhex(F.lit("")))).alias("content"))
