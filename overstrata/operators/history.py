"""Change histories as tables: ids, checks, ancestry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import codec as B
from ..functions import columns as K
from .graph import ancestry, closure

CHANGE_SETS = "id binary, parents array<binary>, destination binary, source binary, author string, message string, timestamp long, operations array<struct<kind:int,record_id:long,previous:binary,digest:binary>>"


def le64(x: Column) -> Column:
    h = F.lpad(F.hex(x.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(h, i, 2) for i in range(15, 0, -2)]))


def change_set_id() -> Column:
    """The id of a change set row: SHA-256 of its canonical bytes, in the JVM."""
    empty = F.unhex(F.lit(""))
    blob = lambda t: F.concat(K.le32(F.octet_length(t)), F.encode(t, "UTF-8"))
    ops = F.transform("operations", lambda o: F.concat(F.unhex(F.lpad(F.hex(o["kind"].cast("long")), 2, "0")), K.le32(o["record_id"]), F.coalesce(o["previous"], empty), F.coalesce(o["digest"], empty)))
    parts = [F.lit(b"PCP-CHANGE-SET\0"), K.le32(F.size("parents")), K.join_bytes("parents"), F.col("destination"), F.col("source"), le64(F.col("timestamp")), blob(F.col("author")), blob(F.col("message")), K.le32(F.size("operations")), K.join_bytes(ops)]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def violations(changes: DataFrame, nil: bytes = bytes(16)) -> DataFrame:
    """(code, id) of change sets that break a rule."""
    rules = {
        "NilPackageId": (F.col("destination") == F.lit(nil)) | (F.col("source") == F.lit(nil)),
        "SourceEqualsDestination": F.col("destination") == F.col("source"),
        "EmptyAuthor": F.coalesce(F.col("author"), F.lit("")) == "",
        "NoOperations": F.size("operations") <= 0,
        "DuplicateOperation": F.size(F.array_distinct(F.transform("operations", lambda o: o["record_id"]))) < F.size("operations"),
        "ChangeSetIdMismatch": F.col("id") != change_set_id(),
    }
    codes = F.filter(F.array(*[F.when(rule, code) for code, rule in rules.items()]), lambda x: x.isNotNull())
    out = changes.select(F.explode(codes).alias("code"), "id")
    missing = changes.select("id", F.explode("parents").alias("parent")).join(changes.select(F.col("id").alias("parent")), "parent", "left_anti")
    return out.union(missing.select(F.lit("MissingParent").alias("code"), "id").distinct())


def insert(store: DataFrame, new: DataFrame) -> DataFrame:
    """store with the new rows whose ids it lacks; those it holds stay as they are."""
    return store.unionByName(new.dropDuplicates(["id"]).join(store.select("id"), "id", "left_anti").select(*store.columns))


def ancestors(changes: DataFrame) -> DataFrame:
    """(node, ancestor, depth) of all change sets; a change set is also its own ancestor, which has no row."""
    return ancestry(changes.select(F.col("id").alias("node"), F.explode("parents").alias("parent")))


def is_ancestor(changes: DataFrame, a: bytes, d: bytes) -> bool:
    """True of an id and itself, known or not."""
    if a == d:
        return True
    spark = changes.sparkSession
    edges = changes.select(F.col("id").alias("a"), F.explode("parents").alias("b"))
    return closure(edges, spark.createDataFrame([(bytearray(d),)], "node binary")).filter(F.col("node") == F.lit(a)).limit(1).count() > 0


def read_history(spark, raw: bytes) -> DataFrame:
    h = B.History.from_bytes(raw)
    rows = [(k, list(c.parents), c.destination, c.source, c.author, c.message, c.timestamp, [(o.kind, o.record_id, o.previous, o.digest) for o in c.operations]) for k, c in sorted(h.entries.items())]
    return spark.createDataFrame(rows, CHANGE_SETS)


def write_history(changes: DataFrame) -> bytes:
    """A history file is one ordered artefact of a project's change sets; rows come one partition at a time."""
    h = B.History()
    for r in changes.orderBy("id").toLocalIterator():
        c = B.ChangeSet(tuple(map(bytes, r.parents)), bytes(r.destination), bytes(r.source), r.author, r.message, r.timestamp, tuple(B.Operation(o.kind, o.record_id, o.previous and bytes(o.previous), o.digest and bytes(o.digest)) for o in r.operations))
        h.entries[c.id] = c
    return h.to_bytes()
