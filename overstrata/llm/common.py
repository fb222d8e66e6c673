"""Shared pieces of the training-data operators: tables in the shared folder, and text hashing in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..operators.tables import Table, delete, keep_until_exit, shared_dir  # noqa: F401

#: Bytes of text that one numpy step works on; a longer document is a step of its own.
STEP_BYTES = 1 << 20
#: Rows that Spark hands to a Python worker at once.
BATCH_ROWS = 2000
#: Bytes up to which a written table may be broadcast, as rows times the bytes of one, some 64 more a row in the hash table.
BROADCAST_BYTES = 64 << 20
#: Rows up to which a table of a few numbers per row may be broadcast (about 16 bytes a row).
BROADCAST_ROWS = 1_000_000


def small(table: DataFrame, width: int) -> DataFrame:
    """A written table of some bytes a row, marked for a broadcast if it is small; its rows are counted first."""
    from pyspark.sql import functions as F

    return F.broadcast(table) if table.count() * (width + 64) <= BROADCAST_BYTES else table


def bounded_batches(df: DataFrame) -> None:
    """Let the session's Arrow batches hold no more than ``BATCH_ROWS`` rows: texts are long, and two workers share an executor."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))


def bounded_bytes(df: DataFrame) -> None:
    """Let the session's Arrow batches end at ``STEP_BYTES`` too: what the JVM and the workers hold for a batch stays small, however long rows are.

    A row is never cut; a longer one is a batch of its own.
    """
    bound = df.sparkSession._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < bound <= STEP_BYTES:
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(STEP_BYTES))


# ---------------------------------------------------------------------------------------------------
# Words of many texts at once. A text is UTF-8; bytes from 128 on count as letters, and only A-Z are folded.


def _table(folded: bool, blanks_only: bool) -> tuple[np.ndarray, np.ndarray]:
    b = np.arange(256)
    if blanks_only:
        word = ~np.isin(b, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
    else:
        word = ((b >= 48) & (b <= 57)) | ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122)) | (b >= 128)
    value = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 62, 256, dtype=np.uint64) | np.uint64(1)
    if folded:
        value[65:91] = value[97:123]
    return word, value


PLAIN_WORDS = _table(False, True)  #: runs of anything but ASCII white space
FOLDED_WORDS = _table(True, False)  #: runs of letters and digits, A-Z as a-z

_P = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grow(n: int) -> None:
    if len(_powers[0]) < n:
        n = max(n, STEP_BYTES + (1 << 18))
        for k, p in enumerate((_P, pow(_P, -1, 1 << 64))):
            a = np.full(n, p, np.uint64)
            a[0] = 1
            _powers[k] = np.cumprod(a, dtype=np.uint64)


def mix64(h: np.ndarray) -> np.ndarray:
    """The usual 64-bit finisher: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Words:
    """hash, start, end: of each word in the step's bytes; first[d]:first[d + 1]: the words of text d."""

    __slots__ = ("hash", "start", "end", "first", "sums")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: tuple[np.ndarray, np.ndarray]):
        n = len(data)
        _grow(n + 1)
        word = kind[0][data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = False, word[:-1]
            after[-1], after[:-1] = False, word[1:]
            before &= ~edge[:n]
            after &= ~edge[1:]
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(kind[1][data] * _powers[0][:n], out=sums[1:])
        self.hash = mix64((sums[self.end] - sums[self.start]) * _powers[1][self.start])
        self.first, self.sums = np.searchsorted(self.start, offsets), sums

    def prefix(self, at: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the first n bytes of words, which must be as long."""
        start = self.start[at]
        return mix64((self.sums[start + n] - self.sums[start]) * _powers[1][start] + np.uint64(n))


def steps(column: pa.Array | pa.ChunkedArray, step_bytes: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + step_bytes, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


_B = np.uint64(0xD6E8FEB86659FD93)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text index) of every run of k words; a text of 1 to k - 1 words has one shingle, all its words."""
    h, first = words.hash, words.first
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = max(0, len(h) - k + 1)
    s = np.zeros(m, np.uint64)
    for j in range(k):
        s = s * _B + h[j : j + m]
    own = doc[:m] == doc[k - 1 : k - 1 + m]
    out, at = mix64(s[own]), doc[:m][own]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        more = []
        for d in short:
            x = np.uint64(count[d])
            for v in h[first[d] : first[d + 1]]:
                x = np.uint64((int(x) * int(_B) + int(v)) & 0xFFFFFFFFFFFFFFFF)
            more.append(x)
        out, at = np.concatenate([out, mix64(np.array(more, np.uint64))]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        out, at = out[order], at[order]
    return out, at


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From a partition sorted by a long column: tables of whole groups, with where each group starts and the end."""
    held: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        k = held[key].to_numpy()
        at = np.flatnonzero(k[1:] != k[:-1]) + 1
        if len(at):
            yield held.slice(0, at[-1]).combine_chunks(), np.concatenate([[0], at])
            held = held.slice(at[-1])
    if held is not None and held.num_rows:
        yield held.combine_chunks(), np.array([0, held.num_rows])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) of every node of edges (a, b): the least node it is connected with.

    Large-star and small-star steps in turns, each an aggregation with partial sums and a join against a written
    table, until nothing changes. Nodes and edges never leave the executors.
    """
    from pyspark.sql import functions as F

    def stars(e: DataFrame, both: bool) -> DataFrame:
        way = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if both:
            way = way.union(e.select("b", "a"))
        least = Table(way.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), name)
        used.append(least)
        joined = way.join(small(least.df, 32), "u")
        if both:  # neighbours beyond u go to its least one
            return joined.filter("v > u").select(F.col("v").alias("x"), F.col("m").alias("y"))
        return joined.select(F.col("v").alias("x"), F.col("m").alias("y")).union(least.df.select("u", "m"))

    def tidy(e: DataFrame) -> Table:
        # a > b always: each edge points to the smaller node.
        return Table(e.filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), name)

    used: list[Table] = []
    now = tidy(edges.select(F.col("a").alias("x"), F.col("b").alias("y")))
    while True:
        one = tidy(stars(now.df, True))
        two = tidy(stars(one.df, False))
        # A forest of stars, each at its least node, is a fixed point of both steps.
        hubs = two.df.select(F.col("b").alias("a")).distinct()
        settled = two.df.groupBy("a").count().filter("count > 1").limit(1).count() == 0 and two.df.join(hubs, "a", "left_semi").limit(1).count() == 0
        for t in (now, one, *used):
            t.drop()
        used, now = [], two
        if settled:
            break
    return now.df.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.df.select("b", "b").distinct())
