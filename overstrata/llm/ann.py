"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph for each shard.

Every distinct vector goes to a shard by its hash; shards have a bounded number of vectors and bytes, so their number grows
with the input. A shard's graph is a stack of layers, each a flat array of neighbour numbers; with the shard's vectors
and ids it is one file of the shared folder. Queries come in blocks, a file each. A task takes one block through a
few shards, reads one shard at a time, and merges what they find, so neither vectors nor graphs are shuffled and a query
sends its nearest once for all shards of a task.

Inner products become distances on a sphere by one more component, sqrt(R^2 - |x|^2), so the graph can use
its usual rule for diverse links; a query has 0 there, and its order is that of the plain products. Graphs have the
precision of the vectors, floats or doubles, scaled to the longest. Scores are computed again in double precision from
the original components. A shard of up to ``EXACT`` points is searched whole.

Equal vectors are one point with the smallest ids that a result can need (k + 1). Defined cases: rows whose id is
null, or whose vector is null, empty, zero, or holds null or non-finite components take no part; repeated rows count once;
vectors of another length than the query's are no candidates; if an id stands for several vectors, the query is
the least of them and its own rows are no candidates; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SHARD_ROWS = 16384
SHARD_BYTES = 64 << 20
EXACT = 256
QUERY_BLOCK = 1024
SHARDS_AT_ONCE = 16  # of a task at most; a 64th of all shards if those are fewer
LINKS = 16  # in upper layers; twice as many in the lowest
BUILD_WIDTH = 64
SEARCH_WIDTH = 96


class Graph:
    """Layers from the lowest up: members (point numbers) and links (rows of point numbers, -1 for none)."""

    def __init__(self, vectors: np.ndarray):
        # Twice scaled, so that no square overflows: by the largest component, then by the longest vector.
        scaled = vectors.astype(np.float64) / np.abs(vectors).max()
        scaled /= np.sqrt((scaled**2).sum(1).max())
        rest = np.sqrt(np.maximum(1 - (scaled**2).sum(1), 0))
        self.points = np.concatenate([scaled, rest[:, None]], 1).astype(vectors.dtype)
        self.layers: list[np.ndarray] = []

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 7) -> Graph:
        g, n = cls(vectors), len(vectors)
        level = np.floor(-np.log(1 - np.random.Generator(np.random.PCG64(seed)).random(n)) / np.log(LINKS)).astype(int)
        top = int(level.max())
        g.layers = [np.full((n, 2 * LINKS if k == 0 else LINKS), -1, np.int32) for k in range(top + 1)]
        for k in range(top, -1, -1):  # upper layers first: they are the way into the lower ones
            g._fill(k, np.flatnonzero(level >= k))
        g.entry = int(np.flatnonzero(level == top)[0])
        g.level = level
        return g

    def _fill(self, k: int, members: np.ndarray) -> None:
        done = 0
        above = [j for j in range(len(self.layers) - 1, k, -1)]
        while done < len(members):
            new = members[done : done + min(256, max(32, done))]
            q = self.points[new]
            near = q @ q.T
            np.fill_diagonal(near, -np.inf)
            own = np.argsort(-near, axis=1)[:, : min(LINKS, len(new) - 1)]
            found = new[own]
            if done:
                start = np.full(len(new), self._entry if above else members[0])
                for j in above:
                    start = self.search(j, q, start[:, None], 1)[0][:, 0]
                # A member of the layer above is a member here too, but may not be in yet.
                ok = self._in[start]
                start = np.where(ok, start, members[0])
                seen, _ = self.search(k, q, start[:, None], BUILD_WIDTH)
                found = np.concatenate([found, seen], 1)
            self._link(k, new, found)
            if not done:
                self._in = np.zeros(len(self.points), bool)
            self._in[new] = True
            done += len(new)
        self._entry = members[0]

    def _link(self, k: int, new: np.ndarray, found: np.ndarray) -> None:
        links = self.layers[k]
        width = links.shape[1]
        chosen = self._diverse(new, found, min(LINKS, width))
        links[new, : chosen.shape[1]] = chosen
        # The way back: a neighbour with too many links keeps the diverse ones.
        a, b = np.repeat(new, chosen.shape[1]), chosen.ravel()
        a, b = a[b >= 0], b[b >= 0]
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        hubs, first, count = np.unique(b, return_index=True, return_counts=True)
        for most in (8, 32, 1 << 30):  # hubs with few new links together, for small tables
            low = {8: 0, 32: 8}.get(most, 32)
            pick = np.flatnonzero((count > low) & (count <= most))
            for part in np.array_split(pick, max(1, len(pick) // 256)):
                if not len(part):
                    continue
                extra = np.full((len(part), int(count[part].max())), -1, np.int64)
                for i, p in enumerate(part):
                    extra[i, : count[p]] = a[first[p] : first[p] + count[p]]
                links[hubs[part]] = self._diverse(hubs[part], np.concatenate([links[hubs[part]], extra], 1), width)

    def _diverse(self, centre: np.ndarray, found: np.ndarray, width: int) -> np.ndarray:
        """Up to ``width`` links of each centre: nearest first, each nearer to the centre than to those taken before it; then, if there is room, the nearest others."""
        found = found.astype(np.int64)
        sim = np.einsum("bcd,bd->bc", self.points[found], self.points[centre])
        sim[(found < 0) | (found == centre[:, None])] = -np.inf
        order = np.argsort(found, axis=1, kind="stable")
        by_id = np.take_along_axis(found, order, 1)
        twice = np.zeros(found.shape, bool)
        np.put_along_axis(twice, order[:, 1:], by_id[:, 1:] == by_id[:, :-1], 1)
        sim[twice] = -np.inf
        most = min(found.shape[1], 96)
        order = np.argsort(-sim, axis=1)[:, :most]
        found, sim = np.take_along_axis(found, order, 1), np.take_along_axis(sim, order, 1)
        p = self.points[found]
        among = np.einsum("bcd,bed->bce", p, p)
        taken, valid = np.zeros(found.shape, bool), np.isfinite(sim)
        for c in range(most):
            close = (among[:, c, :] > sim[:, c, None]) & taken
            taken[:, c] = valid[:, c] & ~close.any(1) & (taken.sum(1) < width)
        # taken ones first, then the nearest of the rest
        rank = np.argsort(np.where(taken, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :width]
        out = np.where(np.take_along_axis(valid, rank, 1), np.take_along_axis(found, rank, 1), -1)
        if out.shape[1] < width:
            out = np.concatenate([out, np.full((len(out), width - out.shape[1]), -1)], 1)
        return out.astype(np.int32)

    def search(self, k: int, queries: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(points, products) of the ``width`` best found in a layer, best first; all queries step together."""
        links, b = self.layers[k], len(queries)
        ids = np.full((b, width), -1, np.int64)
        sim = np.full((b, width), -np.inf, self.points.dtype)
        ids[:, : start.shape[1]] = start
        sim[:, : start.shape[1]] = np.einsum("bcd,bd->bc", self.points[start], queries)
        fresh = ids >= 0
        rows = np.arange(b)
        step = 1 if width == 1 else 4
        while len(rows):
            s = np.where(fresh[rows], sim[rows], -np.inf)
            pick = np.argsort(-s, axis=1)[:, :step]
            open_ = np.isfinite(np.take_along_axis(s, pick, 1))
            live = open_[:, 0]
            rows, pick, open_ = rows[live], pick[live], open_[live]
            if not len(rows):
                break
            at = np.take_along_axis(ids[rows], pick, 1)
            f = fresh[rows]
            np.put_along_axis(f, pick, False, 1)
            near = np.where(open_[:, :, None], links[at], -1).reshape(len(rows), -1)
            got = np.einsum("bcd,bd->bc", self.points[near], queries[rows])
            got[near < 0] = -np.inf
            all_ids, all_sim = np.concatenate([ids[rows], near], 1), np.concatenate([sim[rows], got], 1)
            all_fresh = np.concatenate([f, np.isfinite(got)], 1)
            order = np.argsort(all_ids, axis=1, kind="stable")  # of equal points the one in the beam is first
            x = np.take_along_axis(all_ids, order, 1)
            twice = np.zeros(all_ids.shape, bool)
            np.put_along_axis(twice, order[:, 1:], x[:, 1:] == x[:, :-1], 1)
            all_sim[twice] = -np.inf
            best = np.argsort(-all_sim, axis=1, kind="stable")[:, :width]
            ids[rows], sim[rows] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_sim, best, 1)
            fresh[rows] = np.take_along_axis(all_fresh, best, 1) & np.isfinite(sim[rows])
        ids[~np.isfinite(sim)] = -1
        return ids, sim

    def nearest(self, queries: np.ndarray, width: int) -> np.ndarray:
        """Numbers of the points found near each query, -1 for none."""
        if len(self.points) <= max(EXACT, width):
            return np.broadcast_to(np.arange(len(self.points)), (len(queries), len(self.points)))
        q = queries / np.abs(queries).max(1, keepdims=True)  # an order by products has no scale
        q = np.concatenate([q, np.zeros((len(q), 1), q.dtype)], 1).astype(self.points.dtype)
        out = []
        for low in range(0, len(q), 512):
            part = q[low : low + 512]
            at = np.full((len(part), 1), self.entry)
            for k in range(len(self.layers) - 1, 0, -1):
                at = self.search(k, part, at, 4)[0][:, :1]
            out.append(self.search(0, part, at, width)[0])
        return np.concatenate(out)

    def pack(self) -> bytes:
        """Entry, sizes and the flat neighbour arrays."""
        head = np.array([self.entry, len(self.layers), *(x.shape[1] for x in self.layers)], np.int32)
        return head.tobytes() + b"".join(x.tobytes() for x in self.layers)

    @classmethod
    def unpack(cls, vectors: np.ndarray, data: bytes) -> Graph:
        g, x = cls(vectors), np.frombuffer(data, np.int32)
        g.entry, count = int(x[0]), int(x[1])
        at = 2 + count
        for w in x[2 : 2 + count]:
            g.layers.append(x[at : at + len(vectors) * w].reshape(-1, w))
            at += len(vectors) * w
        return g


def _vectors(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    kind = np.float32 if pa.types.is_float32(column.type.value_type) else np.float64
    return np.concatenate([np.asarray(x.values.to_numpy(zero_copy_only=False), kind) for x in column]).reshape(-1, dim)


def _store(folder: str, arrays: dict[str, np.ndarray]) -> str:
    """A file of arrays under a name that no other attempt of a task uses."""
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root)
    name, held = uuid.uuid4().hex, io.BytesIO()
    np.savez(held, **arrays)
    with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
        f.write(held.getbuffer())
    return name


def _load(folder: str, name: str) -> dict[str, np.ndarray]:
    fs, root = pafs.FileSystem.from_uri(folder)
    with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
        return dict(np.load(io.BytesIO(f.read())))


def _build(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    for t, at in C.whole_groups(batches, "shard"):
        at = np.append(at, t.num_rows) if at[-1] != t.num_rows else at
        for s, e in zip(at[:-1], at[1:], strict=True):
            g = t.slice(s, e - s)
            dim, ids = g["dim"][0].as_py(), g["ids"].to_pylist()
            vectors = _vectors(g["embedding"], dim)
            graph = Graph.build(vectors).pack() if len(vectors) > EXACT else b""
            file = _store(folder, {"vectors": vectors, "ids": np.concatenate(ids).astype(np.int64), "ends": np.cumsum([len(x) for x in ids]), "graph": np.frombuffer(graph, np.uint8)})
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([g["shard"][0].as_py()], pa.int64()), pa.array([file])], names=["dim", "shard", "file"])


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, embedding, dim) of the rows that take part; components are floats if the table's are, else doubles."""
    good = "vec_id is not null and embedding is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x <> 0)"
    kind = "float" if table.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    return table.filter(good).select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{kind}>"), F.size("embedding").alias("dim")).distinct()


def index(rows: DataFrame, k: int, folder: str, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(dim, shard, file) of each shard, from ``usable`` rows."""
    points = rows.withColumn("n", F.expr("row_number() over (partition by embedding order by vec_id)")).filter(F.col("n") <= k + 1)
    points = points.groupBy("embedding", "dim").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # k + 1 ids at most
    points = C.Table(points, "points").df
    n, dim = points.agg(F.count("*"), F.max("dim")).first()
    shards = max(1, -(-n // max(1, min(shard_rows, SHARD_BYTES // (8 * (dim or 1))))))
    points = points.withColumn("shard", F.expr(f"dim * 1000000000L + pmod(xxhash64(embedding), {shards})"))
    built = points.repartition(shards, "shard").sortWithinPartitions("shard", F.expr("ids[0]")).mapInArrow(lambda bs: _build(bs, folder), "dim int, shard long, file string")
    return C.Table(built, "index").df


def _blocks(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Queries of a block as one file."""
    for t, at in C.whole_groups(batches, "block"):
        at = np.append(at, t.num_rows) if at[-1] != t.num_rows else at
        for s, e in zip(at[:-1], at[1:], strict=True):
            g = t.slice(s, e - s)
            dim = g["dim"][0].as_py()
            file = _store(folder, {"queries": _vectors(g["embedding"], dim), "ids": g["vec_id"].to_numpy().astype(np.int64)})
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([file])], names=["dim", "block"])


def _visit(batches: Iterator[pa.RecordBatch], folder: str, k: int, width: int) -> Iterator[pa.RecordBatch]:
    """The nearest of a block's queries in some shards, one of which is in memory at a time."""
    for batch in batches:
        for block, files in zip(batch.column("block").to_pylist(), batch.column("files").to_pylist(), strict=True):
            asked = _load(folder, block)
            queries, query_ids = asked["queries"], asked["ids"]
            held: list[tuple[np.ndarray, ...]] = []
            for file in sorted(files):
                shard = _load(folder, file)
                vectors, ids, ends = shard["vectors"], shard["ids"], shard["ends"]
                graph = Graph.unpack(vectors, shard["graph"].tobytes()) if len(shard["graph"]) else Graph(vectors)
                found = graph.nearest(queries, width)
                exact, first = vectors.astype(np.float64), np.concatenate([[0], ends[:-1]])
                for q, points in enumerate(found):
                    points = points[points >= 0]
                    count = ends[points] - first[points]
                    at = np.repeat(first[points] - np.cumsum(count) + count, count) + np.arange(count.sum())
                    who, score = ids[at], np.repeat(exact[points] @ queries[q].astype(np.float64), count)
                    other = who != query_ids[q]
                    who, score = who[other], score[other]
                    o = np.lexsort((who, -score))[:k]
                    held.append((np.full(len(o), q), who[o], score[o]))
                if len(held) > len(queries):  # what earlier shards have found, and this one
                    held = [_nearest(held, k)]
            q, who, score = _nearest(held, k)
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(who), pa.array(score)], names=["query_id", "vec_id", "score"])


def _nearest(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """(query, vec_id, score) of the k best of each query."""
    q, who, score = (np.concatenate(x) for x in zip(*found, strict=True))
    o = np.lexsort((who, -score, q))
    q, who, score = q[o], who[o], score[o]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, int)
    keep = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < k
    return q[keep], who[keep], score[keep]


def search(queries: DataFrame, table: DataFrame, k: int = 20, width: int = SEARCH_WIDTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found in ``table``, ties to the smaller vec_id."""
    spark = table.sparkSession
    folder = f"{C.shared_dir(spark)}/overstrata-ann-{uuid.uuid4().hex[:12]}"
    C.keep_until_exit(spark, folder)
    made = index(usable(table), k, folder, shard_rows)
    asked = usable(queries).groupBy("vec_id").agg(F.min(F.struct("embedding", "dim")).alias("q")).select("vec_id", "q.embedding", "q.dim")
    asked = C.Table(asked, "queries").df
    n = max(1, -(-asked.count() // QUERY_BLOCK))
    blocks = asked.withColumn("block", F.expr(f"dim * 1000000000L + pmod(xxhash64(vec_id), {n})")).repartition(n, "block").sortWithinPartitions("block", "vec_id")
    blocks = C.Table(blocks.mapInArrow(lambda bs: _blocks(bs, folder), "dim int, block string"), "blocks").df
    # Names of files meet, not what is in them: each block with each group of shards of its dimension.
    shards = made.count()
    few = max(1, min(SHARDS_AT_ONCE, shards // 64))
    groups = made.groupBy("dim", F.expr(f"pmod(shard, {-(-shards // few) or 1})").alias("g")).agg(F.collect_list("file").alias("files"))
    tasks = C.Table(blocks.join(groups, "dim").select("block", "files"), "visits").df
    found = tasks.repartition(min(10_000, max(1, tasks.count())), "block", "files").mapInArrow(lambda bs: _visit(bs, folder, k, width), "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)"))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
