"""Similarity join of documents on their runs of five words (Jaccard of 0.8 or more), by chosen paths.

Every distinct text has a signature of sampled tokens: for each hash function the shingle with the least value. A run starts
with all texts in one node. Each node samples one or two tokens of its own choice (1 / similarity of them on average) and
its texts part into a bucket for each value of each: so two texts of similarity s go on together into s / similarity buckets
on average, and a pair at the threshold that one token parts is often still met through the other. Buckets that are still
large are split again, and small ones are compared by brute force on the whole signature. Runs have hash functions of
their own and are repeated until pairs at the threshold are met with the target recall even at the greatest depth. Buckets
that stay large at that depth agree in all their sampled tokens and go on as candidates as a whole.

Buckets only yield a star for each group of likely matches, never pairs. Stars joined up give candidate groups, whose
exact Jaccard values are computed from the whole shingle sets, so links inside a candidate group are complete, not
sampled. A group falls into blocks by hash. Each block is packed once, into a file of the shared folder if its
group has several; pairs of blocks are then tasks that read the files they need, so every shingle set is shuffled once,
however large its group. What leaves a task are sums, and links between the blocks' own classes.

Words are runs of anything but ASCII white space; a text of one to four words has one shingle. Equal texts, by two 64-bit
hashes, are one member of the join and are expanded at the end. Defined cases: null and empty texts are equal, and they and texts
without words match only equal texts; a null doc_id takes no part in a class, and its row has class null; repeated rows
are copies; very long texts have all their shingles in one row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.99  # of a pair just at the threshold that is split to the full depth; more for shallower ones
SMALL = 64
DEPTH = 6
WIDTH = 4  #: tokens that the nodes of a run and depth choose from
BLOCK = 256
PARTNERS = 16  #: blocks that a block is compared with in one task, or a 64th of the group's if that is more


def met(similarity: float = SIMILARITY) -> float:
    """The chance that one run leads two texts of a similarity to a common bucket of the greatest depth."""
    f = 1.0
    for _ in range(DEPTH):  # one token, and in a quarter of the nodes two
        f = 0.75 * similarity * f + 0.25 * (1 - (1 - similarity * f) ** 2)
    return f


def run_count(similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - met(similarity)))


def tokens(runs: int) -> int:
    """Sampled tokens of a signature."""
    return runs * DEPTH * WIDTH


def floor(similarity: float, coordinates: int) -> float:
    """The least share of equal tokens of a likely match: five deviations under the threshold, a loss of some millionths at it."""
    return similarity - 5 * math.sqrt(similarity * (1 - similarity) / coordinates)


def text_key(text: str = "text") -> Column:
    """128 bits of hash of a text; a null one is empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    half = lambda h: F.lpad(F.hex(h), 16, "0")
    return F.unhex(F.concat(half(F.xxhash64(t)), half(F.xxhash64(F.lit("second"), t))))


def signatures(docs: DataFrame, words: int = WORDS, runs: int | None = None) -> DataFrame:
    """(doc_id, text_key, signature, sketch): the text's hash, its least sampled tokens, and a byte of each (null without words).

    Tokens come by depth, run and choice, so that a split takes its depth's alone; buckets are compared by the bytes.
    """
    coordinates = tokens(runs or run_count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 32, (2, coordinates), dtype=np.uint32)
        factor, shift = seeds[0] | np.uint32(1), seeds[1]
        for batch in batches:
            found, short = [None] * batch.num_rows, [None] * batch.num_rows
            for at, _, data, offsets in C.steps(batch.column("text")):
                h, doc = C.shingles(C.Words(data, offsets, C.PLAIN_WORDS), words)
                if len(h):
                    x = (h >> np.uint64(32)).astype(np.uint32)
                    first = np.flatnonzero(np.diff(doc, prepend=-1))
                    sig = np.empty((len(first), coordinates), np.uint32)
                    for c in range(coordinates):
                        sig[:, c] = np.minimum.reduceat(x * factor[c] + shift[c], first)
                    byte = (sig * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)
                    for i, d in enumerate(doc[first]):
                        found[at + d], short[at + d] = sig[i].tobytes(), byte[i].tobytes()
            columns = [batch.column("doc_id").cast(pa.int64()), batch.column("text_key"), pa.array(found, pa.binary()), pa.array(short, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "signature", "sketch"])

    return docs.select("doc_id", "text", text_key().alias("text_key")).mapInArrow(run, "doc_id long, text_key binary, signature binary, sketch binary")


def _stars(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Small buckets by brute force: each member with the first of those it resembles, near or far."""
    for t, at in C.whole_groups(batches, "path"):
        at = np.append(at, t.num_rows) if at[-1] != t.num_rows else at
        keys = t["text_key"].to_pylist()
        sig = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(len(keys), -1)
        a, b = [], []
        for s, e in zip(at[:-1], at[1:], strict=True):
            if e - s == 2:
                if np.count_nonzero(sig[s] == sig[s + 1]) >= least * sig.shape[1]:
                    a.append(keys[s])
                    b.append(keys[s + 1])
                continue
            g = sig[s:e]
            like = (g[:, None, :] == g[None, :, :]).sum(2) >= least * sig.shape[1]
            root = _roots(like)
            for i in np.flatnonzero(root != np.arange(e - s)):
                a.append(keys[s + root[i]])
                b.append(keys[s + i])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _roots(like: np.ndarray) -> np.ndarray:
    """The least index that each index is connected with."""
    root = np.arange(len(like))
    while True:
        near = np.where(like, root[None, :], len(like)).min(1)
        new = np.minimum(root, near)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _split(rows: DataFrame) -> DataFrame:
    """(text_key, run, path) of the buckets into which nodes (path, with the depth's tokens) part their texts."""
    token = f"substring(tokens, cast(4 * (run * {WIDTH} + c) + 1 as int), 4)"
    one, two = f"(h & {WIDTH - 1})", f"((h & {WIDTH - 1}) + 1 + (shiftrightunsigned(h, 8) & 1023) % {WIDTH - 1}) & {WIDTH - 1}"
    chosen = f"if(shiftrightunsigned(h, 32) & 3 = 0, array({one}, {two}), array({one}))"
    paths = F.explode(F.expr(f"transform({chosen}, c -> xxhash64(path, c, {token}))")).alias("path")
    return rows.withColumn("h", F.expr("xxhash64(path, 'choice')")).select("text_key", "run", paths)


def candidates(nodes: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """Star edges (a, b) between texts that may match, from (text_key, signature, sketch)."""
    runs = run_count(similarity, recall)
    at = lambda depth: nodes.select("text_key", F.substring("signature", 4 * WIDTH * runs * depth + 1, 4 * WIDTH * runs).alias("tokens"))
    starts = F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run")
    rows = _split(at(0).select("text_key", "tokens", starts).withColumn("path", F.xxhash64("run")))
    leaves = edges = None
    for depth in range(1, DEPTH + 1):
        rows = C.Table(rows, "paths").df if depth > 1 else rows
        sizes = C.Table(rows.groupBy("path").agg(F.count("*").alias("n"), F.min("text_key").alias("root")).filter("n > 1"), "buckets").df
        sized = rows.join(sizes, "path")
        small = sized.filter(F.col("n") <= SMALL).select("path", "text_key")
        leaves = small if leaves is None else leaves.union(small)
        large = sized.filter(F.col("n") > SMALL)
        if sizes.filter(F.col("n") > SMALL).isEmpty():
            break
        if depth == DEPTH:
            edges = large.filter("root <> text_key").select(F.col("root").alias("a"), F.col("text_key").alias("b"))
            break
        rows = _split(large.select("path", "text_key", "run").join(at(depth), "text_key"))
    least = floor(similarity, tokens(runs))
    signed = leaves.join(nodes.select("text_key", "sketch"), "text_key").select("path", "text_key", "sketch")
    stars = signed.repartition("path").sortWithinPartitions("path", "text_key").mapInArrow(lambda bs: _stars(bs, least), "a binary, b binary")
    return stars if edges is None else stars.union(edges)


class Block:
    """Texts of a candidate group: keys, copies, how many shingles each has, and which of the block's tokens."""

    def __init__(self, keys: list[bytes], copies: np.ndarray, sets: list[np.ndarray]):
        self.keys, self.copies = keys, copies
        self.sizes = np.array([len(x) for x in sets], np.int64)
        joined = np.concatenate(sets)
        self.tokens, self.index = np.unique(joined, return_inverse=True)
        self.index = self.index.astype(np.int32)
        self.own = np.arange(len(keys))  # classes inside the block, by their first member

    def pack(self) -> bytes:
        parts = [np.frombuffer(b"".join(self.keys), np.uint8), self.copies, self.sizes, self.own, self.tokens, self.index]
        raw = np.array([x.nbytes for x in parts], np.int64).tobytes() + b"".join(x.tobytes() for x in parts)
        return zstandard.ZstdCompressor(level=1).compress(raw)

    @classmethod
    def unpack(cls, data: bytes) -> Block:
        raw = zstandard.ZstdDecompressor().decompress(data)
        ends = 48 + np.cumsum(np.frombuffer(raw[:48], np.int64))
        parts = [raw[a:b] for a, b in zip([48, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        new = cls.__new__(cls)
        new.keys = [parts[0][i : i + 16] for i in range(0, len(parts[0]), 16)]
        new.copies, new.sizes, new.own = (np.frombuffer(x, np.int64) for x in parts[1:4])
        new.tokens, new.index = np.frombuffer(parts[4], np.uint64), np.frombuffer(parts[5], np.int32)
        return new

    def linked(self, other: Block, similarity: float) -> np.ndarray:
        """Which of the texts are linked with which of another block's, or of this one's."""
        both = np.zeros((len(self.keys), len(other.keys)))
        if other is self:
            at = np.flatnonzero(np.bincount(self.index) > 1)
            slots = [np.full(len(self.tokens), -1)]
            slots[0][at] = np.arange(len(at))
        else:
            at, x, y = np.intersect1d(self.tokens, other.tokens, assume_unique=True, return_indices=True)
            slots = [np.full(len(b.tokens), -1) for b in (self, other)]
            slots[0][x] = slots[1][y] = np.arange(len(at))
        rows = []
        for b, slot in zip((self, other), slots):
            doc, token = np.repeat(np.arange(len(b.keys)), b.sizes), slot[b.index]
            doc, token = doc[token >= 0], token[token >= 0]
            order = np.argsort(token, kind="stable")
            rows.append((doc[order], token[order]))
        width = min(4096, len(at))
        for low in range(0, len(at), 4096):  # products of 0-1 matrices of some thousand tokens at a time
            m = []
            for b, (doc, token) in zip((self, other), rows):
                f, t = np.searchsorted(token, [low, low + 4096])
                m.append(np.zeros((len(b.keys), width), np.float32))
                m[-1][doc[f:t], token[f:t] - low] = 1
            both += m[0] @ m[-1].T
        out = (both > 0) & (both >= similarity * (self.sizes[:, None] + other.sizes[None, :] - both) - 1e-9)
        if other is self:
            np.fill_diagonal(out, False)
        return out


LINKS = "text_key binary, root binary, n_texts long, n_docs long"


def _links(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(4)], names=["text_key", "root", "n_texts", "n_docs"])


def _file(folder: str, label: bytes, number: int) -> tuple[pafs.FileSystem, str]:
    fs, root = pafs.FileSystem.from_uri(folder)
    return fs, f"{root}/{label.hex()[:2]}/{label.hex()}-{number}"


def _inside(batches: Iterator[pa.RecordBatch], similarity: float, folder: str) -> Iterator[pa.RecordBatch]:
    """Links inside each block: for each text with one its class's first member and its links, to texts and documents.

    Blocks of groups of several are written too. A repeated attempt writes the same bytes, and puts them in place at once.
    """
    for t, at in C.whole_groups(batches, "block"):
        at = np.append(at, t.num_rows) if at[-1] != t.num_rows else at
        keys, labels, copies = t["text_key"].to_pylist(), t["label"].to_pylist(), t["copies"].to_numpy()
        numbers, counts, out = t["number"].to_numpy(), t["blocks"].to_numpy(), []
        for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            own = np.array([i for i in range(s, e) if i == s or keys[i] != keys[i - 1]])  # repeated rows of a document
            sets = [np.frombuffer(x, np.uint64) for x in t["shingles"].take(pa.array(own)).to_pylist()]
            block = Block([keys[i] for i in own], copies[own], sets)
            linked = block.linked(block, similarity)
            block.own = _roots(linked | np.eye(len(own), dtype=bool))
            for i in np.flatnonzero(linked.any(1)).tolist():
                out.append((block.keys[i], block.keys[block.own[i]], int(linked[i].sum()), int(block.copies[linked[i]].sum())))
            if counts[s] > 1:
                fs, path = _file(folder, labels[s], int(numbers[s]))
                fs.create_dir(path.rpartition("/")[0])
                part = f"{path}.{uuid.uuid4().hex}"
                with fs.open_output_stream(part, compression=None) as f:
                    f.write(block.pack())
                fs.move(part, path)
        yield _links(out)


def _across(batches: Iterator[pa.RecordBatch], similarity: float, folder: str) -> Iterator[pa.RecordBatch]:
    """Links of a block's texts to those of other blocks (first to last): their numbers, and between the blocks' classes."""

    def load(label: bytes, number: int) -> Block | None:
        fs, path = _file(folder, label, number)
        try:
            with fs.open_input_stream(path, compression=None) as f:
                return Block.unpack(f.read())
        except FileNotFoundError:  # no text of the group has this number
            return None

    for batch in batches:
        for label, number, first, last in zip(*(batch.column(c).to_pylist() for c in ("label", "number", "first", "last")), strict=True):
            if (own := load(label, number)) is None:
                continue
            texts, docs, joined = np.zeros(len(own.keys), np.int64), np.zeros(len(own.keys), np.int64), set()
            for n in range(first, last + 1):
                if n == number or (other := load(label, n)) is None:
                    continue
                linked = own.linked(other, similarity)
                texts += linked.sum(1)
                docs += linked @ other.copies
                if n > number:  # the other way round, it is that block's task
                    i, j = np.nonzero(linked)
                    joined.update((own.keys[a], other.keys[b]) for a, b in set(zip(own.own[i].tolist(), other.own[j].tolist(), strict=True)))
            yield _links([(own.keys[i], own.keys[i], int(texts[i]), int(docs[i])) for i in np.flatnonzero(texts).tolist()] + [(*x, 0, 0) for x in joined])


def _shingle_sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    names = ["text_key", "label", "copies", "number", "blocks"]
    for batch in batches:
        out = [b""] * batch.num_rows
        for at, _, data, offsets in C.steps(batch.column("text")):
            h, doc = C.shingles(C.Words(data, offsets, C.PLAIN_WORDS), words)
            first = np.searchsorted(doc, np.arange(len(offsets)))
            for d in range(len(offsets) - 1):
                out[at + d] = np.unique(h[first[d] : first[d + 1]]).tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(out, pa.binary())], names=[*names, "shingles"])


def _classes(docs: DataFrame, similarity: float, words: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """Two tables: (doc_id, text_key) of every row, and of every text (text_key, rep, label, class_id, copies, n_texts, n_docs)."""
    C.bounded_batches(docs)
    rows = C.Table(signatures(docs, words, run_count(similarity, recall)), "signatures").df
    nodes = C.Table(rows.filter("doc_id is not null").groupBy("text_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch")), "texts").df
    signed = nodes.filter("signature is not null").select("text_key", "signature", "sketch")
    found = C.Table(C.components(candidates(signed, similarity, recall), "candidates"), "groups").df
    sizes = C.Table(found.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "sizes").df
    members = found.withColumnRenamed("node", "text_key").join(sizes, "label").join(nodes.select("text_key", "rep", "copies"), "text_key")
    number = F.pmod(F.xxhash64("text_key"), F.col("blocks"))
    members = C.Table(members.select(F.col("rep").alias("doc_id"), "text_key", "label", "copies", number.alias("number"), "blocks"), "members").df
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("text_key")).join(C.small(members, 96), ["doc_id", "text_key"])
    sets = texts.mapInArrow(lambda bs: _shingle_sets(bs, words), "text_key binary, label binary, copies long, number long, blocks long, shingles binary")
    folder = f"{C.shared_dir(docs.sparkSession)}/overstrata-blocks-{uuid.uuid4().hex[:12]}"
    C.keep_until_exit(docs.sparkSession, folder)
    blocks = sets.withColumn("block", F.xxhash64("label", "number")).repartition("block").sortWithinPartitions("block", "label", "number", "text_key")
    links = C.Table(blocks.mapInArrow(lambda bs: _inside(bs, similarity, folder), LINKS), "links").df
    many = sizes.filter("blocks > 1").withColumn("width", F.greatest(F.lit(PARTNERS), F.ceil(F.col("blocks") / 64)))
    tasks = many.select("*", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("number"))
    tasks = tasks.select("*", F.explode(F.expr("sequence(0L, blocks - 1, width)")).alias("first")).select("label", "number", "first", F.least(F.col("first") + F.col("width"), "blocks").alias("last"))
    tasks = C.Table(tasks.withColumn("last", F.col("last") - 1), "tasks").df
    if n := tasks.count():
        across = tasks.repartition(min(n, 10_000), "label", "number", "first").mapInArrow(lambda bs: _across(bs, similarity, folder), LINKS)
        links = links.union(C.Table(across, "across").df)
        C.delete(docs.sparkSession, folder)
    classes = C.components(links.filter("root <> text_key").select(F.col("root").alias("a"), F.col("text_key").alias("b")), "classes")
    counts = links.groupBy("text_key").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_docs").alias("n_docs"))
    known = nodes.select("text_key", "rep", "copies").join(counts, "text_key", "left").join(classes.withColumnRenamed("node", "text_key"), "text_key", "left")
    known = C.Table(known.withColumn("label", F.coalesce("label", "text_key")), "known").df
    heads = C.Table(known.groupBy("label").agg(F.min(F.struct("rep", "text_key")).alias("head")), "heads").df
    known = known.join(heads, "label").select("text_key", "rep", "head", "copies", F.coalesce("n_texts", F.lit(0)).alias("n_texts"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
    return rows.select("doc_id", "text_key"), C.Table(known, "known").df


def join(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies, n_text_links) of every document.

    class_id is the least doc_id of the documents it is linked with, directly or through others. n_links counts the
    other documents of similarity >= ``similarity``, copies among them; n_text_links the different texts; n_copies the
    documents of the same text, itself among them.
    """
    rows, known = _classes(docs, similarity, words, recall)
    own = F.col("doc_id").isNotNull()
    return rows.join(known, "text_key", "left").select(
        "doc_id",
        F.when(own, F.col("head.rep")).alias("class_id"),
        F.when(own, F.col("n_docs") + F.col("copies") - 1).otherwise(F.lit(0)).alias("n_links"),
        F.when(own, F.col("copies")).otherwise(F.lit(1)).alias("n_copies"),
        F.when(own, F.col("n_texts")).otherwise(F.lit(0)).alias("n_text_links"),
    )


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """docs with one row of each class: of its least doc_id, and of that id's texts in the class the one of least hash.

    Rows of a null doc_id stay. An id that stands for several texts is judged text by text.
    """
    rows, known = _classes(docs, similarity, words, RECALL)
    kept = (F.col("doc_id") == F.col("rep")) & (F.col("head.text_key") == F.col("text_key"))
    stand = rows.filter("doc_id is not null").join(known.select("text_key", "rep", "head"), "text_key").groupBy("doc_id", "text_key").agg(F.count("*").alias("n"), F.first(kept).alias("kept"))
    stand = stand.filter("not kept or n > 1")
    key, id_ = f"key_{uuid.uuid4().hex[:12]}", f"id_{uuid.uuid4().hex[:12]}"
    stand = C.Table(stand.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key), "kept"), "gone").df
    keyed, columns = docs.withColumns({id_: F.col("doc_id").cast("long"), key: text_key()}), [f"`{c}`" for c in docs.columns]
    out = keyed.join(C.small(stand.select(id_, key), 40), [id_, key], "left_anti").select(*columns)
    again = stand.filter("kept").select(id_, key)
    if not again.isEmpty():  # repeated rows that stay: one of each
        out = out.union(keyed.join(again, [id_, key], "left_semi").dropDuplicates([id_, key]).select(*columns))
    return out
