"""Benchmark decontamination by greedy string tiling.

Shared runs of words are seeds: a table of the items' seeds is joined with those of the documents. A pair goes on if it
shares enough of them to be covered at all: tiles of ``min_match`` words or more that cover a share of an item hold at
least that share divided by ``min_match`` of its seeds, so nothing is lost. Of each pair, the running Karp-Rabin tiling
marks the longest match of unmarked words again and again, down to ``min_match`` words; of equally long ones that
which begins first in the item, then first in the text. The words of the item under tiles, as a share of all its words, are
its coverage; passages in another order still tile, so they count in full.

Benchmark and documents meet in joins only. A filter of ``FILTER_BITS`` bits of the seeds, whose size doesn't depend on the
benchmark, is sent to all tasks, so that few of the documents' seeds are shuffled. Texts go by two 64-bit hashes, equal
ones once; a document goes if its text does.

Words are runs of letters and digits, with A-Z folded, and equal if their 64-bit hashes are. Defined cases: null or empty texts and
items without words match nothing; an item of fewer than ``min_match`` words must stand as a whole; repeated items
and repeated documents each count; very long and repetitive texts take a number of passes over their words that
the item's length bounds; empty tables give no rows, or leave all documents; other columns are not read, and stay.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MIN_MATCH = 5
COVERAGE = 0.5
#: Bits of the filter of seeds, 2 MB.
FILTER_BITS = 1 << 24
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


class Rolling:
    """Karp-Rabin hashes of all windows of any length of an array: from sums that run over it once."""

    def __init__(self, x: np.ndarray):
        if len(_powers[0]) < len(x) + 1:
            for k, p in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
                a = np.full(2 * len(x) + 1, p, np.uint64)
                a[0] = 1
                _powers[k] = np.cumprod(a, dtype=np.uint64)
        self.sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(C.mix64(x) * _powers[0][: len(x)], out=self.sums[1:])

    def windows(self, n: int, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the windows of n words that are all free."""
        if len(free) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        taken = np.concatenate([[0], np.cumsum(~free)])
        at = np.flatnonzero(taken[n:] == taken[:-n])
        return at, (self.sums[at + n] - self.sums[at]) * _powers[1][at]


def tile(text: np.ndarray, item: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in text, start in item, length) of two arrays of word hashes.

    If words of length n match, so do some of length n - 1: the longest length is searched by halving, and all matches of
    that length are marked, before the next, smaller one.
    """
    free_t, free_i, tiles = np.ones(len(text), bool), np.ones(len(item), bool), []
    roll_t, roll_i = Rolling(text), Rolling(item)

    def shared(n: int) -> bool:
        return np.isin(roll_t.windows(n, free_t)[1], roll_i.windows(n, free_i)[1]).any()

    most = min(len(text), len(item))
    while most >= min_match and shared(min_match):
        low, high = min_match, most + 1  # low matches, high doesn't
        step = min_match
        while low + step < high:  # from below: most matches are short
            if not shared(low + step):
                high = low + step
                break
            low, step = low + step, 2 * step
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if shared(middle) else (low, middle)
        most = low
        at_t, hash_t = roll_t.windows(most, free_t)
        at_i, hash_i = roll_i.windows(most, free_i)
        known = np.isin(hash_i, hash_t)
        order = np.argsort(hash_t, kind="stable")
        places, hash_t = at_t[order], hash_t[order]
        at_i, hash_i = at_i[known], hash_i[known]
        first = np.searchsorted(hash_t, hash_i)
        last = np.searchsorted(hash_t, hash_i, "right")
        following: dict[int, int] = {}  # of a hash: the places before it are taken
        for j, lo, hi in zip(at_i.tolist(), first.tolist(), last.tolist(), strict=True):
            if not free_i[j : j + most].all():
                continue
            at = following.get(lo, lo)
            # In steps, as a run of equal words has many places that one tile takes.
            while at < hi and not free_t[places[at] : places[at] + most].all():
                busy = places[at] + np.flatnonzero(~free_t[places[at] : places[at] + most])[-1]
                at += max(1, int(np.searchsorted(places[at:hi], busy, "right")))
            following[lo] = at
            if at < hi:
                free_t[places[at] : places[at] + most] = free_i[j : j + most] = False
                tiles.append((int(places[at]), j, most))
        most -= 1
    return tiles


def cover(text: np.ndarray, item: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Tiles of an item in a text. Words of the text that the item lacks part it into runs; only those are tiled."""
    own = np.isin(text, item)
    least = min(min_match, len(item))
    pos = np.flatnonzero(own)
    if not len(pos):
        return []
    # Runs shorter than a tile can't hold one. A word that isn't the item's stands between the others.
    cut = np.flatnonzero(np.diff(pos) > 1) + 1
    parts = [text[r[0] : r[-1] + 1] for r in np.split(pos, cut) if len(r) >= least]
    if not parts:
        return []
    other = np.uint64(0)
    while other in item:
        other += np.uint64(1)
    joined = np.concatenate([x for p in parts for x in (p, np.full(1, other))])
    return tile(joined, item, least)


def _runs(w: C.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    h, doc = w.hash, np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    m = max(0, len(h) - k + 1)
    s = np.full(m, k, np.uint64)
    for j in range(k):
        s = s * np.uint64(0xD6E8FEB86659FD93) + h[j : j + m]
    own = doc[:m] == doc[k - 1 : k - 1 + m]
    return C.mix64(s[own]), doc[:m][own]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_ITEM = pa.schema([("ix", pa.int64()), ("iy", pa.int64()), ("n", pa.int32()), ("words", pa.binary())])


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item's words; those without a word are none."""
    for batch in batches:
        rows, x, y = [], batch.column("x").to_pylist(), batch.column("y").to_pylist()
        for at, _, data, offsets in C.steps(batch.column("text")):
            w = C.Words(data, offsets, C.FOLDED_WORDS)
            for d in np.flatnonzero(np.diff(w.first)).tolist():
                own = w.hash[w.first[d] : w.first[d + 1]]
                rows.append((x[at + d], y[at + d], len(own), own.tobytes()))
        yield _table(rows, _ITEM)


def _item_seeds(batches: Iterator[pa.RecordBatch], min_match: int) -> Iterator[pa.RecordBatch]:
    """Each item's seeds and how often it has them; an item shorter than a seed is one as a whole."""
    schema = pa.schema([("seed", pa.int64()), ("ix", pa.int64()), ("iy", pa.int64()), ("n", pa.int32()), ("times", pa.int64())])
    for batch in batches:
        rows = []
        for x, y, n, words in zip(*(batch.column(c).to_pylist() for c in ("ix", "iy", "n", "words")), strict=True):
            w = C.Words.__new__(C.Words)
            w.hash, w.first = np.frombuffer(words, np.uint64), np.array([0, n])
            found, times = np.unique(_runs(w, min(min_match, n))[0], return_counts=True)
            rows += [(s, x, y, n, t) for s, t in zip(found.view(np.int64).tolist(), times.tolist(), strict=True)]
        yield _table(rows, schema)


def _hits(batches: Iterator[pa.RecordBatch], bits: np.ndarray, sizes: list[int]) -> Iterator[pa.RecordBatch]:
    """Of each text the different seeds that the filter passes."""
    shift = np.uint64(64 - int(math.log2(FILTER_BITS)))
    for batch in batches:
        x, y = batch.column("x").to_numpy(), batch.column("y").to_numpy()
        for at, _, data, offsets in C.steps(batch.column("text")):
            w = C.Words(data, offsets, C.FOLDED_WORDS)
            s, d = (np.concatenate(v) for v in zip(*(_runs(w, k) for k in sizes), strict=True))
            high = s >> shift
            keep = np.flatnonzero(bits[high >> np.uint64(3)] >> (high & np.uint64(7)).astype(np.uint8) & np.uint8(1))
            s, d = s[keep], d[keep]
            order = np.lexsort((s, d))
            s, d = s[order], d[order]
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
            s, d = s[new], d[new]
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(x[at + d]), pa.array(y[at + d])], names=["seed", "x", "y"])


_TILED = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("ix", pa.int64()), ("iy", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int32()), ("matched_words", pa.int32()), ("longest", pa.int32())])


def _tiles(batches: Iterator[pa.RecordBatch], coverage: float, min_match: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, known = [], (None, None)
        keys = zip(*(batch.column(c).to_pylist() for c in ("x", "y", "ix", "iy")), strict=True)
        for (x, y, ix, iy), text, words in zip(keys, batch.column("text"), batch.column("words"), strict=True):
            if known[0] != (x, y):
                ((_, _, data, offsets),) = C.steps(pa.array([text.as_py()], pa.string()), 1 << 62)
                known = (x, y), C.Words(data, offsets, C.FOLDED_WORDS).hash
            item = np.frombuffer(words.as_py(), np.uint64)
            got = cover(known[1], item, min_match)
            n = sum(k for _, _, k in got)
            if got and n >= coverage * len(item):
                rows.append((x, y, ix, iy, n / len(item), len(got), n, max(k for _, _, k in got)))
        yield _table(rows, _TILED)


def _spark(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.float64(): "double", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def keyed(docs: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """docs with two hashes of the text, by which equal texts are one."""
    return docs.withColumns({x: F.xxhash64("text"), y: F.xxhash64(F.lit("second"), "text")})


def covered(docs: DataFrame, benchmark: DataFrame, coverage: float, min_match: int) -> tuple[DataFrame, DataFrame]:
    """Two tables: (x, y, ix, iy, coverage, ...) of texts and items tiled to ``coverage``, and (item_id, ix, iy) of the items."""
    C.bounded_batches(docs)
    named = keyed(benchmark.filter("text is not null").select("item_id", "text"), "ix", "iy")
    items = named.groupBy("ix", "iy").agg(F.first("text").alias("text")).select(F.col("ix").alias("x"), F.col("iy").alias("y"), "text")
    items = C.Table(items.mapInArrow(_items, _spark(_ITEM)), "items").df
    seeds = C.Table(items.mapInArrow(lambda bs: _item_seeds(bs, min_match), "seed long, ix long, iy long, n int, times long"), "seeds").df
    # The filter: at most FILTER_BITS / 64 words, and one number for each length of short items.
    place = F.shiftrightunsigned("seed", 64 - int(math.log2(FILTER_BITS)))
    words = seeds.select((place / 64).cast("int").alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - int(math.log2(FILTER_BITS))}) & 63 as int))").alias("bit"))
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        bits[r["at"]] = r["bits"]
    sizes = sorted({min_match, *(r.n for r in items.filter(F.col("n") < min_match).select("n").distinct().collect())})
    shared = docs.sparkSession.sparkContext.broadcast(bits.view(np.uint8))  # 2 MB
    texts = keyed(docs.select("text").filter("text is not null"))
    hits = texts.mapInArrow(lambda bs: _hits(bs, shared.value, sizes), "seed long, x long, y long")
    need = F.greatest(F.lit(1), F.ceil(F.col("n") * coverage / min_match - 1e-9))
    # Equal texts send equal rows: they are counted once.
    pairs = hits.distinct().join(C.small(seeds, 36), "seed").groupBy("x", "y", "ix", "iy", "n").agg(F.sum("times").alias("times"))
    pairs = C.Table(pairs.filter(F.when(F.col("n") < min_match, F.col("times") > 0).otherwise(F.col("times") >= need)).select("x", "y", "ix", "iy"), "pairs").df
    wanted = C.Table(pairs.select("x", "y").distinct(), "wanted").df
    found = texts.join(C.small(wanted, 16), ["x", "y"], "left_semi").groupBy("x", "y").agg(F.first("text").alias("text"))
    both = found.join(pairs, ["x", "y"]).join(items.drop("n"), ["ix", "iy"]).select("x", "y", "ix", "iy", "text", "words")
    tiled = C.Table(both.mapInArrow(lambda bs: _tiles(bs, coverage, min_match), _spark(_TILED)), "tiles").df
    return tiled, named.select("item_id", "ix", "iy")


def matches(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, min_match: int = MIN_MATCH) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, matched_words, longest) of each document and item tiled to ``coverage`` or more."""
    tiled, items = covered(docs, benchmark, coverage, min_match)
    ids = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text")
    out = ids.join(tiled.join(items, ["ix", "iy"]), ["x", "y"])
    return out.select("doc_id", F.col("item_id").cast("long").alias("item_id"), "coverage", "n_tiles", "matched_words", "longest")


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, min_match: int = MIN_MATCH) -> DataFrame:
    """docs without those that hold a benchmark item; all columns and all other rows stay as they are."""
    tiled, _ = covered(docs, benchmark, coverage, min_match)
    x, y = f"x_{uuid.uuid4().hex[:12]}", f"y_{uuid.uuid4().hex[:12]}"
    gone = C.Table(tiled.select(F.col("x").alias(x), F.col("y").alias(y)).distinct(), "gone").df
    return keyed(docs, x, y).join(C.small(gone, 16), [x, y], "left_anti").select(*[f"`{c}`" for c in docs.columns])
