import hashlib
import math
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from overstrata.llm import common as C
from overstrata.llm import decontaminate, packing, suffix_dedup, toxicity

# --- packing --------------------------------------------------------------------------------------


def ids_of(text):
    t = ids_of.t = getattr(ids_of, "t", None) or Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return t.encode(text or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("text", ["", " ", "a", "two  blanks", " lead", "trail ", "x\n\n y", "x \ny", "a\u00a0 b", "it's 12 o'clock", "x" * 5000, "<|endoftext|> in it", "tab\t end", "日本 語 é", "\0 \x7f"])
def test_tokens_are_the_tokenizer_s(text):
    got = np.frombuffer(packing.tokenizer()(text) + (2).to_bytes(4, "little"), "<u4").tolist()
    assert got == ids_of(text)


NBSP = "\u00a0"


@pytest.mark.parametrize("text", ["a" + f" {NBSP}" * 2 + " b", f"a{NBSP}" + f" {NBSP}" * 3 + "b", "x\n \ny", "x\n ", "x\t \u3000 \u2003 y"])
def test_tokens_of_mixed_white_space(text):
    assert np.frombuffer(packing.tokenizer()(text) + (2).to_bytes(4, "little"), "<u4").tolist() == ids_of(text)


def test_tokens_of_random_white_space():
    rng, odd = random.Random(11), [" ", " ", " ", NBSP, "\n", "\t", "\r", "\u0085", "\u2028", "\u3000", "\u2003", "\u180e", "\u200b", "\ufeff", "\x1c", "a", "7", "'s", "."]
    for _ in range(20_000):
        text = "".join(rng.choice(odd) for _ in range(rng.randrange(1, 9)))
        assert np.frombuffer(packing.tokenizer()(text) + (2).to_bytes(4, "little"), "<u4").tolist() == ids_of(text), text


def test_packing(odd_docs, no_docs):
    rows = packing.pack(odd_docs).collect()
    places, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 1024
    for r in odd_docs.collect():
        n, cuts, a = len(i := ids_of(r.text)), [], 0
        b = n % 1024 or min(1024, n)
        while a < n:
            cuts.append((len(cuts), a, b - a, zlib.crc32(np.array(i[a:b], "<u4").tobytes())))
            a, b = b, b + 1024
        assert set(cuts) <= set(pieces[r.doc_id])
    assert packing.pack(no_docs).count() == 0
    total = sum(r.length for r in rows)
    assert len(places) <= -(-total // 1024) + 2


def test_packer_is_best_fit():
    p, free = packing.Packer(10, open_bins=3), {}
    for n in [6, 5, 7, 3, 4, 9, 8, 2, 1, 10, 1]:
        fits = [f for f in free.values() if f >= n]
        b, at = p.put(n)
        if fits:
            assert 10 - at == min(fits) and free[b] == 10 - at
        else:
            if len(free) == 3:
                del free[min(free, key=free.get)]  # the fullest closes
            assert at == 0 and b not in free
        free[b] = 10 - at - n
        if not free[b]:
            del free[b]


# --- suffixes -------------------------------------------------------------------------------------


def brute_dedup(rows, length):
    first, out = {}, []
    for i, t in sorted(((i, t) for i, t in rows if i is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            first.setdefault(b[k : k + length], i)
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if i is not None and first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [50, 20])
def test_dedup_against_brute_force(spark, monkeypatch, length):
    monkeypatch.setattr(suffix_dedup, "SHARD_TEXT", 20_000)
    monkeypatch.setattr(suffix_dedup, "FLUSH", 30_000)
    rng = random.Random(length)
    alphabet = "ab é\0\n"
    passages = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(10, 200))) for _ in range(12)]
    rows = []
    for i in range(120):
        t = "".join(rng.choice([rng.choice(passages), "".join(rng.choice("xyzé ") for _ in range(rng.randrange(30)))]) for _ in range(rng.randrange(6)))
        rows.append((i // 2 * 3 if rng.random() < 0.2 else i * 3, t))
    rows += [(5000, rows[3][1]), (5001, "x" * 400), (5002, "x" * 300), (5003, None), (5004, ""), (None, rows[3][1]), (5005, "x" * 400), (5005, "x" * 400)]
    df = spark.createDataFrame([(*r, "k", b"b") for r in rows], "doc_id long, text string, x string, blobs binary").repartition(4)
    got = sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in suffix_dedup.dedup(df, length, with_text=True).collect()), key=str)
    assert got == brute_dedup(rows, length)


def hot_rows(n):
    rng = random.Random(9)
    text = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(k))
    passage = text(150)
    return [(i, text(60) + (passage if i % 3 == 0 else text(40)) + text(60)) for i in range(n)]


def test_dedup_of_a_hot_passage(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 20, raising=False)
    monkeypatch.setattr(suffix_dedup, "SHARD_TEXT", 5_000)
    rows = hot_rows(300)
    rows += [(i - 7, t[20:] + t[:90]) for i, t in rows[:60]] + [(None, rows[0][1]), (400, rows[3][1][:120] + "\0é" + rows[3][1][50:])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in suffix_dedup.dedup(df, with_text=True).collect()), key=str)
    assert got == brute_dedup(rows, 50)


def test_hot_passage_is_spread_over_shards():
    """The strings next to a passage of a third of the documents don't share one shard."""
    import pyarrow as pa

    S, shards, rows = suffix_dedup, 20, hot_rows(3000)
    batch = pa.RecordBatch.from_pydict({"doc_key": pa.array(range(3000), pa.int64()), "doc_id": pa.array(range(3000), pa.int64()), "text": [t for _, t in rows]})

    def dealt(batches):
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["part"])
        return [pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int64()), ("mark", pa.int64()), ("blob", pa.binary())]))]

    shared = [r for b in S._find_shared(iter(dealt(S._send_anchors(iter([batch]), shards, 50))), shards, 100) for r in b.to_pylist()]
    many = np.concatenate([S._unpack(r["blob"], np.uint64)[0] for r in shared if r["mark"] == 1])
    found = [r for b in S._gather(iter(dealt([pa.RecordBatch.from_pylist([r for r in shared if r["mark"] != 1])])), 1) for r in b.to_pylist()]
    wanted = {r["doc_key"]: r["blob"] for r in found}
    batch = batch.filter(pa.array([k in wanted for k in range(3000)])).append_column("blob", pa.array([wanted[k] for k in range(3000) if k in wanted], pa.binary()))
    hot = np.zeros(S.HOT_BITS // 8, np.uint8)
    for h in (many >> np.uint64(40)).tolist():
        hot[h >> 3] |= 1 << (h & 7)

    def sent(hot):
        size = defaultdict(int)
        for b in S._send_contexts(iter([batch]), shards, 50, hot):
            for r in b.to_pylist():
                size[r["part"]] += len(S._unpack(r["blob"], np.uint8)[0])
        return size

    all_, cold = sent(np.zeros_like(hot)), sent(hot)
    assert max(all_.values()) > 0.2 * sum(all_.values())  # all strings around one anchor in one shard
    assert max(cold.values()) < 0.07 * sum(all_.values())  # no shard gets them: they are rows, which any number of tasks share
    assert sum(b.num_rows for b in S._hot_places(iter([batch]), 50, hot)) >= 1000 * 4


def shard_of(rows):
    """Blobs of contexts as they reach a shard, each with one occurrence."""
    blobs = []
    for low in range(0, len(rows), 2000):
        part = rows[low : low + 2000]
        ids = np.array([d for d, _ in part])
        blobs.append(suffix_dedup._pack(np.frombuffer(b"".join(x for _, x in part), np.uint8), np.array([len(x) for _, x in part]), np.ones(len(part), np.int64), ids + 7, ids, ids * 1000))
    return blobs


def contexts(n, seed):
    rng = np.random.default_rng(seed)
    base = bytes(rng.integers(97, 101, 10 * n).astype(np.uint8))
    return [(int(d), base[a : a + k] if r < 0.7 else bytes(rng.integers(97, 123, k).astype(np.uint8))) for d, a, k, r in zip(rng.permutation(n), rng.integers(0, 10 * n - 90, n), rng.integers(50, 85, n), rng.random(n))]


@pytest.mark.parametrize("most", [1 << 26, 200_000])
def test_a_shard_against_brute_force(most):
    rows = contexts(6000, 11)
    got = {}
    for key, doc, span in suffix_dedup._sort_shard(iter(shard_of(rows)), 50, most):
        assert (key == doc + 7).all()
        for d, (a, b) in zip(doc.tolist(), span.tolist()):
            got.setdefault(d, set()).update(range(a - 1000 * d, b - 1000 * d))
    first, want = {}, {}
    for d, x in rows:
        for i in range(len(x) - 49):
            first[x[i : i + 50]] = min(d, first.get(x[i : i + 50], d))
    for d, x in rows:
        for i in range(len(x) - 49):
            if first[x[i : i + 50]] < d:
                want.setdefault(d, set()).update(range(i, i + 50))
    assert got == want


def test_a_shard_larger_than_memory():
    """Under a bound of 2 MB three times the text takes little more (the share of a range), and far less than without a bound."""
    import tracemalloc

    def peak(n, most):
        blobs = shard_of(contexts(n, 12))
        tracemalloc.start()
        for _ in suffix_dedup._sort_shard(iter(blobs), 50, most):
            pass
        out = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out

    C._grow(1 << 20)
    small, large, free = peak(25_000, 1 << 21), peak(75_000, 1 << 21), peak(75_000, 1 << 28)
    assert large < 2 * small and large < 16 << 20 and free > 10 * large, (small, large, free)  # 8, 13 and 178 MB when this was written


def test_dedup_empty(no_docs):
    assert suffix_dedup.dedup(no_docs).count() == 0


@pytest.mark.parametrize("memory", [1 << 28, 2000])
@pytest.mark.parametrize("step", [1 << 20, 7])
def test_suffix_order_and_prefixes(memory, step, monkeypatch):
    """All suffixes in order with right common prefixes, in memory and with queues, ranges and names on disk, level by level."""
    I = suffix_dedup.I
    monkeypatch.setattr(I, "STEP", step)
    if step < 100:
        monkeypatch.setattr(I, "RANGE", 5)
    rng = random.Random(4)
    for n in range(300):
        a, depth = rng.randint(1, 4), rng.randint(1, 60)
        raw = bytes(rng.randint(1, a) for _ in range(rng.randint(1, 60))) * (rng.randint(1, 5) if n % 3 == 0 else 1)
        raw += (b"\0" + raw[rng.randint(0, len(raw) - 1) :] if n % 5 == 0 else b"") + b"\0"
        got = list(I.suffixes(I.padded(raw, depth), depth, memory))
        place, lcp = (np.concatenate(x)[::-1].tolist() for x in zip(*got))
        want = sorted(range(len(raw) - 1), key=lambda i: raw[i:])
        assert place == want
        for x, y, k in zip(want, want[1:], lcp):
            assert min(k, depth) == min(depth, len(os.path.commonprefix([raw[x:], raw[y:]])))


def test_order_of_names():
    I, rng = suffix_dedup.I, random.Random(3)
    for n in range(500):
        t = [rng.randint(1, 1 + n % 6) for _ in range(rng.randint(0, 40))] * (1 + n % 3) + [0]
        kinds = sorted(set(t))
        t = [kinds.index(x) for x in t]
        for most in (1 << 20, 2000):
            assert I.order_of(np.array(t, np.int32), len(kinds), most).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def test_long_text_in_slices(monkeypatch):
    data = np.frombuffer(("".join(random.Random(1).choice("abcd ") for _ in range(5000))).encode(), np.uint8)
    whole = suffix_dedup.anchors(data, np.array([0, 5000]), 50)
    monkeypatch.setattr(suffix_dedup, "SLICE", 700)
    parts = suffix_dedup.anchors(data, np.array([0, 5000]), 50)
    cover = lambda x: {(int(h), p) for h, s, e in zip(x[0], x[2], x[3]) for p in range(s, e + 1)}
    assert cover(whole) == cover(parts) and {p for _, p in cover(whole)} == set(range(4951))


# --- decontamination ------------------------------------------------------------------------------


def words(text):
    import pyarrow as pa

    ((_, _, data, offsets),) = C.steps(pa.array([text]))
    return C.Words(data, offsets, C.FOLDED_WORDS).hash


def test_tiling():
    a, b = words("p q a b c d e f x y g h i j k"), words("g h i j k a b c d e f")
    assert sorted(decontaminate.tile(a, b)) == [(2, 5, 6), (10, 0, 5)]
    assert decontaminate.tile(words("a b c d"), words("a b c d")) == []
    assert sum(k for *_, k in decontaminate.tile(words("a " * 40), words("a " * 30))) == 30
    long = "w" + " w".join(map(str, range(300)))
    assert decontaminate.tile(words(long), words(long)) == [(0, 0, 300)]


def greedy(text, item, least):
    """Greedy string tiling by all pairs of equal words: the longest, first in the item, then first in the text."""
    free_t, free_i, tiles = [True] * len(text), [True] * len(item), []
    where = {}
    for i, x in enumerate(text):
        where.setdefault(x, []).append(i)
    while True:
        best = (0, 0, 0)
        for j in range(len(item)):
            for i in where.get(item[j], ()):
                k = 0
                while i + k < len(text) and j + k < len(item) and text[i + k] == item[j + k] and free_t[i + k] and free_i[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return tiles
        tiles.append((i, j, k))
        free_t[i : i + k], free_i[j : j + k] = [False] * k, [False] * k


def test_tiling_is_plain_greedy():
    rng = random.Random(8)
    for n in range(300):
        a = np.array([rng.randrange(2 + n % 6) for _ in range(rng.randrange(50))], np.uint64)
        b = np.array([rng.randrange(2 + n % 6) for _ in range(rng.randrange(30))], np.uint64)
        assert decontaminate.tile(a, b, 3) == greedy(a.tolist(), b.tolist(), 3)


def test_tiling_of_repetitive_texts_takes_seconds():
    import time

    begin = time.time()
    one = lambda n: np.full(n, 7, np.uint64)
    assert decontaminate.tile(one(200_000), one(1000)) == [(0, 0, 1000)]
    a = np.tile(np.array([1, 2, 3, 1, 2, 4], np.uint64), 30_000)
    b = np.concatenate([np.append(np.resize(np.array([1, 2, 3, 1, 2, 4], np.uint64), n), 9) for n in range(5, 45)]).astype(np.uint64)
    assert sum(k for *_, k in decontaminate.tile(a, b)) == sum(range(5, 45))
    assert time.time() - begin < 20


def test_matches_against_brute_force(spark):
    """Every document of a test table against every item, without seeds, filters or hashes."""
    import re

    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    split = lambda t: re.findall("[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = {r.item_id: split(r.text) for r in bench.collect()}
    # the longest shared passages in other orders, and halves of items on both sides of the bound
    more = []
    for n, (i, x) in enumerate(sorted(items.items())):
        for share in (0.4, 0.5, 0.6):
            k = math.ceil(share * len(x))
            more.append((10_000 + 10 * n + int(10 * share), " ".join(["pre", *x[len(x) - k // 2 :], "mid", *x[: k - k // 2], "post"])))
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    want = {}
    for r in docs.collect():
        text = split(r.text)
        for i, x in items.items():
            if set(text) & set(x):
                got = greedy(text, x, min(5, len(x)))
                if got and sum(k for *_, k in got) >= 0.5 * len(x):
                    want[r.doc_id, i] = (sum(k for *_, k in got) / len(x), len(got), sum(k for *_, k in got), max(k for *_, k in got))
    got = {(r.doc_id, r.item_id): (r.coverage, r.n_tiles, r.matched_words, r.longest) for r in decontaminate.matches(docs, bench).collect()}
    assert got == want and len(want) > 50
    left = {r.doc_id for r in decontaminate.contaminated(docs, bench).collect()}
    assert left == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_contaminated(spark, odd_docs, no_docs):
    items = [(1, "What is the Capital of France and who was the first to rule it"), (2, None), (3, ""), (4, "one two three"), (5, "never seen words in any of these documents at all")]
    bench = spark.createDataFrame([(*i, 1.0) for i in items], "item_id long, text string, coverage double")
    a, b = "what is the capital of france", "and who was the first to rule it"
    docs = spark.createDataFrame([(100, f"noise {a.upper()}! {b} noise"), (101, f"{b} then other things, {a}"), (102, "what is the capital of spain"), (103, f"x {b} y"), (104, f"{a}")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (round(r.coverage, 3), r.n_tiles) for r in decontaminate.matches(docs, bench).collect()}
    assert got == {(100, 1): (1.0, 1), (101, 1): (1.0, 2), (103, 1): (round(8 / 14, 3), 1)}
    assert {r.doc_id for r in decontaminate.contaminated(docs, bench).collect()} == {102, 104}
    odd = decontaminate.contaminated(odd_docs, bench)
    again = docs.union(docs).select("doc_id", "text", F.lit(1).alias("x"), F.lit(2).alias("y"), F.lit(3).alias("ix"), F.lit(4).alias("seed"))
    assert sorted(r.doc_id for r in decontaminate.matches(again, bench.union(bench)).collect()) == sorted([100, 101, 103] * 4)
    assert sorted(map(tuple, decontaminate.contaminated(again, bench).collect())) == sorted([(d, t, 1, 2, 3, 4) for d, t in [(102, "what is the capital of spain"), (104, a)]] * 2)
    assert odd.schema == odd_docs.schema and {9, 10} & {r.doc_id for r in odd.collect()} == set() and odd.count() == odd_docs.count() - 2
    assert decontaminate.matches(no_docs, bench).count() == 0 and decontaminate.matches(odd_docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(odd_docs, bench.limit(0)).count() == odd_docs.count()


# --- toxicity -------------------------------------------------------------------------------------


def test_toxicity_learns_and_locates(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(3))
    rows, labels = [], []
    for i in range(1500):
        s = [[word() for _ in range(8)] for _ in range(6)]
        toxic = i % 5 == 0
        if toxic:
            s[rng.randrange(6)][3] = rng.choice(["vile", "nasty", "zorgling" + word()])
        rows.append((i, ". ".join(" ".join(x) for x in s) + ".", "x", 0.0))
        labels.append((i, int(toxic)))
    rows += [(2000, None, "x", 0.0), (2001, "", "x", 0.0), (2002, "You vile. Fine words", "x", 0.0), (2002, "You vile. Fine words", "x", 0.0), (None, "vile", "x", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.score(docs, model).withColumn("held_out", toxicity.held_out()).collect()
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 2000]
    assert len(held) > 200 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in got if r.doc_id is not None)
    by = {r.doc_id: r for r in got}
    assert by[2000].score == by[2001].score == 0 and by[2000].predicted == 0 and len(got) == len(rows)
    (span,) = by[2002].offending
    assert "You vile. Fine words"[span.start : span.end] == "You vile" and by[None].predicted == 1 and not by[None].held_out
    kept = toxicity.reject(docs, model)
    assert kept.schema == docs.schema and kept.count() == sum(not r.predicted for r in got)


def test_toxicity_without_labels(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    m = toxicity.fit(odd_docs, none)
    assert {r.predicted for r in toxicity.score(odd_docs, m).collect()} == {0} and toxicity.score(no_docs, m).count() == 0
    assert toxicity.reject(odd_docs, m).count() == odd_docs.count()
    bad = spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(odd_docs, toxicity.fit(odd_docs, bad)).collect() if r.score > 0.01} == set()
