import math
import random
from collections import defaultdict

import pytest

from overstrata.llm import common as C
from overstrata.llm import ngram_join as N


def brute(rows, k=5, least=0.8):
    """(class, links) of each (doc_id, text), by all pairs."""
    sets = {}
    for i, t in rows:
        w = (t or "").split()
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else None
    texts = dict(rows)
    links, root = defaultdict(set), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b:
                same = (texts[a] or "") == (texts[b] or "")
                x, y = sets[a], sets[b]
                if same or (x and y and len(x & y) >= least * len(x | y) - 1e-9):
                    links[a].add(b)
                    links[b].add(a)
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return {i: (find(i), len(links[i])) for i in ids}


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for g in range(30):
        w = [rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(rng.randrange(3, 120))]
        for _ in range(rng.randrange(1, 9)):
            v = list(w)
            for _ in range(rng.randrange(0, 4)):
                v[rng.randrange(len(v))] = "new" + str(rng.randrange(9))
            rows.append((len(rows), " ".join(v)))
    got = {r.doc_id: (r.class_id, r.n_links) for r in N.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_large_group_and_hot_shingle(spark, monkeypatch):
    """A group of near copies beyond a bucket and a block, and one passage in every text."""
    rng = random.Random(2)
    w = [f"c{rng.randrange(999)}" for _ in range(100)]
    hot = "the very same opening words of all of them"
    rows = [(i, " ".join([*w[:50], f"x{i}", *w[50:]])) for i in range(300)]
    rows += [(1000 + i, hot + " " + " ".join(f"u{rng.randrange(9999)}" for _ in range(40))) for i in range(200)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in N.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_links_across_blocks(spark, monkeypatch):
    """Groups of many blocks: a chain of texts, near copies of one, and pairs in between."""
    monkeypatch.setattr(N, "BLOCK", 7)
    monkeypatch.setattr(N, "PARTNERS", 3)
    rng = random.Random(6)
    w = [f"c{rng.randrange(9999)}" for _ in range(160)]
    rows = [(i, " ".join(w[i : i + 60])) for i in range(100)]  # neighbours are linked, the ends share nothing
    rows += [(500 + i, " ".join([*w[:50], f"x{i}", *w[50:]])) for i in range(60)]
    rows += [(700 + i, rows[i][1]) for i in range(0, 100, 9)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in N.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_ids_with_several_texts(spark):
    """Each text of an id is judged by itself."""
    rng = random.Random(9)
    a, b, c = ([f"v{rng.randrange(9999)}" for _ in range(60)] for _ in range(3))
    near = lambda x: " ".join([*x[:-1], "other"])
    rows = [(1, " ".join(a)), (2, near(a)), (2, " ".join(b)), (2, " ".join(b)), (3, near(b)), (4, " ".join(c)), (None, " ".join(a))]
    kept = N.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [rows[0], rows[2], rows[5], rows[6]]))


def test_recall_at_the_threshold_and_full_depth(spark, monkeypatch):
    """1,000 pairs of 80 common shingles in 100, all split to the greatest depth."""
    monkeypatch.setattr(N, "SMALL", 1)
    rng, rows = random.Random(4), []
    for i in range(1000):
        w = [f"{i}w{rng.randrange(10**6)}" for _ in range(104)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:84]))]
    nodes = C.Table(N.signatures(spark.createDataFrame(rows, "doc_id long, text string")), "test").df
    assert N.candidates(nodes.select("text_key", "signature", "sketch")).distinct().count() >= 980


def test_floor_loses_next_to_nothing():
    n = N.tokens(N.run_count())
    least = math.ceil(N.floor(0.8, n) * n)
    assert sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(least)) < 1e-5


def test_odd_rows(odd_docs):
    got = sorted([tuple(r) for r in N.join(odd_docs).collect()], key=lambda r: (r[0] is not None, *[x or 0 for x in r]))
    by = defaultdict(list)
    for r in got:
        by[r[0]].append(r[1:])
    assert len(got) == odd_docs.count()
    assert by[None] == [(None, 0, 1, 0)] * 2
    assert by[1] == [(1, 2, 2, 1)] and by[3] == [(1, 2, 1, 1)]
    assert by[4] == [(4, 1, 2, 0)] and by[5] == [(4, 1, 2, 0)]  # null and empty are equal texts
    assert by[6] == [(6, 0, 1, 0)] and by[7] == [(7, 1, 2, 0)] * 2 and by[9] == [(9, 1, 2, 0)]


def test_keep_one(odd_docs, no_docs):
    kept = sorted(r.doc_id or 0 for r in N.keep_one(odd_docs).collect())
    assert kept == [0, 0, 1, 4, 6, 7, 8, 9, 11]
    assert N.keep_one(odd_docs).schema == odd_docs.schema
    assert N.keep_one(no_docs).count() == 0 and N.join(no_docs).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {r.node: r.label for r in C.components(spark.createDataFrame([e for e in edges if e[0] != e[1]], "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


@pytest.mark.parametrize("kind", [C.PLAIN_WORDS, C.FOLDED_WORDS])
def test_word_hashes(kind):
    import pyarrow as pa

    texts = ["Hello wörld", "hello  WÖRLD\n", "", None, "a"]
    (at, to, data, offsets), = C.steps(pa.array(texts))
    w = C.Words(data, offsets, kind)
    words = [[data[s:e].tobytes() for s, e in zip(w.start[w.first[d] : w.first[d + 1]], w.end[w.first[d] : w.first[d + 1]])] for d in range(5)]
    assert words[0] == ["Hello".encode(), "wörld".encode()] and words[2] == words[3] == [] and words[4] == [b"a"]
    assert (w.hash[0] == w.hash[2]) == (kind is C.FOLDED_WORDS)
