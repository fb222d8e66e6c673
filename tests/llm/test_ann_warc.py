import base64
import hashlib
import zlib

import numpy as np
import pytest

from overstrata.llm import ann, warc


def test_recall_ties_and_odd_rows(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16))
    v = (centres[rng.integers(0, 12, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    v[500:560] = v[500]  # copies
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    odd = [(9000, None, 1), (9001, [0.0] * 16, 1), (9002, [None] + [1.0] * 15, 1), (9003, [float("nan")] + [1.0] * 15, 1), (9004, [], 1), (9005, [float("inf")] + [1.0] * 15, 1), (None, [1.0] * 16, 1), (9007, [1.0, 2.0], 1), (0, v[0].tolist(), 5)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in ann.search(df.filter("vec_id % 20 = 0"), df, k=20, shard_rows=800).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 3000, 20))
    wide = v.astype(np.float64)
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        score = wide @ wide[q]
        assert all(abs(score[i] - s) < 1e-12 for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        best = sorted((-score[i], i) for i in range(3000) if i != q)[:20]
        hit += len({i for _, i in best} & {i for _, i, _ in found})
    assert hit / (20 * len(got)) >= 0.95
    copies = [i for _, i, _ in got[500] if 500 <= i < 560]
    assert copies and copies == list(range(501, 501 + len(copies)))  # ties go to smaller ids
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
    few = df.filter("vec_id < 3")
    assert sorted((r.query_id, r.vec_id) for r in ann.search(few, few).collect()) == [(a, b) for a in range(3) for b in range(3) if a != b]


def test_doubles_keep_their_digits(spark):
    """Vectors that differ in the ninth digit, in a small shard and in one with a graph; and some beyond the range of floats."""
    for n in (60, 700):
        rng = np.random.default_rng(n)
        v = 1 + rng.integers(0, 10**6, (n, 8)) * 1e-15 + np.arange(n)[:, None] * 1e-9
        v[n // 2 :] *= 1e60
        df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
        got = {}
        for r in ann.search(df.filter("vec_id % 20 = 0"), df, k=3).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        hit = 0
        for q, found in got.items():
            score = v @ v[q]
            assert all(s == pytest.approx(score[i], rel=1e-14) for _, i, s in found)
            best = sorted((-score[i], i) for i in range(n) if i != q)[:3]
            hit += len({i for _, i in best} & {i for _, i, _ in found})
        assert hit >= 0.9 * 3 * len(got) and len(got) == n / 20


def test_recall_of_the_query(spark):
    """The registered query on its whole table, with its own parameters, against brute force."""
    from overstrata.llm import queries

    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got = {}
    for r in queries.queries()["op3_hnsw_search"](spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in ids[ids % 20 == 0]:
        score = v @ v[ids == q][0]
        order = np.lexsort((ids, -score))
        hit += len(got[q] & set(ids[order[ids[order] != q][:20]].tolist()))
    assert hit >= 0.95 * 20 * len(got)


def test_round_trip(spark, tmp_path):
    rows = [(1, "http://a/\r\nx", "same"), (5, None, "same"), (3, "u", None), (2, "u", ""), (7, "u", "é" * 100_000), (8, "u", "WARC/1.1\r\n\r\n"), (8, "u", "WARC/1.1\r\n\r\n"), (None, "u", "only"), (9, "u", "only")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = sorted((tuple(r) for r in warc.round_trip(spark, df, folder=f"file://{tmp_path}/w").collect()), key=str)

    def want(least):
        out = []
        for p, _, h in rows:
            body = (h or "").encode()
            sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
            twins = [q for q, _, x in rows if (x or "").encode() == body and len(body) >= least]
            top = max([q for q in twins if q is not None], default=p)
            out.append((p, len(body), sha, "response" if not twins or p == top else "revisit", None if not twins or p == top else top))
        return out

    w = want(0)
    i = w.index(next(x for x in w if x[0] == 8))
    w[i] = (*w[i][:3], "revisit", 8)  # one of two equal rows
    assert got == sorted(w, key=str)
    # every member stands alone, and the index says where
    n = 0
    for f in (tmp_path / "w" / "archives").glob("*.warc.gz"):
        data = f.read_bytes()
        for line in f.with_name(f.name.replace(".warc.gz", ".idx")).read_text().splitlines():
            _, at, size = map(int, line.split("\t"))
            d = zlib.decompressobj(31)
            assert d.decompress(data[at : at + size]).startswith(b"WARC/1.1\r\n") and d.eof and not d.unused_data
            n += 1
    assert n == len(rows)
    assert {r.record_type for r in warc.round_trip(spark, df, least=10**6).collect()} == {"response"}
    assert warc.round_trip(spark, df.limit(0)).count() == 0


def test_streams_in_pieces():
    raw = b"".join(warc.response(i, "u", b"x" * (i * 997), "f", i) for i in range(40))
    for gz in (zlib.compressobj(6, wbits=31), None):
        data = gz.compress(raw) + gz.flush() if gz else b"".join(c.compress(p) + c.flush() for p in (raw[:5000], raw[5000:]) for c in [zlib.compressobj(6, wbits=31)])

        class Slow:
            at = 0

            def read(self, n):
                self.at += 777
                return data[self.at - 777 : self.at]

        got = list(warc.records(warc.inflate(Slow())))
        assert len(got) == 40 and b"".join(w for _, _, w in got) == raw
    bomb = zlib.compressobj(9, wbits=31)
    data = bomb.compress(bytes(50 << 20)) + bomb.flush()
    Slow.at = 0
    sizes = [len(x) for x in warc.inflate(Slow())]
    assert sum(sizes) == 50 << 20 and max(sizes) <= warc.CHUNK
    with pytest.raises(ValueError, match="ends within"):
        list(warc.records(iter([raw[:-10]])))
