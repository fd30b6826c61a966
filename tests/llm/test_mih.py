import math

import numpy as np

from spanweave.llm.mih import BlockIndex, hamming, learn, nearest, op3_nearest_neighbours


def brute(vecs, every, k):
    ids = sorted(vecs)
    x = np.array([vecs[i] for i in ids], float)
    out = {}
    for i, q in zip(ids, x):
        if i % every == 0:
            d = np.sqrt(((x - q) ** 2).sum(1))
            out[i] = [(ids[j], d[j]) for j in np.lexsort((ids, d)) if ids[j] != i][:k]
    return out


def test_index_returns_the_whole_ball():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 256, (3000, 4)).astype(np.uint8)
    index = BlockIndex(codes)
    for radius in (0, 3, 7, 12, 32):
        for q in codes[:5]:
            assert np.array_equal(index.within(q, radius), np.flatnonzero(hamming(codes, q) <= radius))


def test_recall(spark):
    d = "/root/testdata/sf0.1"
    vecs = {r.vec_id: r.embedding for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}
    want = brute(vecs, 100, 10)
    got = {}
    for r in op3_nearest_neighbours(spark, d).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hit = 0
    for q, w in want.items():
        assert sorted(got[q]) == list(range(1, 11))
        found = [got[q][i] for i in range(1, 11)]
        assert found == sorted(found, key=lambda v: (v[1], v[0]))
        assert all(math.isclose(s, np.sqrt(((np.array(vecs[v], float) - np.array(vecs[q], float)) ** 2).sum()), abs_tol=1e-12) for v, s in found)
        hit += len({v for v, _ in found} & {v for v, _ in w})
    assert hit >= 0.95 * 10 * len(want)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [1.0, 0.0]), (6, [2.0, 0.0]), (100, [1.0, 0.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (9, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, x int")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nearest(df).collect())
    assert got == [(0, 1, 5, 0.0), (0, 2, 100, 0.0), (0, 3, 6, 1.0), (100, 1, 0, 0.0), (100, 2, 5, 0.0), (100, 3, 6, 1.0)]
    assert nearest(df.limit(0)).count() == 0
    assert nearest(df.where("vec_id = 6")).count() == 0


def test_many_equal_vectors(spark):
    rng = np.random.default_rng(3)
    vecs = {i: ([0.5] * 8 if i % 3 == 0 else rng.normal(size=8).tolist()) for i in range(400)}
    got = {}
    for r in nearest(spark.createDataFrame(list(vecs.items()), "vec_id long, embedding array<double>"), every=50).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(vecs, 50, 10)
    assert sorted(got[0]) == sorted(want[0]) and all(len(v) == 10 for v in got.values())
    assert learn(np.ones((5, 3)), 10).radius <= 3
