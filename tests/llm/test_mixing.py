import random
from collections import defaultdict

import numpy as np

from spanweave.llm.mixing import _flight, _landing, mix, op4_mix_sources


def brute_targets(sizes):
    """Weights by code point order, null last; excess above twice the source's size shared again by weight."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, capped, total = 1.5 * sum(sizes.values()), {}, set(names)
    while True:
        open_ = [s for s in names if s not in capped]
        w = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > 2 * sizes[s]]
        if not over:
            return capped | {s: left * weight[s] / w for s in open_}
        for s in over:
            capped[s] = 2.0 * sizes[s]
        left = 1.5 * sum(sizes.values()) - sum(capped.values())


def check(rows, got):
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len((t or "").split())
    want = brute_targets(size)
    taken = defaultdict(int)
    big = defaultdict(int)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.source_size == size[r.source]
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
        big[r.source] = max(big[r.source], r.size)
    for s in size:
        assert abs(taken[s] - want[s]) <= 2 * big[s] + 1e-6


def test_random_tables(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.choice([0, 1, 3, 10, 50, 400]), rng.choice(["a", "b", "Z", "é", None, "q"])) for i in range(600)]
    rows += [(None, None, None), (7, "x y", "a"), (7, "x y", "a"), (8, "", "only")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    a = mix(df).collect()
    assert len(a) == len(rows)
    check(rows, a)
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.copies)
    assert sorted(map(key, a)) == sorted(map(key, mix(df.repartition(7)).collect()))
    assert mix(df.limit(0)).count() == 0


def test_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in d.collect()]
    check(rows, mix(d).collect())
    assert op4_mix_sources(spark, "/root/testdata/sf0.01").columns == ["doc_id", "size", "source_size", "target", "taken"]


def test_flight_keeps_totals_and_probabilities():
    size = [float(x) for x in np.random.default_rng(1).integers(1, 500, 60)]
    hits = np.zeros(60)
    for k in range(400):
        pi = [0.3] * 60
        rng = np.random.default_rng(k)
        _flight(size, pi, rng)
        assert sum(0 < p < 1 for p in pi) <= 2
        assert abs(sum(pi) - 18) < 1e-6 and abs(sum(p * s for p, s in zip(pi, size)) - 0.3 * sum(size)) < 1e-4
        _landing(pi, rng)
        assert set(pi) <= {0.0, 1.0}
        hits += pi
    assert abs(hits / 400 - 0.3).max() < 0.12
