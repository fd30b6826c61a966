import random

import numpy as np
import pytest

from spanweave.llm import minhash
from spanweave.llm.components import connected_components
from spanweave.llm.minhash import bands_for, least_matches, near_duplicates
from spanweave.llm.shingles import shingle_set


def brute(rows, percent):
    """Definition: exact sets, all pairs, reachability."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        g = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        sets.setdefault(i, []).append(g)
    ids = sorted(i for i in sets if i is not None)
    comp = {i: i for i in ids}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[ids[a]] for y in sets[ids[b]]):
                x, y = root(ids[a]), root(ids[b])
                comp[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}, {i: sorted(len(g) for g in v) for i, v in sets.items()}


def compare(spark, rows, percent):
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_shingles int")
    got = near_duplicates(df, percent).collect()
    comp, size = brute(rows, percent)
    assert len(got) == len(rows)
    seen = {}
    for r in got:
        seen.setdefault(r.doc_id, []).append(r.n_shingles)
        if r.doc_id is not None:
            assert r.component_id == comp[r.doc_id] and r.kept == (r.doc_id == comp[r.doc_id])
        else:
            assert r.kept
    assert {k: sorted(v) for k, v in seen.items()} == size


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize("percent", [80, 85])
def test_against_brute_force(spark, percent, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 4)  # so the hub rounds are used too
    rng = random.Random(percent)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 30, 120, 200]))]
        for k in range(rng.choice([1, 2, 9, 25])):
            rows.append((len(rows), " ".join(edited(rng, base, rng.randrange(4)))))
    rows += [(1000, "one two"), (1001, "ONE\ttwo "), (1002, ""), (1003, None), (None, "one two"), (1004, "   "), (1005, "one two"), (1005, "one two")]
    rng.shuffle(rows)
    compare(spark, rows, percent)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).count() == 0


def test_chain_that_hubs_cannot_finish(spark, monkeypatch):
    """Neighbours in a chain are near, others are not: only the exhaustive step links all."""
    monkeypatch.setattr(minhash, "SMALL", 2)
    words = [f"c{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 6 : i * 6 + 200])) for i in range(30)]
    compare(spark, rows, 85)


def test_pruning_keeps_likely_pairs():
    for percent in (80, 85):
        size = bands_for(percent) * minhash.ROWS
        rng = np.random.default_rng(1)
        same = rng.random((20000, size)) < percent / 100
        alive = np.ones(20000, bool)
        for n, least in least_matches(percent, size):
            alive &= same[:, :n].sum(1) >= least
        assert alive.mean() > 0.999


def test_shingles():
    assert len(shingle_set(b"a b c d e f")) == 2 and len(shingle_set(b"a b")) == 1 and len(shingle_set(b" \n ")) == 0
    assert (shingle_set(b"A b\tc d E") == shingle_set(b"a B c d e ")).all()
    assert not np.array_equal(shingle_set("à b c d e".encode()), shingle_set("À b c d e".encode()))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(None, 3), (5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    comp = {}
    for a, b in edges:
        if a is not None and a != b:
            x, y = comp.get(a, {a}), comp.get(b, {b})
            z = x | y
            for n in z:
                comp[n] = z
    assert got == {n: min(z) for n, z in comp.items()}
