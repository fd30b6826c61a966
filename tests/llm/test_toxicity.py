import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from spanweave.llm.toxicity import TOKEN, ToxicModel, choose_features, features, fit_chain, fit_curve, forward_backward, lowered, numbered, op2_toxicity, score, train


def enumerated(u, t, s):
    """Marginals, expected transitions and log partition of one chain, over all its labellings."""
    z, mass, pairs = 0.0, np.zeros(len(u)), np.zeros((2, 2))
    for y in itertools.product((0, 1), repeat=len(u)):
        w = np.exp((s[y[0]] if y else 0) + sum(a * b for a, b in zip(u, y)) + sum(t[a, b] for a, b in itertools.pairwise(y)))
        z += w
        mass += w * np.array(y)
        for a, b in itertools.pairwise(y):
            pairs[a, b] += w
    return mass / z, pairs / z, np.log(z)


@pytest.mark.parametrize("block", [1, 2, 3, 64])
def test_forward_backward_against_enumeration(block):
    rng = np.random.default_rng(3)
    size, t, s = np.array([5, 0, 3, 1, 8, 6]), rng.normal(size=(2, 2)), rng.normal(size=2)
    u = rng.normal(size=size.sum())
    p, pairs, log_z = forward_backward(u, size, t, s, block)
    want = [enumerated(x, t, s) for x in np.split(u, np.cumsum(size)[:-1])]
    assert np.allclose(p, np.concatenate([w[0] for w in want])) and np.allclose(pairs, sum(w[1] for w in want))
    assert np.allclose(log_z, [w[2] for w in want])


def test_very_long_chain():
    u = np.where(np.arange(200_000) % 7 == 0, 5.0, -5.0)
    p = forward_backward(u, np.array([len(u)]), np.array([[2.0, -2.0], [-2.0, 2.0]]), np.zeros(2))[0]
    assert np.isfinite(p).all() and np.allclose(p[7000:7700], p[14000:14700])


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in op2_toxicity(spark, d).collect()}
    labels = spark.read.parquet(f"{d}/labels.parquet").collect()
    held = [r for r in labels if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(got[r.doc_id].held_out for r in held)
    tp = sum(got[r.doc_id].predicted == 1 for r in held if r.toxic)
    assert tp >= 0.9 * sum(r.toxic for r in held)
    assert sum(got[r.doc_id].predicted for r in held if not r.toxic) <= 0.01 * len(held)


def test_spans_and_odd_rows(spark):
    rows = [(i, f"you are a {w} and nothing else number {c}", 1) for i, (w, c) in enumerate(itertools.product(["vilest", "awfulest"], "abcdefghij"))]
    rows += [(100 + i, f"this is a fine text about nothing else number {c}", 0) for i, c in enumerate("abcdefghijklmnopqrst")]
    counts = Counter((f, y) for _, t, y in rows for f in {f for w in t.split() for f in features(w)})
    odds = choose_features([(f, counts[f, 0], counts[f, 1]) for f in {f for f, _ in counts}], 20, 20)
    m, index = ToxicModel(), {f: i for i, f in enumerate(odds)}
    fit_chain(m, index, [numbered(t, y, index, {f for f, v in odds.items() if v > 2.5}) for _, t, y in rows])
    fit_curve(m, [m.aggregate(p) for p in m.marginals([t for _, t, _ in rows])], [y for _, _, y in rows], (20, 20))
    df = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2), (3, "oh VILEST thing", 0), (4, "word " * 50000, 0)], "doc_id long, text string, score int")
    got = score(df, m, spans=True).collect()
    assert len(got) == 5
    by = {r.doc_id: r for r in got}
    assert [(s.start, s.end) for s in by[3].spans] == [(3, 9)] and by[3].score > 0.5 and not by[4].spans and by[1].score < 0.5
    assert score(df.limit(0), m).count() == 0


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    m = train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert isinstance(m, ToxicModel) and 0 <= score(docs, m).first().score <= 1


def test_spans_keep_their_places():
    assert lowered("\u0130A") == "\u0130a" and len(lowered("x\u0130\u0130y")) == 4
    m = ToxicModel()
    m.weights, m.bias = {"bad": 12.0}, -6.0
    text = "\u0130\u0130 BAD bad x"
    p = m.marginals([text])[0]
    assert m.spans(text, p) == [(3, 10)]


def test_query_against_brute_force(spark):
    """Every score and span again from the model's numbers, by dynamic programming over whole texts in plain Python."""
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    m = train(docs, labels)
    t, s = np.exp(m.trans), np.exp(m.start)
    got = {r.doc_id: r for r in op2_toxicity(spark, d).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        text = r.text or ""
        words = TOKEN.findall(lowered(text))
        e = [math.exp(max(-30.0, min(30.0, m.bias + sum(m.weights.get(f, 0.0) for f in features(w))))) for w in words]
        a, b, p = [], [[1.0, 1.0] for _ in words], []
        for k in range(len(words)):
            x = [s[0], s[1]] if not k else [a[-1][0] * t[0, i] + a[-1][1] * t[1, i] for i in (0, 1)]
            z = x[0] + x[1] * e[k]
            a.append([x[0] / z, x[1] * e[k] / z])
        for k in range(len(words) - 2, -1, -1):
            x = [t[i, 0] * b[k + 1][0] + t[i, 1] * e[k + 1] * b[k + 1][1] for i in (0, 1)]
            b[k] = [v / sum(x) for v in x]
        p = [x[1] * y[1] / (x[0] * y[0] + x[1] * y[1]) for x, y in zip(a, b, strict=True)]
        agg = [max(p), math.log1p(sum(p)), sum(p) / len(p)] if p else [0.0] * 3
        want = 1 / (1 + math.exp(-max(-30.0, min(30.0, m.offset + sum(c * v for c, v in zip(m.curve, agg))))))
        assert math.isclose(got[r.doc_id].score, want, rel_tol=1e-6), r.doc_id
        assert got[r.doc_id].predicted == int(want >= 0.3) and got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        inside = {i for x in got[r.doc_id].spans for i in range(x.start, x.end)}
        for q, tok in zip(p, TOKEN.finditer(lowered(text)), strict=True):
            if abs(q - 0.5) > 1e-6:
                assert (tok.start() in inside) == (q >= 0.5)
