import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from spanweave.llm import hmm
from spanweave.llm.hmm import HiddenMarkov, op8_lm_scoring, score_texts


def some_model(rng, states, symbols):
    d = lambda *s: (x := rng.random(s) + 0.05) / x.sum(-1, keepdims=True)
    return HiddenMarkov(d(states), d(states, states), d(states, symbols).T.copy())


def brute(m, seq):
    return sum(math.prod([m.start[p[0]], *(m.trans[a, b] for a, b in itertools.pairwise(p)), *(m.emit[s, k] for s, k in zip(seq, p))]) for p in itertools.product(range(len(m.start)), repeat=len(seq)))


@pytest.mark.parametrize("block", [512, 1, 2, 4])
def test_forward_and_expected_counts(monkeypatch, block):
    monkeypatch.setattr(hmm, "BLOCK", block)
    rng = np.random.default_rng(0)
    m = some_model(rng, 3, 5)
    texts = [rng.integers(0, 5, n) for n in (4, 1, 6, 3)]
    assert np.allclose(m.log_likelihood(texts), [math.log(brute(m, t)) for t in texts])
    start, moves, emit = m.expected(texts)
    s2, m2, e2 = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for t in texts:
        z = brute(m, t)
        for p in itertools.product(range(3), repeat=len(t)):
            w = math.prod([m.start[p[0]], *(m.trans[a, b] for a, b in itertools.pairwise(p)), *(m.emit[s, k] for s, k in zip(t, p))]) / z
            s2[p[0]] += w
            for a, b in itertools.pairwise(p):
                m2[a, b] += w
            for s, k in zip(t, p):
                e2[s, k] += w
    assert np.allclose(start, s2) and np.allclose(moves, m2) and np.allclose(emit, e2)


def test_documents(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op8_lm_scoring(spark, d).collect()}
    assert len(got) == len(docs)
    tokens = lambda t: t.encode().lower().split() + [None]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    c = Counter(w for i, t in docs.items() if not held[i] for w in tokens(t))
    n, v = sum(c.values()), len(c)
    gain = 0.0
    for i, t in docs.items():
        w = tokens(t)
        r = got[i]
        assert r.held_out == held[i] and r.n_tokens == len(w) and r.train_tokens == n and r.n_known == sum(x in c for x in w)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        if held[i]:
            gain += (r.score - r.base_score) / len(w)
    assert gain > 0.05 * sum(held.values())


def test_probabilities_add_up(spark, monkeypatch):
    """All texts of one known or unknown word and of none, and the rest of longer ones, make up at most 1; unknown words share one class."""
    monkeypatch.setattr(hmm, "HOT", 2)
    fit = spark.createDataFrame([(1, "a a a b b c"), (2, "a d"), (3, "")], "doc_id long, text string")
    ask = spark.createDataFrame([(i, w) for i, w in enumerate(["a", "b", "c", "d", "zzz"])] + [(9, None), (None, "A b"), (None, "A b"), (10, "a " * 30000)], "doc_id long, text string").withColumn("n_tokens", hmm.F.lit("x"))
    got = score_texts(ask, fit).collect()
    assert len(got) == 9
    short = sum(10**r.score for r in got if r.n_tokens == 2 and r.doc_id is not None) + sum(10**r.score for r in got if r.doc_id == 9)
    assert 0 < short < 1
    assert all(np.isfinite(r.score) for r in got)
    none = score_texts(ask, fit.limit(0)).collect()
    assert all(r.score == r.base_score for r in none)
    assert score_texts(ask.limit(0), fit).count() == 0


def test_long_words_and_long_texts():
    words = hmm.words_of(b"A " + b"x" * 1000 + b" b")
    assert words[0] == b"a" and words[2] == b"b" and words[1][:1] == b" " and len(words[1]) == 17
    m = some_model(np.random.default_rng(1), 3, 5)
    text = np.random.default_rng(2).integers(0, 5, 50_000)
    assert np.isclose(m.log_likelihood([text])[0], m._stepped([text])[0])
    start, moves, emit = m.expected([text, text[:3]])
    assert np.isclose(start.sum(), 2) and np.isclose(moves.sum(), 49_999 + 2) and np.isclose(emit.sum(), 50_003)


def test_texts_are_scored_in_parts_of_bounded_bytes():
    """However many rows a batch has, only a few MB of its texts are scored together, and rare words keep their numbers."""
    from types import SimpleNamespace

    import pyarrow as pa

    vocab = hmm.Vocabulary([(b"a", 5), (b"b", 3)], 2, 10, 4)
    model, sizes, held = hmm.HiddenMarkov.random(vocab.unigram, 2, 1), [], {}
    spy = SimpleNamespace(log_likelihood=lambda seqs: sizes.append(sum(map(len, seqs))) or model.log_likelihood(seqs))
    src = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x))))
    src.select = lambda *_: src
    src.mapInArrow = lambda run, _: held.update(run=run)
    hmm._scored(src, vocab, spy)
    texts = [b"a b rare other rare " * 200] * 1500 + [None, b""]
    out = pa.Table.from_batches(held["run"](iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.binary())], names=["doc", "text"])])))
    assert max(sizes) <= 600_000 and sum(sizes) == 1500 * 1001 + 2
    assert out["rare"].to_pylist() == [[{"word": b"rare", "n": 400}, {"word": b"other", "n": 200}]] * 1500 + [[], []]
    assert out["n_tokens"].to_pylist() == [1001] * 1500 + [1, 1]
