import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from spanweave.llm import suffix_dedup as sd
from spanweave.llm.keyfilter import key_filter
from spanweave.llm.suffix_dedup import common_prefixes, op10_suffix_array_dedup, remove_repeats, stretches, suffix_classes

W = sd.WINDOW


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + W] for b in raw for i in range(len(b) - W + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - W + 1):
            if seen[b[i : i + W]] > 1:
                gone[i : i + W] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return out


def compare(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ranges string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df, outputs=("n_bytes", "n_removed", "n_spans", "kept_sha256")).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def some_texts(seed):
    rng = random.Random(seed)
    w = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    p, q = w(230), w(700)
    texts = [w(rng.randrange(900)) for _ in range(12)] + [w(50) + p + w(300), w(301) + p, p + w(20) + q, q[100:400], q[90:290], q, q, w(100) + q[:199], None, "", "x" * 1000, "x" * 199, "ab" * 300]
    texts += [q[:350] + "Z" + q[351:], q[:349] + w(10) + q[349:]] + [w(40) + p + w(60) for _ in range(30)]
    return texts


@pytest.mark.parametrize(("hot", "sent"), [(4000, 65_536), (5, 65_536), (5, 0)])
def test_against_brute_force(spark, monkeypatch, hot, sent):
    monkeypatch.setattr(sd, "HOT", hot)
    monkeypatch.setattr(sd, "SENT", sent)
    monkeypatch.setattr(sd, "SHARD", 20)
    compare(spark, some_texts(hot))


def test_documents(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op10_suffix_array_dedup(spark, d).collect()}
    assert [got[r.doc_id] for r in docs] == brute([r.text for r in docs])


def test_repeated_rows_and_null_ids(spark):
    t = "word " * 10 + "".join(chr(97 + i * 7 % 26) for i in range(300))
    got = remove_repeats(spark.createDataFrame([(1, t), (1, t), (None, "short"), (None, None)], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("1", 350), ("1", 350), ("None", 0), ("None", 0)]
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_arrays():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 3, 3000).astype(np.uint8)
    text[1500:2200] = text[100:800]
    text[2300:2600] = 7
    starts = np.arange(len(text) - W + 1)
    order, new = suffix_classes(text, starts)
    strings = [text[i : i + W].tobytes() for i in order]
    assert strings == sorted(strings) and sorted(order) == list(starts)
    lcp = common_prefixes(text, order, W)
    for k in range(1, len(order)):
        a, b = strings[k - 1], strings[k]
        want = next((i for i in range(W) if a[i] != b[i]), W)
        assert min(lcp[k], W) == want and new[k] == (a != b)


def test_stretches_depend_on_the_string_only(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(97, 103, 5000).astype(np.uint8)
    g, a, b = stretches(data)
    assert a[0] == 0 and b[-1] == len(data) - W and (a[1:] == b[:-1] + 1).all()
    for i in range(0, len(data) - W, 97):
        assert stretches(data[i : i + W])[0][0] == g[np.searchsorted(a, i, "right") - 1]
    monkeypatch.setattr(sd, "STEP", 700)
    assert set(stretches(data)[0]) >= set(g)


def test_key_filter(spark):
    rng = np.random.default_rng(4)
    keys = rng.integers(-(2**63), 2**63 - 1, 20000)
    f = key_filter(spark.createDataFrame([(int(k),) for k in keys], "k long"))
    assert f.has(keys.view(np.uint64)).all()
    assert f.has(rng.integers(0, 2**63, 20000).astype(np.uint64)).mean() < 0.05


def test_periodic_text(spark):
    got = remove_repeats(spark.createDataFrame([(1, "abcdefg" * 30_000), (2, "own " * 10)], "doc_id long, text string"), outputs=("n_bytes", "n_removed")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in got) == [(1, 210_000, 210_000), (2, 40, 0)]
