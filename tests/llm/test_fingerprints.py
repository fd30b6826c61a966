import hashlib
import random

import numpy as np

from spanweave.llm import fingerprints as fp


def words(t):
    w = t.encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    x, y = words(a), words(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(fp, "ROWS_A_RANGE", 7)
    monkeypatch.setattr(fp, "COARSE", 4)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [(-5, ""), (10**15, None), (10**15 + 1, "a b c")]
    got = {r.doc_id: r for r in fp.with_edited(spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, place string").repartition(6)).collect()}
    order = sorted(docs, reverse=True)
    errors = []
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n, r = t or "", n or "", got[i]
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        errors += [abs(r.near_edited - jaccard(t, e)), abs(r.near_next - jaccard(t, n))]
        assert r.fingerprint == fp.to_text(fp.sketch(t.encode())) and r.edited_fingerprint == fp.to_text(fp.sketch(e.encode()))
    assert len(got) == len(docs) and np.mean(errors) < 0.03 and max(errors) < 0.3


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "x"), (1, "y"), (1, "y")], "doc_id long, text string")
    got = fp.with_edited(df).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "1", "None"]
    one = fp.with_edited(df.limit(1)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fp.with_edited(df.limit(0)).count() == 0


def test_merging_and_estimates(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(5000)]
    a = " ".join(rng.choice(vocab) for _ in range(4000))
    b = " ".join(a.split()[1000:] + [rng.choice(vocab) for _ in range(1000)])
    x, y = fp.sketch(a.encode()), fp.sketch(b.encode())
    assert abs(fp.resemblance(x, y) - jaccard(a, b)) < 0.2
    assert abs(fp.distinct(x) / len(words(a)) - 1) < 0.4
    part = " ".join(a.split()[:2000])
    assert fp.containment(fp.sketch(part.encode()), x) > 0.7
    df = spark.createDataFrame([(1, fp.to_text(x)), (1, fp.to_text(y)), (2, ""), (2, None), (3, fp.to_text(x))], "g int, fingerprint string")
    got = {r.g: r.fingerprint for r in fp.merge_fingerprints(df, "g").collect()}
    assert got == {1: fp.to_text(fp.merge(x, y)), 2: "", 3: fp.to_text(x)}
    assert np.array_equal(fp.from_text(fp.to_text(x)), x)
    rows = fp.fingerprints(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id int, text string")).collect()
    assert {r.doc_id: r.n_distinct for r in rows} == {1: 1.0, 2: 0.0}
