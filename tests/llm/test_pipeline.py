from collections import Counter, defaultdict

import pytest
import sentencepiece
from test_line_dedup import brute as brute_lines
from test_minhash import brute as brute_near
from test_mixing import brute_targets

import corpus_pipeline as cp
from spanweave.llm.sentencepiece_bpe import model_path
from spanweave.llm.toxicity import THRESHOLD, score, train

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{D}/documents.parquet").cache()


def test_stages_against_brute_force(spark, docs):
    rows = {r.doc_id: r for r in docs.collect()}
    labels = spark.read.parquet(f"{D}/labels.parquet")
    scores = {r.doc_id: r.score for r in score(docs, train(docs, labels)).collect()}
    clean = cp.toxicity(spark, docs, D)
    assert clean.schema == docs.schema
    assert Counter(clean.collect()) == Counter(r for r in rows.values() if scores[r.doc_id] < THRESHOLD)

    cut = cp.line_dedup(spark, docs, D)
    assert cut.columns == docs.columns
    want = {i: t for i, t in brute_lines({i: r.text for i, r in rows.items()}).items() if t.split() or not rows[i].text.split()}
    got = {r.doc_id: r for r in cut.collect()}
    assert {i: r.text for i, r in got.items()} == want and all(r.n_chars == len(r.text) and r.lang == rows[i].lang for i, r in got.items())

    one = cp.near_dedup(spark, docs, D)
    comp, _ = brute_near([(i, r.text) for i, r in rows.items()], 80)
    assert Counter(one.collect()) == Counter(r for i, r in rows.items() if comp[i] == i)

    mix = cp.mixing(spark, docs, D)
    taken, size, big = defaultdict(int), defaultdict(int), defaultdict(int)
    copies = Counter(mix.collect())
    for r in rows.values():
        n = len(r.text.split())
        size[r.source] += n
        big[r.source] = max(big[r.source], n)
        taken[r.source] += n * copies[r]
    assert set(copies) <= set(rows.values()) and max(copies.values()) <= 2
    assert all(abs(taken[s] - t) <= 2 * big[s] for s, t in brute_targets(size).items())

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    assert all(r.ids == sp.encode(rows[r.doc_id].text) for r in cp.sentencepiece(spark, docs, D).collect())


def test_odd_documents(spark):
    line = "some words that stand in more than one document of these"
    rows = [(1, line, "en", "a", 5), (1, line, "en", "a", 5), (2, None, None, None, None), (None, "x y", "en", "b", 3), (3, "", "en", "a", 0), (4, line + "\nown words here", "en", "b", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    cut = {(r.doc_id, r.text, r.n_chars) for r in cp.line_dedup(spark, df, D).collect()}
    assert cut == {(1, line, 56), (2, None, None), (None, "x y", 3), (3, "", 0), (4, "own words here", 14)}
    assert cp.near_dedup(spark, df, D).count() == 6
    assert all(v <= 4 for v in Counter(r.doc_id for r in cp.mixing(spark, df, D).collect()).values())
    for name, stage in cp.STAGES[1:]:
        assert stage(spark, df.limit(0), D).count() == 0, name


def test_run(spark):
    out = cp.run(spark, D)
    assert out.count() > 0 and "ids" in out.columns
