import hashlib
import itertools
import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from spanweave.llm.sentencepiece_bpe import PieceModel, model_path, transcode

PATH = model_path()
OURS = PieceModel(open(PATH, "rb").read())
THEIRS = sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.mark.parametrize("text", ["", " ", "   ", "a", " a", "a  b\n\t c　d ▁x", "\n\n\nabc", "héllo \U0001f600\U0001f600 wörld", "x" * 5000, " " * 300, "ab" * 2000 + "  " * 40, "\x00\x01", "<s>[INST]</s><unk><0x41>", "aaaaaaaaaaaaaaaaaaa"])
def test_like_the_library(text):
    ids = THEIRS.encode(text)
    assert OURS.encode(text) == ids
    assert OURS.decode(ids) == THEIRS.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("etaoinshr  \n.,0123é中▁\U0001f600ABC"), max_size=60))
def test_random_texts(text):
    ids = THEIRS.encode(text)
    assert OURS.encode(text) == ids
    assert OURS.decode(ids) == THEIRS.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=12))
def test_random_ids(ids):
    assert OURS.decode(ids) == THEIRS.decode(ids)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in transcode(docs, PATH, outputs=("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")).collect()}
    for r in docs.collect():
        ids = THEIRS.encode(r.text)
        assert got[r.doc_id].ids == ids and got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].decoded == THEIRS.decode(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_odd_rows(spark):
    rows = [(None, None, 1), (1, "", 2), (1, "", 2), (2, "long " * 20000, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = transcode(df, PATH).collect()
    assert len(got) == 4 and sorted(r.n_tokens for r in got)[:3] == [0, 0, 0]
    assert transcode(df.limit(0), PATH).count() == 0


def test_small_memory():
    small = PieceModel(open(PATH, "rb").read(), memory=4)
    text = "the cat sat on the mat and the dog sat on the log " * 5
    assert small.encode(text) == THEIRS.encode(text)


def test_many_texts_at_once():
    rng = random.Random(4)
    alphabet = "abc the in  dé\nüß▁ 漢字\U0001f600\t.,1!?\x00"
    texts = ["", " ", "a", "x" * 5000, "the" * 300, "a  b", "word " * 2000] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(3000)]
    offsets, ids = OURS.encode_texts(texts)
    want = THEIRS.encode(texts)
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(offsets)] == want
    assert OURS.decode_texts(offsets, ids) == [THEIRS.decode(x) for x in want]
    assert OURS.id_digests(offsets, ids)[2] == hashlib.sha256(",".join(map(str, want[2])).encode()).hexdigest()
    assert [x.tolist() for x in OURS.encode_texts([])] == [[0], []]


def test_decode_of_any_ids_at_once():
    rng = random.Random(5)
    rows = [[rng.randrange(0, 400 if k % 2 else 32000) for _ in range(rng.randrange(15))] for k in range(500)]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    assert OURS.decode_texts(offsets, np.array([i for x in rows for i in x], np.int32)) == [THEIRS.decode(x) for x in rows]


def test_compatibility_is_that_of_the_merge_procedure():
    rng, ids = random.Random(6), list(OURS.id.values())
    short = [i for i in ids if len(OURS.names[i]) < 4]
    for n in range(20000):
        a, b = (rng.choice(ids), rng.choice(ids)) if n % 3 == 0 else (rng.choice(short), rng.choice(short))
        assert OURS.compatible(a, b) == (OURS._merged(OURS.names[a] + OURS.names[b]) == [OURS.names[a], OURS.names[b]])
