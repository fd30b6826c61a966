import random

import numpy as np
import pytest

from spanweave.llm.line_dedup import MIN_WORDS, dedup_lines, deletion_keys, within_one_edit


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(docs, MIN_WORDS=MIN_WORDS):
    first = {}
    for i, t in sorted((i, t) for i, t in docs.items()):
        for k, line in enumerate((t or "").split("\n")):
            if line.split():
                first.setdefault(tuple(line.split()), (i, k))
    drop = {w for w, at in first.items() if len(w) >= MIN_WORDS and any(len(o) >= MIN_WORDS and abs(len(o) - len(w)) < 2 and first[o] < at and distance(w, o) <= 1 for o in first)}
    out = {}
    for i, t in docs.items():
        lines = (t or "").split("\n")
        out[i] = "\n".join(x for k, x in enumerate(lines) if not x.split() or tuple(x.split()) not in drop and first[tuple(x.split())] == (i, k))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [[f"w{rng.randrange(40)}" for _ in range(rng.choice([1, 2, 7, 8, 9, 10, 20]))] for _ in range(25)]
    docs = {}
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(6)):
            w = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 2])):
                at, what = rng.randrange(len(w)), rng.randrange(3)
                w[at : at + (what != 0)] = [] if what == 1 and len(w) > 1 else [f"w{rng.randrange(40)}"]
            lines.append(rng.choice([" ", "  "]).join(w))
        docs[i] = "\n".join([*lines, *[""] * rng.randrange(2)])
    docs[100], docs[101] = None, ""
    df = spark.createDataFrame([(i, t, "x") for i, t in docs.items()], "doc_id long, text string, nos string").repartition(5)
    got = {r.doc_id: r for r in dedup_lines(df).collect()}
    want = brute(docs)
    assert len(got) == len(docs)
    assert {i: r.text or "" for i, r in got.items()} == want
    assert got[100].text is None


def test_repeated_rows_and_null_ids(spark):
    line = "one two three four five six seven eight"
    rows = [(None, line), (1, line), (1, line), (2, line + " nine\nkeep this"), (3, "long " * 30000)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text[:60]) for r in got) == [("1", line), ("1", line), ("2", "keep this"), ("3", ("long " * 12)), ("None", line)]
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_deletion_keys():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 12).astype(np.uint64)
    gone, _ = deletion_keys(h)
    for i in range(12):
        assert gone[i] == deletion_keys(np.delete(h, i))[1]
    assert within_one_edit(h, np.delete(h, 4)) and within_one_edit(h, h) and not within_one_edit(h, np.delete(h, [1, 5]))


def test_short_lines_by_parameter(spark):
    rng = random.Random(5)
    docs = {i: "\n".join(" ".join(f"w{rng.randrange(5)}" for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(4))) for i in range(60)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for least in (2, 3, 4):
        assert {r.doc_id: r.text for r in dedup_lines(df, min_words=least).collect()} == brute(docs, least)
