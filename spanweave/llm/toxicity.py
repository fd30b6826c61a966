"""Toxicity with a linear-chain conditional random field.

Document labels become token labels: in a toxic document, a token is toxic if one of its features (the word, its first 4, 5 or 6
letters) is far likelier in toxic than in clean documents.  A two-state chain is trained on whole texts by gradient ascent on the
conditional likelihood, with forward-backward for the expectations.  Scoring runs forward-backward over every whole text; token
marginals aggregate to a document's score through a fitted logistic curve and, where they pass 1/2, to offending offsets.

What is counted over the labelled sample (feature frequencies, aggregates for the curve) is counted on the executors; the
driver holds features, the few texts of the chain's fit as numbers, and three numbers a row for the curve.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm.common import held_remainder, materialize, slices, table
from spanweave.llm.shingles import shingle_set

SAMPLE = 4000  # labelled rows of each class (about, by a hash of the id) that features and the curve are fitted on
FIT = 1000  # of them (about) the chain's weights are fitted on, whole texts
COMMON, ODDS, STRONG = 0.004, 1.5, 2.5  # a feature's least share of toxic rows and log odds; log odds that label a token
SURE = 2.0  # log odds in standard errors, at least: chance features of long texts stay out
BLOCK = 64  # tokens that are stepped through together; a matter of speed, chains are whole texts
HELD_MODULUS, HELD_REMAINDER = 4, 2
THRESHOLD = 0.3

TOKEN = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """The word itself and its beginnings."""
    return [word, *(f"{word[:n]}-" for n in (4, 5, 6) if len(word) > n)]


def lowered(text: str) -> str:
    """Lower case with every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def forward_backward(u: np.ndarray, size: np.ndarray, trans: np.ndarray, start: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of state 1, expected transitions (2 x 2, all chains) and log partition of chains of any length, exactly.

    ``u``: potentials of state 1 over state 0, chain after chain; ``size``: tokens of each chain.  Chains are cut into blocks whose
    transfer matrices are found side by side; messages pass from block to block, then through all blocks side by side.
    """
    t, s = np.exp(trans), np.exp(start)
    blocks = -(-size // block)  # of each chain
    head = np.cumsum(blocks) - blocks
    n = int(blocks.sum())
    if not n:
        return np.empty(0), np.zeros((2, 2)), np.zeros(len(size))
    at = np.arange(len(u)) - np.repeat(np.cumsum(size) - size, size)
    col, row = np.repeat(head, size) + at // block, at % block
    e, on = np.ones((block, n)), np.zeros((block, n), bool)
    e[row, col], on[row, col] = np.exp(np.clip(u, -30, 30)), True
    # q: product of D(e) T D(e) ... D(e) over a block, scaled; q[i][j] from state i before to state j at its last token
    q = [[np.ones(n), np.zeros(n)], [np.zeros(n), e[0].copy()]]
    grown = np.zeros(n)
    for k in range(1, block):
        go = on[k]
        new = [[x[0] * t[0, 0] + x[1] * t[1, 0], (x[0] * t[0, 1] + x[1] * t[1, 1]) * e[k]] for x in q]
        z = new[0][0] + new[0][1] + new[1][0] + new[1][1]
        q = [[np.where(go, new[i][j] / z, q[i][j]) for j in (0, 1)] for i in (0, 1)]
        grown += np.where(go, np.log(z), 0)
    # messages into blocks from the left (states of the first token) and from the right (seen from the last token)
    into, beyond, log_z = np.empty((2, n)), np.ones((2, n)), np.zeros(len(size))
    live = np.flatnonzero(blocks > 0)
    into[:, head[live]] = s[:, None]
    for k in range(int(blocks.max())):
        live = live[blocks[live] > k]
        j = head[live] + k
        a = [into[0, j] * q[0][i][j] + into[1, j] * q[1][i][j] for i in (0, 1)]
        z = a[0] + a[1]
        log_z[live] += np.log(z) + grown[j]
        more = blocks[live] > k + 1
        for i in (0, 1):
            into[i, j[more] + 1] = (a[0][more] * t[0, i] + a[1][more] * t[1, i]) / z[more]
    for k in range(int(blocks.max()) - 1, 0, -1):
        j = head[blocks > k] + k
        c = [q[i][0][j] * beyond[0, j] + q[i][1][j] * beyond[1, j] for i in (0, 1)]
        z = c[0] + c[1]
        for i in (0, 1):
            beyond[i, j - 1] = (t[i, 0] * c[0] + t[i, 1] * c[1]) / z
    # through all blocks side by side
    a0, a1 = np.empty((block, n)), np.empty((block, n))
    p, pairs = np.empty((block, n)), np.zeros((2, 2))
    x0, x1 = into[0], into[1] * e[0]
    for k in range(block):
        if k:
            x0, x1 = a0[k - 1] * t[0, 0] + a1[k - 1] * t[1, 0], (a0[k - 1] * t[0, 1] + a1[k - 1] * t[1, 1]) * e[k]
        z = x0 + x1
        a0[k], a1[k] = x0 / z, x1 / z
    last = np.minimum(block, size[np.repeat(np.arange(len(size)), blocks)] - block * (np.arange(n) - np.repeat(head, blocks))) - 1
    b0, b1 = beyond
    for k in range(block - 1, -1, -1):
        if k < block - 1:
            go = k < last
            f1 = e[k + 1] * b1
            if go.any():  # expected transitions between k and k + 1
                _add_pairs(pairs, a0[k][go], a1[k][go], t, b0[go], f1[go])
            c0, c1 = t[0, 0] * b0 + t[0, 1] * f1, t[1, 0] * b0 + t[1, 1] * f1
            z = c0 + c1
            b0, b1 = np.where(go, c0 / z, beyond[0]), np.where(go, c1 / z, beyond[1])
        m1 = a1[k] * b1
        p[k] = m1 / (a0[k] * b0 + m1)
    inner = np.ones(n, bool)
    inner[head[blocks > 0]] = False
    j = np.flatnonzero(inner)  # expected transitions over the borders of blocks
    if len(j):
        c = [q[i][0][j] * beyond[0, j] + q[i][1][j] * beyond[1, j] for i in (0, 1)]
        _add_pairs(pairs, a0[block - 1, j - 1], a1[block - 1, j - 1], t, c[0], c[1])
    return p[row, col], pairs, log_z


def _add_pairs(pairs: np.ndarray, a0: np.ndarray, a1: np.ndarray, t: np.ndarray, r0: np.ndarray, r1: np.ndarray) -> None:
    w = [[a0 * t[0, 0] * r0, a0 * t[0, 1] * r1], [a1 * t[1, 0] * r0, a1 * t[1, 1] * r1]]
    z = w[0][0] + w[0][1] + w[1][0] + w[1][1]
    for i in (0, 1):
        for j in (0, 1):
            pairs[i, j] += (w[i][j] / z).sum()


class ToxicModel:
    """Weights of the chain and of the document curve; small enough to broadcast (a feature stands in ``COMMON`` of the sample's toxic rows at least)."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.bias, self.trans, self.start = -6.0, np.zeros((2, 2)), np.zeros(2)
        self.curve, self.offset = np.zeros(3), 0.0
        self._known: dict[str, float] = {}

    def potential(self, word: str) -> float:
        """How much the word speaks for the toxic state."""
        v = self._known.get(word)
        if v is None:
            if len(self._known) > 100_000:
                self._known.clear()
            get = self.weights.get
            v = self._known[word] = self.bias + sum(get(f, 0.0) for f in features(word))
        return v

    def marginals(self, texts: list[str]) -> list[np.ndarray]:
        """Toxic marginal of each token of each text."""
        known, slow, flat, counts = self._known.get, self.potential, [], []
        for text in texts:
            words = TOKEN.findall(lowered(text))
            counts.append(len(words))
            flat.extend([v if (v := known(w)) is not None else slow(w) for w in words])
        p = forward_backward(np.array(flat), np.array(counts, np.int64), self.trans, self.start)[0]
        return np.split(p, np.cumsum(counts)[:-1])

    def aggregate(self, p: np.ndarray) -> list[float]:
        """What the document curve sees of a text's marginals: largest, expected number, share."""
        return [float(p.max()), math.log1p(float(p.sum())), float(p.mean())] if len(p) else [0.0, 0.0, 0.0]

    def score(self, p: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.offset + float(np.dot(self.curve, self.aggregate(p)))))))

    def spans(self, text: str, p: np.ndarray) -> list[tuple[int, int]]:
        """Offsets (code points, end exclusive) of maximal runs of tokens that are rather toxic than not."""
        out: list[list[int]] = []
        if not len(p) or p.max() < 0.5:
            return []
        before = False
        for m, x in zip(TOKEN.finditer(lowered(text)), p, strict=True):
            if x >= 0.5:
                if before:
                    out[-1][1] = m.end()
                else:
                    out.append([m.start(), m.end()])
            before = x >= 0.5
        return [tuple(x) for x in out]


def choose_features(counts: list[tuple[str, int, int]], clean: int, toxic: int) -> dict[str, float]:
    """Log odds of the features that speak for toxic rows; ``counts``: (feature, clean rows, toxic rows)."""
    odds = {f: (math.log((n1 + 0.5) / (toxic + 1)) - math.log((n0 + 0.5) / (clean + 1)), math.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))) for f, n0, n1 in counts if n1 >= max(3, COMMON * toxic)}
    return {f: v for f, (v, error) in sorted(odds.items()) if v > ODDS and v > SURE * error}


def numbered(text: str, y: int, index: dict[str, int], strong: set[str]) -> tuple[int, list[int], list[int], list[int]]:
    """A text as the chain's fit reads it: tokens, (place, feature) pairs, and the places of tokens labelled toxic."""
    words, places, feats, hot = TOKEN.findall(lowered(text)), [], [], []
    for i, w in enumerate(words):
        own = features(w)
        for f in own:
            if f in index:
                places.append(i)
                feats.append(index[f])
        if y and any(f in strong for f in own):
            hot.append(i)
    return len(words), places, feats, hot


def fit_chain(m: ToxicModel, index: dict[str, int], chains: list[tuple[int, list[int], list[int], list[int]]], steps: int = 80) -> None:
    """Weights of the chain by gradient ascent (Adam) on ``chains`` of ``numbered``; nothing changes if no token is toxic."""
    chains = [c for c in chains if c[0]]
    if not any(c[3] for c in chains):
        return
    size = np.array([c[0] for c in chains])
    first = np.cumsum(size) - size
    total, k = int(size.sum()), len(index)
    at = np.concatenate([first[j] + np.array(c[1], np.int64) for j, c in enumerate(chains)])
    feat = np.concatenate([np.array(c[2], np.int64) for c in chains])
    y = np.zeros(total, np.int64)
    y[np.concatenate([first[j] + np.array(c[3], np.int64) for j, c in enumerate(chains)])] = 1
    inner = np.ones(total, bool)
    inner[first] = False
    moves = np.bincount(2 * y[:-1][inner[1:]] + y[1:][inner[1:]], minlength=4)
    seen = np.concatenate([np.bincount(feat, y[at], k), [y.sum()], moves, np.bincount(y[first], minlength=2)]).astype(float)
    theta = np.zeros(k + 7)  # features, bias, 2 x 2 transitions, 2 starts
    theta[k] = -4.0
    mean, var, rows = np.zeros(k + 7), np.zeros(k + 7), total / BLOCK
    for step in range(1, steps + 1):
        u = theta[k] + np.bincount(at, theta[feat], total)
        p, pairs, _ = forward_backward(u, size, theta[k + 1 : k + 5].reshape(2, 2), theta[k + 5 :])
        expected = np.concatenate([np.bincount(feat, p[at], k), [p.sum()], pairs.ravel(), [(1 - p[first]).sum(), p[first].sum()]])
        grad = (seen - expected) / rows - 1e-4 * theta
        mean, var = 0.9 * mean + 0.1 * grad, 0.99 * var + 0.01 * grad**2
        theta += 0.25 * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-8)
    m.weights = {f: float(theta[i]) for f, i in index.items()}
    m.bias, m.trans, m.start = float(theta[k]), theta[k + 1 : k + 5].reshape(2, 2), theta[k + 5 :]


def fit_curve(m: ToxicModel, aggregates: list[list[float]], labels: list[int], prior: tuple[float, float]) -> None:
    """Document curve: logistic regression on the aggregates, classes weighted to their shares."""
    x, label = np.c_[np.array(aggregates), np.ones(len(labels))], np.array(labels, float)
    weight = np.where(label == 1, prior[1] / label.sum(), prior[0] / (1 - label).sum())
    weight, w = weight / weight.mean(), np.array([0.0, 0.0, 0.0, m.offset])
    for _ in range(25):  # Newton steps with a small ridge
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(4)
        w = w + np.linalg.solve(h, x.T @ (weight * (label - q)) - 0.05 * w)
    m.curve, m.offset = w[:3], float(w[3])


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, clean rows, toxic rows) of rows (t, y), added up within bounded numbers of features."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> pa.RecordBatch:
        names = list(seen[0].keys() | seen[1].keys())
        rows = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in seen)], names=["f", "n0", "n1"])
        for c in seen:
            c.clear()
        return rows

    for batch in batches:
        for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            seen[y].update({f for w in set(TOKEN.findall(lowered(text.as_py()))) for f in features(w)})
            if len(seen[0]) + len(seen[1]) > 200_000:
                yield out()
    if seen[0] or seen[1]:
        yield out()


def _with_likeness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, y, like) of rows (i, y, t); ``like``: least hash of the text's 5-word shingles, which near copies mostly share."""
    for batch in batches:
        for part in slices(batch, 2):
            least = [int(h[0].view(np.int64)) if len(h := shingle_set(t.encode())) else 0 for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(2), part.column(1), pa.array(least, pa.int64())], names=["t", "y", "like"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicModel:
    """Fit on labelled rows that are not held out: about ``SAMPLE`` of each class, those with small hashes of their ids, all if there are fewer.

    Null labels and ids are not used; of contradicting labels the larger counts; of several texts of an id the least is taken,
    and one of texts with the same least shingle hash (copies would make any of their words look toxic); null texts are empty.  Without rows of both classes nothing is learned
    and every score is the smoothed share of toxic rows.
    """
    m, spark = ToxicModel(), docs.sparkSession
    own = labels.where(held_remainder(F.col(id_col), HELD_MODULUS) != HELD_REMAINDER).groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).cast("int").alias("y")).where("y in (0, 1)")
    own = materialize(own, "labels")
    counts = {r["y"]: r["count"] for r in own.groupBy("y").count().collect()}
    prior = (counts.get(0, 0), counts.get(1, 0))
    m.offset = math.log((prior[1] + 0.5) / (prior[0] + 0.5))
    if not all(prior):
        return m
    small = lambda key, salt, share: F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 32)) < F.lit(int(min(1.0, share) * (1 << 32)))
    ids = own.where(F.when(F.col("y") == 1, small("i", 11, SAMPLE / prior[1])).otherwise(small("i", 11, SAMPLE / prior[0])))  # about 2 * SAMPLE rows
    found = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(ids), "i").groupBy("i", "y").agg(F.min("t").alias("t"))
    kept = found.mapInArrow(_with_likeness, "t string, y int, like long").groupBy("y", "like").agg(F.min("t").alias("t"))
    rows = materialize(kept.select("t", "y"), "fit")
    have = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(have) < 2:
        return m
    sums = rows.mapInArrow(_feature_rows, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    floor = F.log((F.col("n1") + 0.5) / (have[1] + 1)) - F.log((F.col("n0") + 0.5) / (have[0] + 1)) > ODDS
    odds = choose_features([tuple(r) for r in sums.where((F.col("n1") >= max(3, COMMON * have[1])) & floor).collect()], have[0], have[1])
    index, strong = {f: i for i, f in enumerate(odds)}, {f for f, v in odds.items() if v > STRONG}
    shipped = spark.sparkContext.broadcast((index, strong))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sure = shipped.value
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                n, *lists = numbered(text.as_py(), y, known, sure)
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *(pa.array([x], pa.list_(pa.int32())) for x in lists)], names=["n", "places", "feats", "hot"])

    some = rows.where(F.when(F.col("y") == 1, small("t", 5, FIT / have[1])).otherwise(small("t", 5, FIT / have[0])))  # about 2 * FIT rows
    chains = sorted(tuple(r) for r in some.mapInArrow(number, "n int, places array<int>, feats array<int>, hot array<int>").collect())
    fit_chain(m, index, chains)
    model = spark.sparkContext.broadcast(m)

    def aggregate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                got = [model.value.aggregate(p) for p in model.value.marginals(part.column(0).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(got, pa.list_(pa.float64()))], names=["y", "x"])

    seen = sorted((r["y"], r["x"]) for r in rows.mapInArrow(aggregate, "y int, x array<double>").collect())
    fit_curve(m, [x for _, x in seen], [y for y, _ in seen], prior)
    return m


def score(df: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """(id, score and, if asked, spans: array of start and end offsets of offending text) for every row.

    Null texts count as empty and get the score of no evidence.  Null and repeated ids pass through.  Other columns are not read.
    """
    shipped = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            for part in slices(batch, 1):
                texts = [t or "" for t in part.column(1).to_pylist()]
                ps = m.marginals(texts)
                cols = [part.column(0), pa.array([m.score(p) for p in ps], pa.float64())]
                if spans:
                    cols.append(pa.array([[{"start": a, "end": b} for a, b in m.spans(t, p)] for t, p in zip(texts, ps, strict=True)], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
                yield pa.RecordBatch.from_arrays(cols, names=["__id", "score", "spans"][: len(cols)])

    schema = f"__id {kind}, score double" + ", spans array<struct<start: int, end: int>>" * spans
    return df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(run, schema).withColumnRenamed("__id", id_col)


def without_toxic(df: DataFrame, model: ToxicModel, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns as they are, whose text scores below the threshold; null texts count as empty."""
    shipped = df.sparkSession.sparkContext.broadcast(model)
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            for part in slices(batch, place):
                clean = [m.score(p) < threshold for p in m.marginals([t or "" for t in part.column(place).to_pylist()])]
                yield part.filter(pa.array(clean, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the rows that are not held out, and the offsets of offending text."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")), spans=True)
    held = F.coalesce(held_remainder(F.col("doc_id"), HELD_MODULUS) == HELD_REMAINDER, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLE_SQL: dict[str, str] = {}
