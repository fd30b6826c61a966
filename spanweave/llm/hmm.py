"""Language-model scoring with a hidden Markov model trained by Baum-Welch.

Tokens are words and one end a text.  The commonest training words, at most ``HOT`` (a parameter), have emissions of their own in
each state; all others share one rare symbol, within which a word has its add-one share.  So the model is a proper distribution
over texts of known and unknown words.  Training: a pass in ``SHARDS`` steps, each over another share of all training texts, then
``PASSES`` passes over all of them.  Each step runs forward-backward over whole texts on the executors; expected counts are
summed across partitions, in slices of the vocabulary, and make the next model.  Scoring runs the scaled forward recursion over
every whole text, exactly.  Long texts are cut into blocks that messages pass through, which changes no result.

Counts of all words stay distributed: only the hot ones are broadcast; rare words of the texts meet their counts in a join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm.common import held_remainder, materialize, slices, table

STATES = 6
HOT = 40_000  # words with emissions of their own
BLOCK = 512  # tokens; longer texts are stepped through in blocks side by side
SHARDS, PASSES = 6, 2
LONG_WORD = 64  # bytes; longer words go by a 128-bit hash
PRIOR = 200.0  # pseudo-tokens a state has of the unigram distribution
SLICE = 2000
SCORED = 2 << 20  # bytes of texts scored together
HELD_MODULUS, HELD_REMAINDER = 7, 2


def words_of(text: bytes | None) -> list[bytes]:
    """Words, A-Z lower-cased; a very long one is a blank and its hash, so that no key is long."""
    words = (text or b"").lower().split()
    return words if not words or len(max(words, key=len)) <= LONG_WORD else [w if len(w) <= LONG_WORD else b" " + xxhash.xxh3_128_digest(w) for w in words]


def _by_step(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the rows, longest first; how many are active at each step; their symbols, step after step in that order)."""
    size = np.array([len(r) for r in rows], np.int64)
    order = np.argsort(-size, kind="stable")
    size, flat = size[order], np.concatenate([rows[i] for i in order]) if len(rows) else np.empty(0, np.int64)
    step = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    kind = np.int16 if len(size) and size[0] < 1 << 15 else np.int64  # narrow numbers sort faster
    return order, np.bincount(step), flat[np.argsort(step.astype(kind), kind="stable")]


def _blocks(text: np.ndarray) -> list[np.ndarray]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


class HiddenMarkov:
    """start (K), trans (K x K), emit (symbols x K); the last two symbols are the end and the rare one."""

    def __init__(self, start: np.ndarray, trans: np.ndarray, emit: np.ndarray):
        self.start, self.trans, self.emit = start, trans, emit
        self.by_state = np.ascontiguousarray(emit.T)

    @classmethod
    def random(cls, unigram: np.ndarray, states: int, seed: int) -> HiddenMarkov:
        rng = np.random.Generator(np.random.PCG64(seed))
        emit = unigram[:, None] * np.exp(rng.normal(0, 0.7, (len(unigram), states)))
        return cls(np.full(states, 1 / states), np.full((states, states), 0.1 / max(1, states - 1)) * (1 - np.eye(states)) + np.eye(states) * (0.9 if states > 1 else 1.0), emit / emit.sum(0))

    def _transfer(self, blocks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of each block the scaled products of emissions and transitions from its first to its last token (state by state), and the logs of their scales."""
        n, states = len(blocks), len(self.start)
        order, active, flat = _by_step(blocks)
        seen, at, turned = np.take(self.by_state, flat, axis=1), n, np.ascontiguousarray(self.trans.T)
        q = np.zeros((states, states, n))
        q[range(states), range(states)] = seen[:, :n]
        logs = np.zeros(n)
        for m in active[1:].tolist():
            new = np.matmul(turned, q[:, :, :m])
            new *= seen[:, at : at + m]
            z = new.sum((0, 1))
            np.divide(new, z, out=q[:, :, :m])
            logs[:m] += np.log(z)
            at += m
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        return np.moveaxis(q, 2, 0)[back], logs[back]

    def log_likelihood(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each symbol sequence: texts step together, longest first, so the active ones are a prefix; blocks of long ones side by side."""
        result = np.empty(len(texts))
        short = [i for i, t in enumerate(texts) if len(t) <= BLOCK]
        result[short] = self._stepped([texts[i] for i in short])
        long = [(i, _blocks(t)) for i, t in enumerate(texts) if len(t) > BLOCK]
        q_all, scales = self._transfer([b for _, own in long for b in own]) if long else ((), ())
        at = 0
        for i, own in long:
            a, total = self.start, 0.0
            at += len(own)
            for q, scale in zip(q_all[at - len(own) : at], scales[at - len(own) : at], strict=True):
                a = a @ q
                total += scale + math.log(a.sum())
                a = (a / a.sum()) @ self.trans
            result[i] = total
        return result

    def _stepped(self, texts: list[np.ndarray]) -> np.ndarray:
        order, active, flat = _by_step(texts)
        seen, turned = np.take(self.by_state, flat, axis=1), np.ascontiguousarray(self.trans.T)
        out, at, a = np.zeros(len(texts)), 0, np.repeat(self.start[:, None], len(texts), 1)
        for k, n in enumerate(active.tolist()):
            a = (turned @ a[:, :n] if k else a[:, :n]) * seen[:, at : at + n]
            z = a.sum(0)
            out[:n] += np.log(z)
            a /= z
            at += n
        result = np.empty_like(out)
        result[order] = out
        return result

    def _cut(self, texts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Blocks of the texts, the message into each and from beyond it, which of them begin a text, and expected transitions over their borders."""
        states, moves = len(self.start), np.zeros((len(self.start),) * 2)
        blocks: list[np.ndarray] = []
        into, beyond, begins = [], [], []
        cut = [_blocks(t) for t in texts]
        long = [b for own in cut if len(own) > 1 for b in own]
        q_all, at = self._transfer(long)[0] if long else None, 0
        for own in cut:
            blocks += own
            begins += [True] + [False] * (len(own) - 1)
            if len(own) == 1:
                into.append(self.start)
                beyond.append(np.ones(states))
                continue
            q, at = q_all[at : at + len(own)], at + len(own)
            a, left, ends = self.start, [], []
            for x in q:
                left.append(a)
                end = a @ x
                ends.append(end / end.sum())
                a = ends[-1] @ self.trans
            right = [np.ones(states)]
            for j in range(len(own) - 1, 0, -1):
                c = q[j] @ right[-1]
                pair = self.trans * ends[j - 1][:, None] * c
                moves += pair / pair.sum()
                r = self.trans @ c
                right.append(r / (ends[j - 1] @ r))
            into += left
            beyond += right[::-1]
        return blocks, np.array(into), np.array(beyond), np.array(begins), moves

    def expected(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected start, transition and emission counts of whole texts (scaled forward-backward)."""
        states = len(self.start)
        blocks, into, beyond, begins, borders = self._cut(texts)
        order, active, flat = _by_step(blocks)
        into, beyond, begins = into[order].T, np.ascontiguousarray(beyond[order].T), begins[order]
        # one row a state, so that every step works on long rows
        seen, ends, turned = np.take(self.by_state, flat, axis=1), np.cumsum(active), np.ascontiguousarray(self.trans.T)
        gamma, a = np.empty_like(seen), into
        for k, (n, end) in enumerate(zip(active.tolist(), ends.tolist(), strict=True)):
            here = seen[:, end - n : end]
            a = (turned @ a[:, :n] if k else a) * here
            z = a.sum(0)
            a /= z
            here /= z
            gamma[:, end - n : end] = a
        moves = np.zeros((states, states))
        b = beyond[:, : active[-1]]
        for k in range(len(active) - 1, -1, -1):
            n, end = int(active[k]), int(ends[k])
            if k < len(active) - 1:
                m = int(active[k + 1])
                w = seen[:, end : end + m] * b
                moves += gamma[:, end - n : end - n + m] @ w.T
                b = beyond[:, :n].copy()
                b[:, :m] = self.trans @ w
            gamma[:, end - n : end] *= b
        moves = moves * self.trans + borders
        emit = np.stack([np.bincount(flat, g, len(self.emit)) for g in gamma], 1)
        return gamma[:, : len(blocks)][:, begins].sum(1), moves, emit

    def updated(self, start: np.ndarray, moves: np.ndarray, emit: np.ndarray, unigram: np.ndarray) -> HiddenMarkov:
        """The next model; the unigram distribution is the emissions' prior, so no symbol loses all probability."""
        emit = emit + PRIOR * unigram[:, None]
        moves = moves + 0.1
        return HiddenMarkov((start + 0.1) / (start + 0.1).sum(), moves / moves.sum(1, keepdims=True), emit / emit.sum(0))


def _counted(src: DataFrame) -> DataFrame:
    """(word, n) over all texts; null is the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        ends = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for t in batch.column(0):
                seen.update(words_of(t.as_py()))
                if len(seen) > 300_000:
                    yield out()
                    seen.clear()
            ends += batch.num_rows
        if seen:
            yield out()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.array([ends], pa.int64())], names=["word", "n"])

    return src.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Hot words by symbol, their counts and the totals; bounded, so it can be broadcast."""

    def __init__(self, hot: list[tuple[bytes, int]], ends: int, total: int, distinct: int):
        self.symbol = {w: i for i, (w, _) in enumerate(hot)}
        self.counts = np.array([n for _, n in hot] + [ends], np.float64)
        self.end, self.rare = len(hot), len(hot) + 1
        self.total, self.distinct = total, distinct
        share = (self.counts + 1) / (total + distinct + 1)
        self.unigram = np.append(share, max(1e-300, 1 - share.sum()))
        # within the rare symbol a word has (c + 1) / rare_mass
        self.rare_mass = max(1.0, total + distinct + 1 - (self.counts + 1).sum())

    def symbols(self, words: list[bytes]) -> np.ndarray:
        get, rare = self.symbol.get, self.rare
        out = np.empty(len(words) + 1, np.int64)
        out[:-1] = np.fromiter((get(w, rare) for w in words), np.int64, len(words))
        out[-1] = self.end
        return out


def _sequences(src: DataFrame, shipped) -> DataFrame:
    """Symbols of each text as bytes of 16-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shipped.value
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([v.symbols(words_of(t.as_py())).astype(np.uint16).tobytes() for t in part.column(1)], pa.binary())], names=["order", "seq"])

    return src.select("order", "text").mapInArrow(run, "order long, seq binary")


def _expected(seqs: DataFrame, model: HiddenMarkov) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts over all sequences: partial sums a task, summed by vocabulary slice; the result has a fixed size."""
    shipped = seqs.sparkSession.sparkContext.broadcast(model)
    states, symbols = len(model.start), len(model.emit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, acc, held, size = shipped.value, None, [], 0

        def add() -> None:
            nonlocal acc, held, size
            if held:
                got = m.expected(held)
                acc = got if acc is None else tuple(x + y for x, y in zip(acc, got, strict=True))
            held, size = [], 0

        for batch in batches:
            for s in batch.column(0):
                held.append(np.frombuffer(s.as_py(), np.uint16).astype(np.int64))
                size += len(held[-1])
                if size > 400_000:
                    add()
        add()
        if acc is not None:
            head = np.concatenate([acc[0], acc[1].ravel()])
            parts = [head] + [acc[2][i : i + SLICE].ravel() for i in range(0, symbols, SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(parts) - 1), pa.int32()), pa.array([p.astype(np.float32).tobytes() if i else p.tobytes() for i, p in enumerate(parts)], pa.binary())], names=["slice", "sums"])

    def total(rows: pa.Table) -> pa.Table:
        k = rows["slice"][0].as_py()
        kind = np.float64 if k == -1 else np.float32
        out = sum(np.frombuffer(x.as_py(), kind).astype(np.float64) for x in rows["sums"])
        return pa.table({"slice": rows["slice"].slice(0, 1), "sums": pa.array([out.tobytes()], pa.binary())})

    got = {r["slice"]: np.frombuffer(r["sums"]) for r in seqs.select("seq").mapInArrow(run, "slice int, sums binary").groupBy("slice").applyInArrow(total, "slice int, sums binary").collect()}
    head = got.pop(-1)
    emit = np.concatenate([got[k] for k in sorted(got)]).reshape(symbols, states)
    return head[:states], head[states:].reshape(states, states), emit


def train(src: DataFrame, counts: DataFrame, hot: int | None = None) -> tuple[Vocabulary, HiddenMarkov]:
    """Vocabulary and model of the training rows (order, text); ``counts``: their materialized word counts.  Empty training data give the unigram model."""
    spark = src.sparkSession
    sums = counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("word").isNull(), F.col("n")))).first()
    # the hot words: all from the least count on at which at most ``hot`` qualify, found by bins of the count's logarithm
    short = counts.where("word is not null")
    bins = short.groupBy(F.floor(F.log2("n") * 16).alias("bin")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("bin")).collect()
    least, words = None, 0
    for r in bins:
        words += r["words"]
        if words > (HOT if hot is None else hot):
            break
        least = r["least"]
    top = sorted(((-r["n"], bytes(r["word"])) for r in short.where(F.col("n") >= least).collect())) if least else []
    vocab = Vocabulary([(w, -n) for n, w in top], sums[2] or 0, sums[0] or 0, sums[1] or 0)
    model = HiddenMarkov.random(vocab.unigram, STATES, 5)
    if not vocab.total:
        return vocab, model
    seqs = materialize(_sequences(src, spark.sparkContext.broadcast(vocab)), "sequences")
    shard = F.pmod(F.xxhash64("order", "seq", F.lit(3)), F.lit(SHARDS))
    for k in range(SHARDS):
        some = seqs.where(shard == k)
        if not some.isEmpty():
            model = model.updated(*_expected(some, model), vocab.unigram)
    for _ in range(PASSES):
        model = model.updated(*_expected(seqs, model), vocab.unigram)
    return vocab, model


def _scored(src: DataFrame, vocab: Vocabulary, model: HiddenMarkov) -> DataFrame:
    """Per text: hot part of the base, log10 probability of the symbols, tokens, known hot tokens, and its rare words with their numbers."""
    shipped = src.sparkSession.sparkContext.broadcast((vocab, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m = shipped.value
        hot = np.append(np.log10(v.counts + 1), 0.0)
        for batch in batches:
            for part in slices(batch, 1, SCORED):
                seqs, ends, rare, times = [], [0], [], []
                for t in part.column(1):
                    words = words_of(t.as_py())
                    s = v.symbols(words)
                    seqs.append(s)
                    seen = Counter(words[i] for i in np.flatnonzero(s == v.rare))
                    rare += seen
                    times += seen.values()
                    ends.append(len(rare))
                prob = m.log_likelihood(seqs) / math.log(10)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in seqs], pa.int64()),
                        pa.array([int((s < v.end).sum() + (v.counts[-1] > 0)) for s in seqs], pa.int64()),
                        pa.array([float(hot[s].sum()) for s in seqs], pa.float64()),
                        pa.array(prob, pa.float64()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int64())], names=["word", "n"])),
                    ],
                    names=["doc", "n_tokens", "hot_known", "hot_log", "symbols_log", "rare"],
                )

    return src.select("doc", "text").mapInArrow(run, "doc long, n_tokens long, hot_known long, hot_log double, symbols_log double, rare array<struct<word: binary, n: bigint>>")


def score_texts(df: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int | None = None) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row of ``df`` by a model of ``training`` (same columns).

    Null texts are empty: one end token.  Null and repeated ids are rows of their own.  With empty training data both scores are
    the base's.  Other columns are not read, so their names cannot clash.
    """
    shape = [F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("order"), F.col(text_col).cast("binary").alias("text")]
    src, fit_on = df.select(*shape), training.select(*shape)
    counts = materialize(_counted(fit_on), "counts")
    vocab, model = train(fit_on, counts, hot)
    rows = materialize(_scored(src, vocab, model).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    known = counts.where("word is not null").select("word", F.col("n").alias("c"))
    part = rare.join(known, "word", "left").groupBy("row").agg(F.sum("n").alias("rare_n"), F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("rare_known"), F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("rare_log"))
    out = rows.drop("rare").join(part, "row", "left")
    zero = F.lit(0)
    rare_log, rare_n = F.coalesce("rare_log", zero), F.coalesce("rare_n", zero)
    base = F.col("hot_log") + rare_log - F.col("n_tokens") * math.log10(vocab.total + vocab.distinct + 1)
    score = F.col("symbols_log") + rare_log - rare_n * math.log10(vocab.rare_mass) if vocab.total else base
    return out.select(F.col("doc").alias(id_col), "n_tokens", (F.col("hot_known") + F.coalesce("rare_known", zero)).cast("long").alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(held_remainder(F.col("doc_id"), HELD_MODULUS) == HELD_REMAINDER, F.lit(False))
    out = score_texts(docs, docs.where(~held))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op8_lm_scoring": op8_lm_scoring}
ORACLE_SQL: dict[str, str] = {}
