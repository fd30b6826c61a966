"""Approximate nearest neighbours by multi-index hashing.

A rotation learned on a bounded sample (principal axes, then iterative quantization) turns vectors into binary codes.  Candidates
are dealt into blocks; each block indexes every substring of its codes.  With a Hamming radius r over m substrings, any code
within r agrees with the query up to r // m bits in one of them (pigeonhole), so probing all substring values that near
retrieves every code within r; these are reranked by exact distances of the original vectors.  The radius is the ``COVER``
quantile of the distances at which the sample's true neighbours lie.  Queries that find fewer than k are searched again with the
full radius, which is exhaustive.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanweave.llm.common import materialize, table

SAMPLE = 8192  # vectors the rotation and the radius are learned on, about: those with small hashes of their ids, all if there are fewer
PROBES = 128  # of them used as queries for the radius
MAX_BITS, SUB_BITS = 64, 8
COVER = 0.985
CANDIDATES, QUERIES_A_BLOCK = 32_768, 4096  # rows of a block
EVERY = 100


class Coder:
    """Mean, rotation (dims x bits) and radius."""

    def __init__(self, mean: np.ndarray, rotation: np.ndarray, radius: int):
        self.mean, self.rotation, self.radius = mean, rotation, radius
        self.bits = rotation.shape[1]
        self.subs = -(-self.bits // SUB_BITS)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Substrings of the codes, one byte each (vectors x substrings)."""
        return np.packbits((x - self.mean) @ self.rotation > 0, axis=1)


def learn(x: np.ndarray, k: int, seed: int = 1) -> Coder:
    """Rotation by 30 rounds of iterative quantization after a projection on the leading principal axes; radius from true neighbours within the sample."""
    rng = np.random.Generator(np.random.PCG64(seed))
    mean, bits = x.mean(0), min(MAX_BITS, x.shape[1])
    y = x - mean
    _, axes = np.linalg.eigh(y.T @ y)
    axes = axes[:, ::-1][:, :bits]
    v = y @ axes
    r = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(30):
        u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    out = Coder(mean, axes @ r, bits)
    different = np.unique(x, axis=0)
    different = different[rng.permutation(len(different))]
    codes, far = out.codes(different), []
    for i in range(min(PROBES, len(different))):
        d = ((different - different[i]) ** 2).sum(1)
        d[i] = np.inf
        near = np.argsort(d, kind="stable")[: min(k, len(different) - 1)]
        far += hamming(codes[near], codes[i]).tolist()
    if far:
        out.radius = int(np.ceil(np.quantile(far, COVER)))
    return out


ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def hamming(codes: np.ndarray, one: np.ndarray) -> np.ndarray:
    return ONES[codes ^ one].sum(1, dtype=np.int64)


class BlockIndex:
    """For each substring, the rows by its value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(c, kind="stable") for c in codes.T]
        self.bound = [np.searchsorted(c[o], np.arange(257)) for c, o in zip(codes.T, self.order, strict=True)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes lie within the radius, all of them."""
        m = len(self.order)
        own, more = divmod(radius, m)  # the first more + 1 substrings are probed up to own bits, the others up to one less
        hit = np.zeros(len(self.codes), bool)
        for j in range(m):
            limit = own if j <= more else own - 1
            if limit >= 0:
                for v in np.flatnonzero(ONES[np.arange(256) ^ int(code[j])] <= limit):
                    hit[self.order[j][self.bound[j][v] : self.bound[j][v + 1]]] = True
        rows = np.flatnonzero(hit)
        return rows[hamming(self.codes[rows], code) <= radius]


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): vectors that take part; rows of one id are one vector, the least."""
    x = F.col(vector_col).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return df.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull() & ~bad & F.exists("x", lambda v: v != 0)).groupBy("id").agg(F.min("x").alias("x"))


def _matrix(col: pa.ChunkedArray, dims: int) -> np.ndarray:
    return np.array(col.combine_chunks().flatten()).reshape(-1, dims)


def search(vectors: DataFrame, queries: DataFrame, coder: Coder, dims: int, k: int, radius: int, n_vectors: int, n_queries: int) -> DataFrame:
    """(query_id, vec_id, score): the k nearest found of each query; both inputs have (id, x).

    Blocks of candidates meet blocks of queries; each pair of blocks is one group of bounded size.
    """
    shipped = vectors.sparkSession.sparkContext.broadcast(coder)
    blocks, rounds = max(1, -(-n_vectors // CANDIDATES)), max(1, -(-n_queries // QUERIES_A_BLOCK))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = vectors.withColumn("b", own(blocks)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    right = queries.withColumn("q", own(rounds)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(cands: pa.Table, asks: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if cands.num_rows and asks.num_rows:
            c = shipped.value
            ids, x = cands["id"].to_numpy(), _matrix(cands["x"], dims)
            index, who, y = BlockIndex(c.codes(x)), asks["id"].to_numpy(), _matrix(asks["x"], dims)
            for i, code in enumerate(c.codes(y)):
                rows = index.within(code, radius)
                rows = rows[ids[rows] != who[i]]
                d = np.sqrt(((x[rows] - y[i]) ** 2).sum(1))
                best = np.lexsort((ids[rows], d))[:k]
                out.append((np.full(len(best), who[i]), ids[rows[best]], d[best]))
        cols = [np.concatenate(v) for v in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    found = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(df: DataFrame, k: int = 10, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of every row whose id is divisible by ``every``, by Euclidean distance in double precision.

    Vectors that are null or zero, hold null or non-finite components or have another length than the most frequent one (the longer of equals) take no
    part: distances between different lengths are not defined; rows of one id are one vector; fewer candidates than k are all returned.  Other columns are not read.
    """
    vectors = materialize(usable(df, id_col, vector_col), "vectors")
    lengths = vectors.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n")).agg(F.max_by("dims", F.struct("n", "dims")).alias("dims"), F.max("n").alias("n")).first()
    if not lengths["n"]:
        return vectors.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    dims = lengths["dims"]
    vectors = vectors.where(F.size("x") == dims)
    few = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1 << 32)) < F.lit(int(min(1.0, SAMPLE / lengths["n"]) * (1 << 32)))
    sample = sorted((r["id"], r["x"]) for r in vectors.where(few).collect())
    coder = learn(np.array([x for _, x in sample], np.float64) if sample else np.zeros((1, dims)), k)
    queries = vectors.where(F.col("id") % every == 0)
    n, asked = vectors.count(), queries.count()
    first = materialize(search(vectors, queries, coder, dims, k, coder.radius, n, asked), "found")
    wanted = min(k, n - 1)
    full = first.groupBy("query_id").count().where(F.col("count") >= wanted).select(F.col("query_id").alias("id"))
    short = materialize(queries.join(full, "id", "left_anti"), "short")
    missing = short.count() if wanted else 0
    if missing:
        again = search(vectors, short, coder, dims, k, coder.bits, n, missing)
        first = first.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").select("query_id", "vec_id", "score", "rank").union(again.select("query_id", "vec_id", "score", "rank"))
    return first.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every hundredth one."""
    return nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {"op3_nearest_neighbours": op3_nearest_neighbours}
ORACLE_SQL: dict[str, str] = {}
