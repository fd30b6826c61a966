"""Document fingerprints: the ``K`` smallest of a text's distinct shingle hashes.

The sketch of a union is the ``K`` smallest hashes of the parts' sketches, so parts merge in any order.  Two sketches estimate
resemblance and containment, one estimates the number of distinct shingles; sets with fewer than ``K`` shingles are kept whole
and give exact values.  Written as 12 hexadecimal digits a hash, in ascending order.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanweave.llm.common import table
from spanweave.llm.shingles import shingle_set

K = 64
BITS = 48
ROWS_A_RANGE, MAX_RANGES, COARSE = 2000, 4096, 64


def sketch(text: bytes | None) -> np.ndarray:
    """Bottom-``K`` sketch of a text's 5-word shingles."""
    return np.unique(shingle_set(text)[: K + 8] >> np.uint64(64 - BITS))[:K]  # a few spare ones, as cut hashes can coincide


def merge(*parts: np.ndarray) -> np.ndarray:
    """Sketch of the union."""
    return np.unique(np.concatenate(parts))[:K]


def resemblance(x: np.ndarray, y: np.ndarray) -> float:
    """Estimated intersection over union; two empty sets are alike."""
    both = merge(x, y)
    if not len(both):
        return 1.0
    return float(np.isin(np.intersect1d(x, y), both).sum() / len(both))


def distinct(x: np.ndarray) -> float:
    """Estimated number of distinct shingles, exact below ``K``."""
    return float(len(x)) if len(x) < K else (K - 1) * 2.0**BITS / (float(x[-1]) + 1)


def containment(x: np.ndarray, y: np.ndarray) -> float:
    """Estimated share of ``x``'s shingles that ``y`` has."""
    if not len(x):
        return 1.0
    return min(1.0, resemblance(x, y) * distinct(merge(x, y)) / distinct(x))


def to_text(x: np.ndarray) -> str:
    return "".join(f"{int(v):012x}" for v in x)


def from_text(s: str) -> np.ndarray:
    return np.array([int(s[i : i + 12], 16) for i in range(0, len(s), 12)], np.uint64)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, n_distinct) of every row; null and empty texts have the empty fingerprint; other columns are not read."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sketch(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([to_text(x) for x in made], pa.string()), pa.array([distinct(x) for x in made], pa.float64())], names=["__id", "fingerprint", "n_distinct"])

    return df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("binary").alias("__t")).mapInArrow(run, f"__id {kind}, fingerprint string, n_distinct double").withColumnRenamed("__id", id_col)


def merge_fingerprints(df: DataFrame, group_col: str, fingerprint_col: str = "fingerprint") -> DataFrame:
    """(group, fingerprint) of each group's union, all in built-in functions: distinct hashes, the ``K`` smallest a group.

    A hot group is cut first to ``K`` smallest within salts, so no task sees more than its share.  Null fingerprints are empty.
    """
    cut = F.expr(f"transform(sequence(1, length({fingerprint_col}), 12), i -> substring({fingerprint_col}, i, 12))")
    parts = df.select(F.col(group_col).alias("g"), F.explode_outer(F.when(F.length(fingerprint_col) > 0, cut)).alias("h")).distinct()
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(64)))
    for keys in (["g", "salt"], ["g"]):
        parts = parts.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).where(f"r <= {K}").drop("r")
    return parts.groupBy("g").agg(F.array_join(F.sort_array(F.collect_list("h")), "").alias("fingerprint")).withColumnRenamed("g", group_col)


def _ranges(docs: DataFrame) -> tuple[list[int], dict[int, int]]:
    """Upper bounds of id ranges with about equal rows, at most ``MAX_RANGES``; for each range's largest id the range that needs it as a successor."""
    total = docs.count()
    n = max(1, min(MAX_RANGES, math.ceil(total / ROWS_A_RANGE)))
    bounds = sorted(set(docs.select(F.percentile_approx("id", F.array(*[F.lit(i / n) for i in range(1, n)]), 20 * n)).first()[0] or [])) if n > 1 else []
    heads = {r["b"]: r["m"] for r in docs.select(_range_of(bounds).alias("b"), "id").groupBy("b").agg(F.max("id").alias("m")).collect()}
    order = sorted(heads)
    return bounds, {heads[b]: order[(k + 1) % len(order)] for k, b in enumerate(order)}


def _range_of(bounds: list[int]):
    """Number of bounds below the id, by a coarse and then a fine comparison."""
    if not bounds:
        return F.lit(0)
    arr = F.array(*[F.lit(b) for b in bounds])
    coarse = F.size(F.filter(F.array(*[F.lit(b) for b in bounds[COARSE - 1 :: COARSE]]), lambda b: b < F.col("id"))) if len(bounds) >= COARSE else F.lit(0)
    return coarse * COARSE + F.size(F.filter(F.slice(arr, coarse * COARSE + 1, COARSE), lambda b: b < F.col("id")))


def splice(text: str, following: str) -> str:
    """The text whose last half is replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each text and of its edited text (``splice`` with the next document by descending id; after the last the first).

    Rows of the same id follow each other by a hash of their text; null ids come last; null texts are empty.  Texts are
    shuffled once, by id ranges of about equal size; each range is read in order as a stream, the largest id of the range below
    comes along as its end.  An empty table gives an empty result.
    """
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bounds, successor = _ranges(docs.select("id"))
    heads = df.sparkSession.createDataFrame(list(successor.items()), "id long, to int")  # at most MAX_RANGES rows
    both = docs.join(F.broadcast(heads), "id", "left").withColumn("tie", F.xxhash64("text"))
    own = F.struct(_range_of(bounds).cast("int").alias("range"), F.lit(0).alias("guest"))
    both = both.withColumn("place", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("to").alias("range"), F.lit(1).alias("guest"))))))
    both = both.select("place.*", "id", "tie", "doc", "text").repartition(len(bounds) + 1, "range").sortWithinPartitions("range", "guest", F.desc("id"), "tie")
    names = ["doc", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # (range, doc, text, sketch): a row whose next one has not come yet
        for batch in batches:
            out: list[tuple] = []
            for rng, guest, doc, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 4, 5)), strict=True):
                if guest and waiting is None:
                    continue  # further rows of the head's id
                own = sketch(text.encode())
                if waiting is not None:
                    _, d, t, x = waiting
                    edited = splice(t, text).encode()
                    y = sketch(edited)
                    out.append((d, len(t), hashlib.sha256(edited).hexdigest(), to_text(x), to_text(y), resemblance(x, y), resemblance(x, own)))
                waiting = None if guest else (rng, doc, text, own)
            if out:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    schema = "doc long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return both.mapInArrow(run, schema).withColumnRenamed("doc", id_col)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts."""
    return with_edited(table(spark, sf_dir, "documents"))


QUERIES = {"op7_fingerprints": op7_fingerprints}
ORACLE_SQL: dict[str, str] = {}
