"""Mixing sources to target weights by cube-method balanced sampling.

A document of a source with target ratio r is taken floor(r) times, and once more with inclusion probability r - floor(r).
The cube method moves these probabilities through the null space of the balancing constraints (document total and token total)
until each is 0 or 1.  Sources are cut into blocks of about ``BLOCK`` documents by a hash, so a hot source is spread over many
tasks; a flight leaves at most two fractional documents a block, small ones since large ones go first; these meet in the next,
far smaller level, and at last at most two documents a source are landed by dropping constraints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanweave.llm.common import materialize, table

WEIGHTS = (5, 2, 1)  # by rank of the source in code point order, repeating, null last
SHARE = 1.5  # mix size over corpus size
CEILING = 2  # most copies of a source, and of a document
BLOCK = 1000
EPS = 1e-9


def word_counts(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, size): words of each text, 0 for null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.array([len((t.as_py() or b"").split()) for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes], names=["id", "source", "size"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "id long, source string, size long")


def source_targets(sized: DataFrame) -> DataFrame:
    """(source, n, source_size, target): one row a source.

    With caps sorted by cap over weight, the water level is the first (T - caps before) / (weights from here on) that does not
    exceed that quotient.  The windows run over one row a source.
    """
    s = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), (rank % len(WEIGHTS) + 1).cast("int"))
    s = s.withColumn("w", w).withColumn("cap", F.lit(float(CEILING)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after, all_ = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("t", (F.sum("source_size").over(all_) * SHARE - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    s = s.withColumn("level", F.first(F.when(F.col("t") * F.col("w") <= F.col("cap"), F.col("t")), ignorenulls=True).over(all_))
    return s.select("source", "n", "source_size", F.least(F.coalesce(F.col("level") * F.col("w"), F.col("cap")), F.col("cap")).alias("target"))


def _flight(size: list[float], pi: list[float], rng: np.random.Generator) -> None:
    """Fast flight in place: always three documents and the null vector of their two constraints."""
    draws, used = rng.random(2 * len(pi) + 8), 0
    active: list[int] = []
    for k in range(len(pi)):
        if not EPS < pi[k] < 1 - EPS:
            pi[k] = float(round(pi[k]))
            continue
        active.append(k)
        while len(active) == 3 or len(active) == 2 and size[active[0]] == size[active[1]]:
            if len(active) == 2:
                u = [1.0, -1.0]
            else:
                x, y, z = (size[i] for i in active)
                u = [z - y, x - z, y - x] if x != y or y != z else [1.0, -1.0, 0.0]
            up = min((1 - pi[i]) / v if v > 0 else pi[i] / -v for i, v in zip(active, u, strict=True) if v)
            down = min(pi[i] / v if v > 0 else (1 - pi[i]) / -v for i, v in zip(active, u, strict=True) if v)
            step = up if draws[used % len(draws)] * (up + down) < down else -down
            used += 1
            for i, v in zip(active, u, strict=True):
                pi[i] += step * v
                if not EPS < pi[i] < 1 - EPS:
                    pi[i] = float(round(pi[i]))
            active = [i for i in active if EPS < pi[i] < 1 - EPS]


def _landing(pi: list[float], rng: np.random.Generator) -> None:
    """Last documents of a source: first only their number is kept, then only their probability."""
    left = [i for i, p in enumerate(pi) if EPS < p < 1 - EPS]
    while len(left) > 1:
        a, b = left[:2]
        up, down = min(1 - pi[a], pi[b]), min(pi[a], 1 - pi[b])
        step = up if rng.random() * (up + down) < down else -down
        pi[a], pi[b] = pi[a] + step, pi[b] - step
        for i in (a, b):
            if not EPS < pi[i] < 1 - EPS:
                pi[i] = float(round(pi[i]))
        left = [i for i in left if EPS < pi[i] < 1 - EPS]
    for i in left:
        pi[i] = float(rng.random() < pi[i])


def _fly(rows: DataFrame, level: int, seed: int) -> DataFrame:
    """One level of flights, by source and block; blocks of a source that has only one are landed too."""

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by([("size", "descending"), ("h", "ascending"), ("row", "ascending")])
        size, pi = [float(x) for x in block["size"].to_pylist()], block["pi"].to_pylist()
        rng = np.random.Generator(np.random.PCG64([seed, level, block["key"][0].as_py() & (2**63 - 1)]))
        _flight(size, pi, rng)
        if block["blocks"][0].as_py() == 1:
            _landing(pi, rng)
        return block.set_column(block.column_names.index("pi"), "pi", pa.array(pi, pa.float64()))

    rows = rows.withColumn("block", F.pmod(F.xxhash64("h", F.lit(level)), "blocks")).withColumn("key", F.xxhash64("source", "block", F.col("source").isNull()))
    rows = rows.select("id", "source", "size", "h", "row", "blocks", "pi", "key")
    return rows.groupBy("key").applyInArrow(run, rows.schema)


def mix(df: DataFrame, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: id, source, size, source_size, target and copies (how often the mix takes it, 0 to 2).

    Null texts have size 0; null sources are one source, ranked last; sources without words have target 0.  Null and repeated
    ids are rows of their own.  Ties between equal rows are broken by a counter, so reruns agree.  Other columns are not read,
    so their names cannot clash.  An empty table gives an empty result.
    """
    sized = word_counts(df, id_col, text_col, source_col)
    # equal rows (same id, source, size) are interchangeable; they are kept as one row with its number, dealt out again below
    sized = materialize(sized.groupBy("id", "source", "size").agg(F.count("*").alias("times")).select("id", "source", "size", F.explode(F.sequence(F.lit(1), "times")).alias("row")), "sizes")
    targets = materialize(source_targets(sized), "targets")
    rows = sized.withColumn("h", F.xxhash64("id", "row", F.lit(seed)))
    of = F.col("target") / F.greatest(F.col("source_size"), F.lit(1))
    rows = rows.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("whole", F.floor(of + EPS).cast("long")).withColumn("pi", F.greatest(of - F.col("whole"), F.lit(0.0))).withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    rows = materialize(rows, "units")
    done, level = None, 0
    todo = rows.where(f"pi > {EPS}")
    while True:
        flown = materialize(_fly(todo, level, seed), f"flight{level}")
        settled = flown.where("pi = 0 or pi = 1").select("id", "source", "size", "row", "pi")
        done = settled if done is None else done.union(settled)
        left = flown.where("pi > 0 and pi < 1")
        if left.isEmpty():
            break
        # a block leaves at most two: the next level has BLOCK / 2 times fewer blocks
        todo, level = left.drop("key").withColumn("blocks", F.ceil(F.col("blocks") * 2 / BLOCK)), level + 1
    more = done.where("pi = 1").select(F.col("id").alias("i"), F.col("source").alias("s"), F.col("size").alias("z"), F.col("row").alias("r"), F.lit(1).alias("more"))
    same = F.col("id").eqNullSafe(F.col("i")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("row") == F.col("r"))
    out = rows.join(more, same, "left")
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (F.col("whole") + F.coalesce("more", F.lit(0))).cast("long").alias("copies"))


def mixed(df: DataFrame, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: rows of ``df``, all columns as they are, each as often as the mix takes it.

    The copies of rows with one id are dealt out over these rows in the order of their texts' hashes.
    """
    copies = mix(df, seed, id_col, text_col, source_col).groupBy(F.col(id_col).alias("__id")).agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows"))
    both = df.join(copies, df[id_col].eqNullSafe(F.col("__id")))
    place = F.row_number().over(Window.partitionBy(id_col).orderBy(F.xxhash64(text_col, source_col)))
    times = F.floor(F.col("__copies") / F.col("__rows")) + (place <= F.col("__copies") % F.col("__rows")).cast("int")
    return both.withColumn("__times", times.cast("int")).where("__times > 0").withColumn("__copy", F.explode(F.expr("sequence(1, __times)"))).select(*df.columns)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    m = mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES = {"op4_mix_sources": op4_mix_sources}
ORACLE_SQL: dict[str, str] = {}
