"""Deterministic samplers; order comes from a hash of the id and a seed, so samples need no state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from spanweave.graph import RoadGraph, by_shuffle
from spanweave.operators.paths import distances
from spanweave.shared import materialize


STEPS = 16  # choices after which the distances to them are written


def _key(seed: int, *cols: str) -> Column:
    return F.xxhash64(*cols, F.lit(seed))


def _uniform(seed: int, *cols: str) -> Column:
    """In (0, 1), from the hash."""
    return (F.pmod(_key(seed, *cols), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def sample_edges(graph: RoadGraph, n: int = 100, strategy: str = "uniform", seed: int = 42, classes: str = "label", weight: str = "weight", equal: bool = False, grid: int = 10, spacing_m: float = 500.0, condition: Column | None = None) -> DataFrame:
    """Edges picked by strategy: uniform, stratified (by ``classes``; may exceed n), importance (without replacement, by ``weight``),
    spatial (cells of a grid over edge midpoints), dispersed (farthest first, until the spacing falls below ``spacing_m``)."""
    pool = graph.edges if condition is None else graph.edges.where(condition)
    key = [_key(seed, "edge_id"), F.col("edge_id")]
    if strategy == "uniform":
        return pool.orderBy(*key).limit(n)
    if strategy == "stratified":
        size = pool.groupBy(classes).agg(F.count("*").alias("__n"))
        total, kinds = pool.count(), size.count()
        quota = F.lit(max(1, n // max(1, kinds))) if equal else F.greatest(F.lit(1), F.floor(F.col("__n") / max(1, total) * n + 0.5))
        ranked = pool.join(size.withColumn("__quota", quota), pool[classes].eqNullSafe(size[classes])).drop(size[classes])
        return ranked.withColumn("__r", F.row_number().over(Window.partitionBy(classes).orderBy(*key))).where("__r <= __quota").select(*pool.columns)
    if strategy == "importance":
        w = F.greatest(F.col(weight).cast("double"), F.lit(0.0))
        return pool.where(w > 0).orderBy((-F.log(_uniform(seed, "edge_id")) / w), "edge_id").limit(n)
    mid = midpoints(graph).join(pool.select("edge_id"), "edge_id", "left_semi")
    if strategy == "spatial":
        box = mid.agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("c"), F.max("lon").alias("d"))
        at = lambda v, lo, hi: F.least(F.lit(grid - 1), F.floor((F.col(v) - F.col(lo)) / F.greatest(F.lit(1e-12), F.col(hi) - F.col(lo)) * grid))
        cells = mid.join(F.broadcast(box)).select("edge_id", (at("lat", "a", "b") * grid + at("lon", "c", "d")).alias("cell"))
        share = max(1, n // max(1, cells.select("cell").distinct().count()))
        picked = cells.withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy(*key))).where(F.col("r") <= share).orderBy("r", *key).limit(n)
        return pool.join(picked.select("edge_id"), "edge_id", "left_semi")
    if strategy == "dispersed":
        chosen = _dispersed(mid.withColumn("key", key[0]), n, spacing_m)
        ids = graph.spark.createDataFrame([(i,) for i in chosen], "edge_id long")
        return pool.join(F.broadcast(ids), "edge_id", "left_semi")
    raise ValueError(f"unknown strategy {strategy}")


def _dispersed(points: DataFrame, n: int, spacing_m: float) -> list[int]:
    """Edge ids of ``points`` (edge_id, lat, lon, key), farthest first from the least key; ties to the least key, then id.

    The choice is sequential, the search for each is not: every point's least distance to the chosen ones is kept in a table, and
    tasks bring it up to date with those chosen since.
    """

    def nearer(frame: DataFrame, to: list[Row]) -> DataFrame:
        ends = [(r.edge_id, np.radians(np.array([r.lat, r.lon]))) for r in to]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                rad, least = np.radians(f[["lat", "lon"]].to_numpy()), f["least"].to_numpy()
                for _, at in ends:
                    d = np.sin((rad - at) / 2) ** 2
                    a = d[:, 0] + np.cos(rad[:, 0]) * np.cos(at[0]) * d[:, 1]
                    least = np.minimum(least, 2 * 6_371_000.0 * np.arctan2(np.sqrt(a), np.sqrt(1 - a)))
                yield f.assign(least=least)[~f["edge_id"].isin([i for i, _ in ends])]

        return frame.mapInPandas(run, "edge_id long, lat double, lon double, key long, least double")

    rest = materialize(points.select("edge_id", "lat", "lon", "key", F.lit(float("inf")).alias("least")), "dispersed")
    chosen, new = [], []
    while len(chosen) < n:
        if len(new) == STEPS:
            rest, new = materialize(nearer(rest, new), "dispersed"), []
        best = nearer(rest, new).orderBy(F.desc("least"), "key", "edge_id").first()
        if best is None or best.least < spacing_m:
            break
        chosen.append(best.edge_id)
        new.append(best)
    return chosen


def midpoints(graph: RoadGraph) -> DataFrame:
    """(edge_id, lat, lon) of edges whose ends have coordinates."""
    c = graph.nodes.where("lat is not null and lon is not null").select("node_id", "lat", "lon")
    a, b = c.select(F.col("node_id").alias("src"), F.col("lat").alias("a"), F.col("lon").alias("b")), c.select(F.col("node_id").alias("dst"), F.col("lat").alias("c"), F.col("lon").alias("d"))
    return graph.edges.join(a, "src").join(b, "dst").select("edge_id", ((F.col("a") + F.col("c")) / 2).alias("lat"), ((F.col("b") + F.col("d")) / 2).alias("lon"))


def sample_pairs(graph: RoadGraph, n: int = 100, **how) -> DataFrame:
    """(src, dst) of sampled edges."""
    return sample_edges(graph, n, **how).select("src", "dst")


def od_pairs(graph: RoadGraph, n: int, seed: int = 42) -> DataFrame:
    """(od_id, src, dst): seeded pairs of different nodes, drawn by position; null ends never occur."""
    ids = graph.nodes.select("node_id").withColumn("at", F.row_number().over(Window.orderBy("node_id")) - 1)
    total = ids.count()
    draw = graph.spark.range(n).select(F.col("id").alias("od_id"), F.pmod(_key(seed, "id"), F.lit(max(1, total))).alias("i"), F.pmod(_key(seed + 1, "id"), F.lit(max(1, total))).alias("j"))
    return draw.join(by_shuffle(ids.select(F.col("at").alias("i"), F.col("node_id").alias("src"))), "i").join(by_shuffle(ids.select(F.col("at").alias("j"), F.col("node_id").alias("dst"))), "j").where("src <> dst").select("od_id", "src", "dst")


def sample_od(graph: RoadGraph, n: int = 1000, strata: int = 10, pilot: int = 500, long_weight: int = 3, seed: int = 42) -> DataFrame:
    """(od_id, src, dst, dist, stratum): reachable pairs, in distance strata of a pilot's quantiles; strata whose middle lies beyond
    the pilot's 70th percentile weigh ``long_weight`` times as much (the last, open one always does)."""
    trial = distances(graph, od_pairs(graph, pilot, seed + 100)).where("dist > 0")
    cuts = trial.agg(F.percentile_approx("dist", F.array(*[F.lit(i / strata) for i in range(1, strata)] + [F.lit(0.7)]), 10_000)).first()[0]
    if not cuts:
        return graph.spark.createDataFrame([], "od_id long, src long, dst long, dist double, stratum int")
    *bounds, far = cuts
    edges = [0.0, *bounds, float("inf")]
    weight = [long_weight if (edges[i] + edges[i + 1]) / 2 > far else 1 for i in range(strata)]
    quota = [max(1, round(n * w / sum(weight))) for w in weight]
    od = materialize(od_pairs(graph, 20 * n, seed), "od")
    d = distances(graph, od).where("dist > 0").join(od, "od_id")
    stratum = sum(((F.col("dist") > b).cast("int") for b in bounds), F.lit(0))
    allowed = F.element_at(F.array(*[F.lit(q) for q in quota]), F.col("stratum") + 1)
    return d.withColumn("stratum", stratum).withColumn("r", F.row_number().over(Window.partitionBy("stratum").orderBy("od_id"))).where(F.col("r") <= allowed).select("od_id", "src", "dst", "dist", "stratum")

