"""Snapping points to nodes and edges."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanweave.functions.geo import METRES_PER_DEGREE, haversine, project_to_segment
from spanweave.graph import RoadGraph


def nearest_node(points: DataFrame, nodes: DataFrame, cell: float = 0.02) -> DataFrame:
    """(point_id, node_id, distance_m): nearest node, lowest id of equals.

    Points meet nodes of their own and the eight cells around.  Points with no node within a cell's width meet all nodes (a
    plain cross join of those points), so the answer is exact; ``cell`` should be wide enough that they are few.
    """
    n = nodes.where("lat is not null and lon is not null").select("node_id", F.col("lat").alias("nlat"), F.col("lon").alias("nlon"))
    near = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    p = points.select("point_id", "lat", "lon")
    around = p.withColumn("i", F.explode(F.transform(near, lambda k: F.floor(F.col("lat") / cell) + k))).withColumn("j", F.explode(F.transform(near, lambda k: F.floor(F.col("lon") / cell) + k)))
    there = n.withColumn("i", F.floor(F.col("nlat") / cell)).withColumn("j", F.floor(F.col("nlon") / cell))
    best = F.min(F.struct(haversine("lat", "lon", "nlat", "nlon").alias("d"), "node_id"))
    first = around.join(there, ["i", "j"]).groupBy("point_id").agg(best.alias("b"), F.first("lat").alias("lat"))
    # certain only within the ring of cells that was searched
    sure = first.where(F.col("b.d") <= cell * METRES_PER_DEGREE * F.greatest(F.lit(0.0), F.cos(F.radians(F.abs("lat") + 2 * cell))) * 0.99).select("point_id", "b")
    rest = p.join(sure, "point_id", "left_anti").crossJoin(n).groupBy("point_id").agg(best.alias("b"))
    return sure.union(rest).select("point_id", F.col("b.node_id").alias("node_id"), F.col("b.d").alias("distance_m"))


def _candidates(points: DataFrame, graph: RoadGraph, reach_m: float) -> DataFrame:
    """Points with every edge whose box comes within ``reach_m``, by grid cells, and the projection on it."""
    c = graph.nodes.select("node_id", "lat", "lon")
    one = graph.edges.groupBy("src", "dst").agg(F.min("edge_id").alias("edge_id"), F.min_by("weight", "edge_id").alias("weight"))
    e = one.join(c.select(F.col("node_id").alias("src"), F.col("lat").alias("ay"), F.col("lon").alias("ax")), "src").join(c.select(F.col("node_id").alias("dst"), F.col("lat").alias("by"), F.col("lon").alias("bx")), "dst")
    cell = max(0.01, 2 * reach_m / METRES_PER_DEGREE)
    grow = reach_m / METRES_PER_DEGREE * 1.01
    wide = grow / F.greatest(F.lit(0.01), F.cos(F.radians(F.greatest(F.abs("ay"), F.abs("by")) + grow)))
    span = lambda a, b, g: F.sequence(F.floor((F.least(a, b) - g) / cell), F.floor((F.greatest(a, b) + g) / cell))
    e = e.withColumn("i", F.explode(span("ay", "by", F.lit(grow)))).withColumn("j", F.explode(span("ax", "bx", wide)))
    p = points.select("point_id", "lat", "lon", F.floor(F.col("lat") / cell).alias("i"), F.floor(F.col("lon") / cell).alias("j"))
    return p.join(e, ["i", "j"]).withColumn("p", project_to_segment("lat", "lon", "ay", "ax", "by", "bx"))


def nearest_edges(points: DataFrame, graph: RoadGraph, k: int = 16, reach_m: float = 5000.0) -> DataFrame:
    """(point_id, rank, edge_id, distance_m): the k nearest edges (one of parallel ones) within ``reach_m``, ties to the lowest edge id."""
    order = Window.partitionBy("point_id").orderBy("distance_m", "edge_id")
    near = _candidates(points, graph, reach_m).select("point_id", "edge_id", F.col("p.distance_m").alias("distance_m")).where(F.col("distance_m") <= reach_m)
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("point_id", "rank", "edge_id", "distance_m")


def snap(points: DataFrame, graph: RoadGraph, max_m: float = 500.0) -> DataFrame:
    """(point_id, src, dst, t, lat, lon, d_src, d_dst, snap_m, exact): nearest edge nearer than ``max_m``; nulls if there is none.

    d_src and d_dst are the parts of the edge's weight; exact: within 1 % of an end.
    """
    near = _candidates(points, graph, max_m).where(F.col("p.distance_m") < max_m)
    best = near.groupBy("point_id").agg(F.min_by(F.struct("src", "dst", "weight", "p"), F.struct(F.col("p.distance_m"), F.col("edge_id"))).alias("b"))
    t, w = F.col("b.p.t"), F.col("b.weight")
    out = best.select("point_id", F.col("b.src").alias("src"), F.col("b.dst").alias("dst"), t.alias("t"), F.col("b.p.lat").alias("lat"), F.col("b.p.lon").alias("lon"), (t * w).alias("d_src"), ((1 - t) * w).alias("d_dst"), F.col("b.p.distance_m").alias("snap_m"), ((t < 0.01) | (t > 0.99)).alias("exact"))
    return points.select("point_id").join(out, "point_id", "left")


def at_index(values: str, share: tuple[int, int], least: bool = True) -> F.Column:
    """Value at floor(n * a / b) of the sorted non-null column, at most the last: the percentile convention used throughout."""
    s = F.array_sort(F.collect_list(values))
    at = F.floor(F.size(s) * F.lit(share[0]) / F.lit(share[1]))
    return F.get(s, F.least(F.size(s) - 1, at).cast("int")) if least else F.get(s, at.cast("int"))


def snap_quality(snaps: DataFrame, warn_m: float = 200.0) -> DataFrame:
    """One row: total, snapped, failed, exact, warned, p50, p90, p95, p99 and max of the snap distances.

    Distances are reduced to counts by value before the percentiles, so no list of all of them is gathered.
    """
    head = snaps.agg(F.count("*").alias("total"), F.count("snap_m").alias("snapped"), F.count(F.when(F.col("snap_m").isNull(), 1)).alias("failed"), F.count(F.when(F.col("exact"), 1)).alias("exact"), F.count(F.when(F.col("snap_m") > warn_m, 1)).alias("warned"), F.max("snap_m").alias("max_m"))
    part = snaps.where("snap_m is not null").groupBy(F.round("snap_m", 9).alias("v")).count()
    upto = part.withColumn("upto", F.sum("count").over(Window.orderBy("v"))).withColumn("n", F.sum("count").over(Window.partitionBy(F.lit(1))))
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * p / 100)), F.col("v"))).alias(f"p{p}")
    return head.crossJoin(upto.agg(*[at(p) for p in (50, 90, 95, 99)]))


def tiles(lat0: float, lat1: float, lon0: float, lon1: float, tile_m: float) -> tuple[int, int, float, float]:
    """(rows, cols, lat step, lon step) of a box cut into tiles, degrees scaled at the middle latitude."""
    dlat = tile_m / METRES_PER_DEGREE
    dlon = tile_m / (METRES_PER_DEGREE * math.cos(math.radians((lat0 + lat1) / 2)))
    return max(1, math.ceil((lat1 - lat0) / dlat)), max(1, math.ceil((lon1 - lon0) / dlon)), dlat, dlon
