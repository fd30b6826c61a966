"""Operators that see all of their input: every edge, every seed, every node of the first graph."""

import math

import numpy as np
import pytest

from spanweave.graph import RoadGraph
from spanweave.operators import fragility, sampling, topology
from spanweave.sources.loaders import grid_graph


def placed(spark, rows, cols):
    nodes = spark.createDataFrame([(r * cols + c, 35 + 0.01 * r, -83 + 0.01 * c) for r in range(rows) for c in range(cols)], "node_id long, lat double, lon double")
    return RoadGraph(nodes, grid_graph(spark, rows, cols).edges)


def test_dispersed_sees_every_edge(spark):
    """More edges than a pool of 2000, held against the greedy choice over all of them."""
    g = placed(spark, 30, 40)
    pts = sampling.midpoints(g).withColumn("key", sampling._key(42, "edge_id")).orderBy("key", "edge_id").toPandas()
    assert len(pts) > 2000
    rad, chosen, least = np.radians(pts[["lat", "lon"]].to_numpy()), [0], np.full(len(pts), math.inf)
    while True:
        k = chosen[-1]
        d = np.sin((rad - rad[k]) / 2) ** 2
        a = d[:, 0] + np.cos(rad[:, 0]) * np.cos(rad[k, 0]) * d[:, 1]
        least = np.minimum(least, 2 * 6_371_000.0 * np.arctan2(np.sqrt(a), np.sqrt(1 - a)))
        if len(chosen) == 20:
            break
        chosen.append(int(np.argmax(least)))
    got = {r.edge_id for r in sampling.sample_edges(g, 20, "dispersed").collect()}
    assert got == set(pts["edge_id"].iloc[chosen].tolist())
    assert sampling.sample_edges(g, 20, "dispersed", spacing_m=1e9).count() == 1


def test_ensemble_takes_every_seed(spark):
    g = placed(spark, 6, 6)
    ring = [(34.9, -83.1), (34.9, -82.9), (35.1, -82.9), (35.1, -83.1)]
    gone = g.edges.where("src in (7, 14, 21) or dst in (7, 14, 21)").select("src", "dst")
    got = {r.run: r.composite for r in fragility.ensemble(g, ring, 3, seed=5, od=6, blocked=gone).collect()}
    want = {i: fragility.area_index(fragility.area_scores(g, ring, 6, 5 + i, blocked=gone)).first().composite for i in range(3)}
    assert got == want and len(set(got.values())) > 1


@pytest.fixture
def line(spark):
    """Ten nodes on a line, weight 1 each way."""
    e = spark.createDataFrame([x for i in range(9) for x in ((i, i + 1, 1.0), (i + 1, i, 1.0))], "src long, dst long, weight double")
    return RoadGraph.from_edges(e)


def test_degradation_walks_removed_ends(spark, line):
    """Pruned to 0..4: nodes 5..9 walk to 4, so the way back and forth is counted and no pair is lost."""
    less = line.restrict(spark.range(5).withColumnRenamed("id", "node_id"))
    got = topology.degradation(line, less, 10).first()
    ids = [r.node_id for r in line.nodes.orderBy(sampling._key(42, "node_id"), "node_id").collect()]
    to = [r.node_id for r in line.nodes.orderBy(sampling._key(43, "node_id"), "node_id").collect()]
    pairs = [(a, b) for a, b in zip(ids, to) if a != b]
    walk = lambda v: max(0, v - 4)
    stretch = sorted(max(1.0, (walk(a) + abs(min(a, 4) - min(b, 4)) + walk(b)) / abs(a - b)) for a, b in pairs)
    assert got.pairs == len(pairs) and got.connected == 1.0 and abs(got.mean_stretch - sum(stretch) / len(stretch)) < 1e-12 and got.max_stretch == stretch[-1] > 1
    assert (got.bridges, got.bridges_kept) == (9, 4)


def test_degradation_counts_lost_pairs(spark, line):
    """Two halves without the edge between: pairs across are not connected; with no way to a kept node neither."""
    cut = RoadGraph(line.nodes, line.edges.where("not (src in (4, 5) and dst in (4, 5))"))
    got = topology.degradation(line, cut, 10).first()
    assert 0 < got.connected < 1 and got.max_stretch == 1.0 and (got.bridges, got.bridges_kept) == (9, 8)
    far = topology.degradation(line, line.restrict(spark.range(1).withColumnRenamed("id", "node_id")), 10, most_access=2.0).first()
    assert far.connected < 1
