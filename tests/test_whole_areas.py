"""Areas are scored by every pair of their entries, whatever their size."""

import pytest

from spanweave.graph import RoadGraph
from spanweave.operators import fragility
from spanweave.operators.kernels import INF, dijkstra, path_to
from spanweave.sources.loaders import grid_graph


def placed(spark, rows, cols, spurs=()):
    """A grid with weights that vary, and nodes outside its rectangle that hang on some of its nodes."""
    nodes = spark.createDataFrame([(r * cols + c, 35 + 0.01 * r, -83 + 0.01 * c) for r in range(rows) for c in range(cols)] + [(rows * cols + k, 30.0, -90.0) for k in range(len(spurs))], "node_id long, lat double, lon double")
    e = grid_graph(spark, rows, cols).edges.selectExpr("src", "dst", "cast(1 + (least(src, dst) * 7 + greatest(src, dst) * 3) % 5 as double) as weight")
    more = spark.createDataFrame([x for k, v in enumerate(spurs) for x in ((v, rows * cols + k, 9.0), (rows * cols + k, v, 9.0))], "src long, dst long, weight double")
    return RoadGraph.from_edges(e.union(more), nodes)


def brute(graph, sub):
    """Entries and score by the definition: a search without each edge of each pair's path."""
    inside = {r.node_id for r in sub.nodes.collect()}
    entries = sorted({r.src for r in graph.edges.collect() if r.src in inside and r.dst not in inside})
    g, worst = graph.local(), []
    for i, a in enumerate(entries):
        for b in entries[i + 1 :]:
            s, t = g.at(a), g.at(b)
            d, p = dijkstra(g.adjacent, s)
            way = path_to(p, s, t)
            lost = [dijkstra(g.adjacent, s, {e}, t)[0][t] for e in zip(way, way[1:])]
            if lost and max(lost) < INF:
                worst.append(max(lost) / d[t])
    return len(entries), 1 / (1 + sum(worst) / len(worst)) if worst else 0.0


def test_accessibility_takes_every_pair_of_entries(spark):
    g = placed(spark, 7, 9)
    ring = [(35.015, -82.985), (35.015, -82.935), (35.045, -82.935), (35.045, -82.985)]
    sub = g.subgraph(ring)
    want = brute(g, sub)
    assert want[0] * (want[0] - 1) // 2 > 10
    got = fragility.accessibility(g, sub).first()
    assert (got.entry_points, got.score) == (want[0], pytest.approx(want[1]))
    # the composites of a scenario and of an ensemble rest on it
    scores = fragility.area_scores(g, ring, od=5).first()
    assert scores.accessibility == pytest.approx(1 - want[1])
    runs = fragility.ensemble(g, ring, 2, seed=42, od=5).orderBy("run").collect()
    made = fragility.scenario(g, ring, ring, od=5).first()
    part = sum(scores[k] * w for k, w in fragility.AREA_WEIGHTS.items())
    assert made.baseline == pytest.approx(part) and runs[0].composite == pytest.approx(part)


def test_accessibility_of_large_areas(spark):
    """More than 5000 nodes are measured as few are."""
    g = placed(spark, 71, 72, (0, 5, 72 * 3))
    sub = g.restrict(spark.range(71 * 72).withColumnRenamed("id", "node_id"))
    got, want = fragility.accessibility(g, sub).first(), brute(g, sub)
    assert want[0] == 3 and 0 < want[1] < 1
    assert (got.entry_points, got.score) == (3, pytest.approx(want[1]))


def test_accessibility_without_pairs(spark):
    g = placed(spark, 3, 3, (4,))
    assert tuple(fragility.accessibility(g, g.restrict(spark.range(9).withColumnRenamed("id", "node_id"))).first()) == (1, 0.0)
    assert tuple(fragility.accessibility(g, g).first()) == (0, 0.0)
