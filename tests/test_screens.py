"""Screened replacement paths, landmarks and bridges against brute force."""

import math

import numpy as np

from spanweave.graph import RoadGraph
from spanweave.operators import centrality, fragility, paths, topology
from spanweave.operators.regions import hilbert_order
from spanweave.sources.loaders import grid_graph, random_graph


def table_of(graph):
    """All distances by relaxation, by id."""
    ids = sorted(r.node_id for r in graph.nodes.collect())
    at = {v: k for k, v in enumerate(ids)}
    d = np.full((len(ids), len(ids)), math.inf)
    np.fill_diagonal(d, 0)
    for r in graph.edges.collect():
        d[at[r.src], at[r.dst]] = min(d[at[r.src], at[r.dst]], r.weight)
    for k in range(len(ids)):
        d = np.minimum(d, d[:, [k]] + d[[k]])
    return ids, at, d


def test_filtered_fragility(spark):
    base = random_graph(spark, 30, 40, 1, 20, seed=3)
    tail = spark.createDataFrame([(29, 30, 2.0), (30, 29, 2.0), (30, 31, 3.0), (31, 30, 3.0)], "src long, dst long, weight double")
    g = RoadGraph.from_edges(base.edges.select("src", "dst", "weight").union(tail), spark.range(32).withColumnRenamed("id", "node_id"))
    od = spark.createDataFrame([(i, i, 31 - i) for i in range(14)] + [(90, 5, 5)], "od_id long, src long, dst long")
    levels, marks = topology.node_levels(g), paths.landmarks(g, 2)
    exact = {(r.od_id, r.pos): r for r in fragility.route_fragility(g, od, "exact").collect()}
    cut = {frozenset((r.u, r.v)) for r in topology.bridges(g).collect()}
    level = {r.node_id: r.node_level for r in levels.collect()}
    least = sorted(level.values())[int(0.6 * len(level))]
    ids, at, d = table_of(g)
    chosen = sorted({r.landmark for r in marks.collect()})
    ends = {r.od_id: (r.src, r.dst) for r in od.collect()}
    seen = set()
    got = fragility.filtered_route_fragility(g, od, levels, marks, 0.6, 1.2).collect()
    assert {(r.od_id, r.pos) for r in got} == exact.keys() and len(got) == len(exact)
    for r in got:
        s, t = (at[v] for v in ends[r.od_id])
        bound = max(max(abs(d[at[k], s] - d[at[k], t]), abs(d[s, at[k]] - d[t, at[k]])) for k in chosen)
        why = "bridge" if frozenset((r.src, r.dst)) in cut else "level" if min(level[r.src], level[r.dst]) >= least else "bound" if bound > 0 and d[s, t] / bound < 1.2 else None
        want = exact[r.od_id, r.pos]
        value = {"bridge": None, "level": want.primary, "bound": want.primary, None: want.replacement}[why]
        assert r.screened == why and (r.src, r.dst) == (want.src, want.dst)
        assert (r.replacement is None) == (value is None) and (value is None or abs(r.replacement - value) < 1e-9)
        seen.add(why)
    assert seen == {"bridge", "level", "bound", None}
    assert fragility.filtered_route_fragility(g, od.limit(0), levels, marks).count() == 0


def test_landmarks(spark):
    g = random_graph(spark, 30, 40, 1, 20, seed=8)
    ids, at, d = table_of(g)
    rows = paths.landmarks(g, 4).collect()
    chosen = {r.landmark for r in rows}
    assert len(chosen) == 4 and len(rows) == 4 * len(ids)
    for r in rows:
        assert abs(r.d_from - d[at[r.landmark], at[r.node_id]]) < 1e-9 and abs(r.d_to - d[at[r.node_id], at[r.landmark]]) < 1e-9
    # one of them is the start, from which every next one is the farthest from those before
    def spread(start):
        out = [start]
        while len(out) < 4:
            out.append(int(np.argmax(d[out].min(0))))
        return {ids[k] for k in out}

    assert any(spread(at[k]) == chosen for k in chosen)


def test_bridges_cost_and_type(spark):
    rows = [(0, 1, 1.0, "a"), (1, 0, 1.0, "a"), (1, 2, 4.0, "a"), (2, 1, 4.0, "a"), (2, 3, 1.0, "b"), (3, 2, 1.0, "b"), (3, 1, 2.0, "b"), (1, 3, 2.0, "b")]
    e = spark.createDataFrame(rows, "src long, dst long, weight double, label string")
    g = RoadGraph.from_edges(e, spark.range(4).withColumnRenamed("id", "node_id"))
    found = spark.createDataFrame([(0, 1), (1, 2)], "u long, v long")
    assert {(r.u, r.v): r.cost for r in topology.bridge_costs(g, found).collect()} == {(0, 1): None, (1, 2): 3.0}
    assert {(r.u, r.v): r.type for r in topology.classify_bridges(g, e.label == "a").collect()} == {(0, 1): topology.STRUCTURAL, (1, 2): topology.FILTER_INDUCED}


def test_hilbert_order(spark):
    nodes = spark.createDataFrame([(r * 8 + c, 35 + 0.01 * r, -83 + 0.01 * c) for r in range(8) for c in range(8)] + [(64, None, None)], "node_id long, lat double, lon double")
    got = hilbert_order(RoadGraph(nodes, grid_graph(spark, 8, 8).edges)).collect()
    assert sorted(r.new_id for r in got) == list(range(64))
    assert [r.node_id for r in sorted(got, key=lambda r: r.new_id)] == [r.node_id for r in sorted(got, key=lambda r: (r.hilbert, r.node_id))]
    # the curve goes from cell to neighbouring cell
    way = [divmod(r.node_id, 8) for r in sorted(got, key=lambda r: r.new_id)]
    assert all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(way, way[1:]))


def test_spectral(spark):
    g = grid_graph(spark, 4, 5)
    ids, at, _ = table_of(g)
    a = np.zeros((len(ids), len(ids)))
    for r in g.edges.collect():
        a[at[r.src], at[r.dst]] = 1
    low = np.linalg.eigvalsh(np.diag(a.sum(1)) - a)
    got = centrality.spectral(g).first()
    assert abs(got.algebraic_connectivity / low[1] - 1) < 0.01
    assert abs(got.kirchhoff / (len(ids) * (1 / low[1:]).sum()) - 1) < 0.1
    assert abs(got.natural_connectivity / math.log(np.exp(np.linalg.eigvalsh(a)).mean()) - 1) < 0.1


def test_only_the_worst_edges_leave_the_tasks(spark):
    """Sinks and bottlenecks of worst edges are those of all edges; ties, bridges, pairs without a way and of equal ends included."""
    from spanweave.sources import sinks

    base = grid_graph(spark, 7, 9)
    tail = spark.createDataFrame([(62, 100, 2.0), (100, 62, 2.0), (100, 101, 3.0), (101, 100, 3.0), (200, 201, 1.0)], "src long, dst long, weight double")
    g = RoadGraph.from_edges(base.edges.select("src", "dst", "weight").union(tail))
    od = spark.createDataFrame([(i, i, (i * 17 + 5) % 63) for i in range(60)] + [(90, 5, 101), (91, 5, 5), (92, 3, 200), (93, 3, 777), (94, 101, 0)], "od_id long, src long, dst long")
    for method in ("interval", "exact", "approx"):
        every, worst = fragility.route_fragility(g, od, method), fragility.route_fragility(g, od, method, worst=True)
        assert worst.count() == every.select("od_id").distinct().count() < every.count()
        for of in (fragility.bottleneck, lambda f: sinks.fragility_rows(f, od), lambda f: sinks.fragility_json(f, od)):
            assert of(worst).schema == of(every).schema
            assert sorted(map(tuple, of(worst).collect()), key=str) == sorted(map(tuple, of(every).collect()), key=str)
    assert fragility.route_fragility(g, od.limit(0), worst=True).count() == 0


def test_sinks_take_one_row_a_pair(spark, monkeypatch):
    from spanweave.plans import queries
    from spanweave.sources import sinks

    seen = []
    for name in ("fragility_rows", "fragility_json"):
        monkeypatch.setattr(sinks, name, lambda f, od, own=getattr(sinks, name): seen.append(f) or own(f, od))
    for q in ("k1_fragility_rows", "k4_fragility_json"):
        queries.QUERIES[q](spark, "/root/testdata/sf0.001")
    assert all(f.count() == f.select("od_id").distinct().count() for f in seen) and len(seen) == 2
