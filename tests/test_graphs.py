"""Searches, topology and measures against brute force and closed forms."""

import itertools
import math
import random

import numpy as np
import pytest

from spanweave.graph import LocalGraph, RoadGraph
from spanweave.operators import centrality, fragility, kernels, paths, sampling, topology
from spanweave.sources.loaders import grid_graph, random_graph, tree_graph


def local(n, edges):
    s, d, w = (np.array(x) for x in zip(*edges, strict=True))
    return LocalGraph(np.arange(n), s, d, w.astype(float))


def both(edges):
    return [x for a, b, w in edges for x in ((a, b, w), (b, a, w))]


def floyd(n, edges):
    d = [[0.0 if i == j else math.inf for j in range(n)] for i in range(n)]
    for a, b, w in edges:
        d[a][b] = min(d[a][b], w)
    for k, i, j in itertools.product(range(n), repeat=3):
        d[i][j] = min(d[i][j], d[i][k] + d[k][j])
    return d


FIVE = [(0, 1, 1), (0, 3, 4), (0, 4, 10), (1, 2, 2), (3, 2, 1), (2, 4, 3)]


def graph(spark, n, edges):
    return RoadGraph.from_edges(spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "src long, dst long, weight double"), spark.range(n).withColumnRenamed("id", "node_id"))


def rand_edges(rng, n, m):
    return [(rng.randrange(n), rng.randrange(n), rng.randint(1, 9)) for _ in range(m)]


def test_five_nodes(spark):
    g = graph(spark, 5, FIVE)
    d = {r.node_id: (r.dist, r.pred) for r in paths.shortest_paths(g, spark.createDataFrame([(0,)], "source long")).collect()}
    assert {k: v[0] for k, v in d.items()} == {0: 0, 1: 1, 2: 3, 3: 4, 4: 6} and d[0][1] is None and d[4][1] == 2
    od = spark.createDataFrame([(0, 0, 4), (1, 4, 0), (2, 0, 0), (3, 0, 99)], "od_id long, src long, dst long")
    got = {r.od_id: (r.dist, r.path) for r in paths.paths(g, od).collect()}
    assert got == {0: (6.0, [0, 1, 2, 4]), 1: (None, []), 2: (0.0, [0]), 3: (None, [])}
    same = {r.node_id: r.dist for r in paths.shortest_paths_by_joins(g, spark.createDataFrame([(0,)], "source long")).collect()}
    assert same == {k: v[0] for k, v in d.items()}


def test_searches_against_floyd():
    rng = random.Random(1)
    for _ in range(20):
        n = rng.randint(2, 12)
        e = rand_edges(rng, n, 3 * n)
        g, want = local(n, e), floyd(n, e)
        for s in range(n):
            assert kernels.dijkstra(g.adjacent, s)[0] == want[s]
        a, b, _ = e[0]
        less = floyd(n, [x for x in e if x[:2] != (a, b)])
        assert kernels.dijkstra(g.adjacent, a, {(a, b)})[0] == less[a]


def pieces(n, pairs):
    label = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return len(set(label))


def test_bridges_against_removal():
    rng = random.Random(2)
    for _ in range(40):
        n = rng.randint(2, 10)
        und = {(min(a, b), max(a, b)) for a, b, _ in rand_edges(rng, n, n) if a != b}
        if und:
            g = local(n, both([(a, b, 1) for a, b in und]))
            assert kernels.bridges(g) == sorted(p for p in und if pieces(n, und - {p}) > pieces(n, und))
    assert kernels.bridges(local(2, both([(0, 1, 1), (0, 1, 2)]))) == []


def test_degree2():
    g = local(5, both([(0, 1, 1), (1, 2, 2), (2, 3, 3), (3, 4, 4)]))
    assert kernels.contract_degree2(g) == ([0, 4], [(0, 4, 10.0), (4, 0, 10.0)])
    assert kernels.contract_degree2(g, {2})[0] == [0, 2, 4]
    rng = random.Random(3)
    for _ in range(20):
        n = rng.randint(4, 14)
        e = both([x for x in rand_edges(rng, n, n) if x[0] != x[1]])
        g, want = local(n, e), floyd(n, e)
        kept, merged = kernels.contract_degree2(g)
        d = floyd(n, merged)
        assert all(d[a][b] == want[a][b] for a in kept for b in kept)


def test_betweenness_against_enumeration():
    rng = random.Random(4)
    for _ in range(10):
        n = rng.randint(3, 7)
        e = list({(a, b): (a, b, w) for a, b, w in rand_edges(rng, n, 3 * n) if a != b}.values())
        g, d = local(n, e), floyd(n, e)
        edge, node = np.zeros(len(g.src)), np.zeros(n)
        for s in range(n):
            x, y = kernels.brandes(g, s)
            edge, node = edge + x, node + y

        def walks(s, t, d=d, e=e):
            return [[t]] if s == t else [[s, *p] for a, b, w in e if a == s and math.isfinite(d[b][t]) and w + d[b][t] == d[s][t] for p in walks(b, t)]

        want_e, want_v = dict.fromkeys(((a, b) for a, b, _ in e), 0.0), np.zeros(n)
        for s, t in itertools.permutations(range(n), 2):
            if math.isfinite(d[s][t]):
                ws = walks(s, t)
                for p in ws:
                    for k in zip(p, p[1:]):
                        want_e[k] += 1 / len(ws)
                    for v in p[1:-1]:
                        want_v[v] += 1 / len(ws)
        assert np.allclose(edge, [want_e[int(a), int(b)] for a, b in zip(g.src, g.dst)]) and np.allclose(node, want_v)


def complete(n):
    return local(n, both([(a, b, 1) for a, b in itertools.combinations(range(n), 2)]))


def test_spectra():
    for n in (5, 10):
        assert abs(kernels.algebraic_connectivity(complete(n)) - n) < 1e-6 and abs(kernels.kirchhoff(complete(n)) - (n - 1)) < 1e-6
    n = 90
    path = local(n, both([(i, i + 1, 1) for i in range(n - 1)]))
    assert abs(kernels.algebraic_connectivity(path) / (2 - 2 * math.cos(math.pi / n)) - 1) < 0.01
    assert abs(kernels.kirchhoff(complete(80)) / 79 - 1) < 0.1
    ring = local(100, both([(i, (i + 1) % 100, 1) for i in range(100)]))
    exact = math.log(np.mean([math.exp(2 * math.cos(2 * math.pi * k / 100)) for k in range(100)]))
    assert abs(kernels.natural_connectivity(ring) / exact - 1) < 0.05
    assert kernels.algebraic_connectivity(local(4, both([(0, 1, 1), (2, 3, 1)]))) == 0


def test_replacement_paths(spark):
    g = random_graph(spark, 40, 70, 1, 20, seed=5)
    od = spark.createDataFrame([(i, i, 39 - i) for i in range(12)], "od_id long, src long, dst long")
    key = lambda df: {(r.od_id, r.pos): (r.src, r.dst, r.replacement) for r in df.collect()}
    exact, fast, near = (key(fragility.route_fragility(g, od, m)) for m in ("exact", "interval", "approx"))
    assert exact.keys() == fast.keys() == near.keys()
    for k, (a, b, c) in exact.items():
        assert fast[k][:2] == (a, b) and (c is None) == (fast[k][2] is None) == (near[k][2] is None)
        if c is not None:
            assert abs(fast[k][2] - c) < 1e-9 and 0.9 * c - 1e-9 <= near[k][2] <= c + 1e-9
    grid = grid_graph(spark, 6, 6)
    od = spark.createDataFrame([(0, 0, 35), (1, 7, 28)], "od_id long, src long, dst long")
    assert {k: v[2] for k, v in key(fragility.route_fragility(grid, od)).items()} == {k: v[2] for k, v in key(fragility.route_fragility(grid, od, "exact")).items()}


def test_curves(spark):
    c = spark.createDataFrame([(k, v) for k, v in enumerate([0.0, 0.1, 0.5, 0.8])], "k int, mean double")
    m = fragility.curve_metrics(c).first()
    assert abs(m.auc_raw - 1.4) < 1e-12 and abs(m.auc_norm - 0.35) < 1e-12 and m.critical_k == 3 and m.jump_k == 2 and abs(m.jump_size - 0.4) < 1e-12
    s = fragility.level_stats(spark.createDataFrame([(0, float(v)) for v in (4, 1, 3, 2)], "k int, value double")).first()
    assert (s.p25, s.p50, s.p75, s.p90) == (2.0, 3.0, 4.0, 4.0)
    w = fragility.weight_sensitivity(spark.createDataFrame([(1, 1.0, 0.0, 0.0, 0.0)], "area int, bridge double, connectivity double, accessibility double, fragility double"), fragility.AREA_WEIGHTS)
    assert w.count() == 4
    with pytest.raises(ValueError):
        fragility.weight_sensitivity(w, fragility.AREA_WEIGHTS, points=1)


def test_location(spark):
    nodes = spark.createDataFrame([(r * 6 + c, 35 + 0.01 * r, -83 + 0.01 * c) for r in range(6) for c in range(6)], "node_id long, lat double, lon double")
    grid = RoadGraph(nodes, grid_graph(spark, 6, 6).edges)
    cfg = fragility.LocationConfig(radius_m=20000, runs=4, samples=20)
    a = fragility.location_summary(fragility.location_fragility(grid, 35.02, -82.98, cfg)).first()
    chain_nodes = spark.createDataFrame([(i, 35.0, -83 + 0.005 * i) for i in range(20)], "node_id long, lat double, lon double")
    chain = RoadGraph(chain_nodes, grid_graph(spark, 1, 20).edges)
    b = fragility.location_summary(fragility.location_fragility(chain, 35.0, -82.95, cfg)).first()
    assert 0 <= a.isolation_risk < b.isolation_risk <= 1


def test_topology_frames(spark):
    g = tree_graph(spark, 20, 0)
    assert topology.bridges(g).count() == 19
    two = graph(spark, 7, both([(0, 1, 1), (1, 2, 1), (4, 5, 1)]))
    assert {r.node_id: r.component for r in topology.components(two).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4, 6: 6}
    s, report = topology.simplify(graph(spark, 5, both([(0, 1, 1), (1, 2, 2), (2, 3, 3), (3, 4, 4)])), preserve_bridges=False)
    assert sorted((r.src, r.dst, r.weight) for r in s.edges.collect()) == [(0, 4, 10.0), (4, 0, 10.0)] and report.count() == 2


def test_samplers(spark):
    g = grid_graph(spark, 8, 8)
    for how in ("uniform", "importance"):
        a, b = (sorted(r.edge_id for r in sampling.sample_edges(g, 20, how).collect()) for _ in range(2))
        assert a == b and len(set(a)) == 20
    assert sampling.sample_od(g, 40, pilot=80).count() > 0
    e, v = centrality.betweenness(g)
    assert e.count() == g.edges.count() and v.count() == 64
    alt = paths.alternative_routes(g, spark.createDataFrame([(0, 0, 63)], "od_id long, src long, dst long")).collect()
    assert alt and all(r.sharing < 0.8 and r.stretch <= 1.25 for r in alt)


def test_regional_isolation(spark):
    nodes = spark.createDataFrame([(r * 6 + c, 35 + 0.01 * r, -83 + 0.01 * c) for r in range(6) for c in range(6)], "node_id long, lat double, lon double")
    a = nodes.selectExpr("node_id", "cast(if(node_id < 18, 0, 1) as int) as region_idx")
    got = {r.region_idx: r for r in fragility.regional_isolation(RoadGraph(nodes, grid_graph(spark, 6, 6).edges), a, fragility.LocationConfig(runs=3, samples=10)).collect()}
    assert got.keys() == {0, 1} and all(r.nodes == 18 and r.edges == 54 and 0 <= r.baseline <= r.isolation_risk <= 1 for r in got.values())
