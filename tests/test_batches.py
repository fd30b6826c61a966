"""Searches side by side and by intervals against single searches."""

import numpy as np
import pytest

from spanweave.graph import LocalGraph, RoadGraph
from spanweave.operators import batches, kernels, paths


def random_graph(seed: int, both: bool = True) -> LocalGraph:
    rng = np.random.default_rng(seed)
    n = int(rng.integers(20, 100))
    m = int(n * rng.uniform(1, 3))
    s = rng.integers(0, n, m)
    d = np.clip(s + rng.integers(-6, 7, m), 0, n - 1) if seed % 4 else rng.integers(0, n, m)
    w = rng.integers(1, 5, m).astype(float) if seed % 2 else rng.uniform(0.1, 3, m)
    return LocalGraph(np.arange(n), np.concatenate([s, d]), np.concatenate([d, s]), np.concatenate([w, w])) if both else LocalGraph(np.arange(n), s, d, w)


@pytest.mark.parametrize("seed", range(8))
def test_replacements_and_dependencies(seed):
    g, rng = random_graph(seed), np.random.default_rng(seed)
    s, t = rng.integers(0, g.n, 40), rng.integers(0, g.n, 40)
    for (way, along, cost), a, b in zip(batches.replacements(g, s, t), s.tolist(), t.tolist(), strict=True):
        d, p = kernels.dijkstra(g.adjacent, a)
        want = kernels.path_to(p, a, b) if a != b else []
        assert way.tolist() == want and along.tolist() == [d[v] for v in want]
        np.testing.assert_allclose(cost, [kernels.dijkstra(g.adjacent, a, {x}, b)[0][b] for x in zip(want, want[1:])])
    one = [kernels.brandes(g, k) for k in range(g.n)]
    for got, want in zip(batches.brandes(g, np.arange(g.n)), (sum(x) for x in zip(*one, strict=True)), strict=True):
        np.testing.assert_allclose(got, want, atol=1e-9)


@pytest.mark.parametrize("seed", range(8))
def test_pairs_by_intervals(spark, monkeypatch, seed):
    monkeypatch.setattr(batches, "LEAF", 3)
    g, rng = random_graph(seed, seed % 3 == 0), np.random.default_rng(seed)
    s, t = rng.integers(0, g.n, 100), rng.integers(0, g.n, 100)
    best = np.full(len(s), np.inf)
    for level, both in enumerate(batches.common_levels(g, s, t)):
        part = s >> (batches.depth(g) + batches.LEAF - level)
        for p in np.unique(part[both]).tolist():
            k = np.flatnonzero(both & (part == p))
            for chunk in range(batches.chunks(level)):
                best[k] = np.minimum(best[k], batches.interval_distances(g, level, p, chunk, s[k], t[k])[0])
    np.testing.assert_allclose(best, [kernels.dijkstra(g.adjacent, a)[0][b] for a, b in zip(s.tolist(), t.tolist(), strict=True)])


def test_large_graphs_give_the_same_distances_and_paths(spark, monkeypatch):
    rows, cols = 400, 30
    rng = np.random.default_rng(5)
    at = np.arange(rows * cols).reshape(rows, cols)
    a, b = (np.concatenate([x.ravel(), y.ravel()]) for x, y in ((at[:, :-1], at[:-1]), (at[:, 1:], at[1:])))
    w = rng.integers(1, 9, len(a)).astype(float)
    e = [(int(x), int(y), float(z)) for x, y, z in zip(np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w]), strict=True)]
    graph = RoadGraph.from_edges(spark.createDataFrame(e, "src long, dst long, weight double"))
    pairs = [(i, int(x), int(y)) for i, (x, y) in enumerate(rng.integers(0, rows * cols, (90, 2)))] + [(90, 3, 10**9)]
    od = spark.createDataFrame(pairs, "od_id long, src long, dst long")
    want = {r.od_id: r.dist for r in paths.distances(graph, od).collect()}
    monkeypatch.setattr(paths, "FAR_NODES", 100)
    monkeypatch.setattr(paths, "FEW_SOURCES", 1)
    assert {r.od_id: r.dist for r in paths.distances(graph, od).collect()} == want and want[90] is None
    cost = {(x, y): z for x, y, z in e}
    for r in paths.paths(graph, od).collect():
        _, x, y = pairs[r.od_id]
        assert r.dist == want[r.od_id] and (not r.path if r.dist is None else [r.path[0], r.path[-1]] == [x, y])
        assert r.dist is None or sum(cost[p] for p in zip(r.path, r.path[1:])) == r.dist


def test_the_graph_does_not_pass_through_the_driver(spark, monkeypatch):
    """Pickles of a graph hold the folder of its arrays, and large ones are walked without lists."""
    import pickle

    from spanweave import graph as module
    from spanweave.sources import loaders

    g = loaders.grid_graph(spark, 60, 60).local()
    assert len(pickle.dumps(g)) < 1000
    monkeypatch.setattr(module, "LISTS", 0)
    h = pickle.loads(pickle.dumps(g))
    assert isinstance(h.adjacent, module.Rows) and isinstance(h.reverse, module.Rows)
    assert kernels.dijkstra(h.adjacent, 7) == kernels.dijkstra(g.adjacent, 7) and kernels.dijkstra(h.reverse, 7)[0] == kernels.dijkstra(g.reverse, 7)[0]


def test_trips_by_intervals(spark, monkeypatch):
    from spanweave.plans import queries

    d = "/root/testdata/sf0.001"
    want = sorted(map(tuple, queries.QUERIES["g3_paths"](spark, d).collect()))
    monkeypatch.setattr(paths, "FAR_NODES", 10)
    monkeypatch.setattr(paths, "FEW_SOURCES", 1)
    assert sorted(map(tuple, queries.QUERIES["g3_paths"](spark, d).collect())) == want


@pytest.mark.parametrize("seed", range(12))
def test_pairs_that_nothing_else_joins_need_no_search(monkeypatch, seed):
    g = random_graph(seed, seed % 3 > 0)
    s, t = g.src.astype(np.int64), g.dst.astype(np.int64)
    s, t = np.concatenate([s, t]), np.concatenate([t, s])
    joined, both = set(zip(s.tolist(), t.tolist())), set()
    for a, b in joined:  # by removal, one pair at a time
        left, todo = {a}, [a]
        while todo:
            x = todo.pop()
            for y in {q for p, q in joined if p == x and {p, q} != {a, b}} - left:
                left.add(y)
                todo.append(y)
        if b not in left:
            both.add(min(a, b) * g.n + max(a, b))
    assert batches.cut_pairs(g).tolist() == sorted(both)
    want = [kernels.dijkstra(g.adjacent, a, {(a, b)}, b)[0][b] for a, b in zip(s.tolist(), t.tolist(), strict=True)]
    searched, own = [], batches.spread
    monkeypatch.setattr(batches, "spread", lambda n, rows, starts, *rest: searched.append(len(starts)) or own(n, rows, starts, *rest))
    np.testing.assert_allclose(batches.without_edges(g, s, t), want)
    assert sum(searched) == sum(min(a, b) * g.n + max(a, b) not in both for a, b in zip(s.tolist(), t.tolist(), strict=True))


@pytest.mark.parametrize("seed", range(12))
def test_bridges_level_by_level(seed):
    g = random_graph(seed, seed % 3 > 0)
    assert list(zip(*(x.tolist() for x in batches.bridges(g)), strict=True)) == kernels.bridges(g)


def test_bridges_of_no_edges_and_of_copies():
    none = np.empty(0, np.int64)
    for g in (LocalGraph(none, none, none, none.astype(float)), LocalGraph(np.arange(4), np.array([0, 1, 0, 2, 3, 3]), np.array([1, 0, 1, 3, 2, 3]), np.ones(6))):
        assert list(zip(*(x.tolist() for x in batches.bridges(g)), strict=True)) == kernels.bridges(g)


def routes_one_by_one(g: LocalGraph, s: int, t: int, stretch: float, sharing: float, k: int) -> list:
    """The definition on two single searches."""
    (d, p), (e, q) = kernels.dijkstra(g.adjacent, s), kernels.dijkstra(g.reverse, t)
    main = kernels.path_to(p, s, t)
    own, seen, out = set(zip(main, main[1:])), {tuple(main)}, []
    for c, v in sorted((d[v] + e[v], v) for v in range(g.n) if v not in main and d[v] + e[v] <= stretch * d[t] < np.inf):
        way = kernels.path_to(p, s, v) + kernels.path_to(q, t, v)[::-1][1:]
        if tuple(way) in seen or len(set(way)) < len(way):
            continue
        seen.add(tuple(way))
        shared = sum(x in own for x in zip(way, way[1:])) / (len(way) - 1)
        if shared < sharing and len(out) < k:
            out.append((v, c, way, shared, c / d[t]))
    return out


@pytest.mark.parametrize("seed", range(16))
def test_alternative_routes_side_by_side(seed):
    g, rng = random_graph(seed, seed % 3 > 0), np.random.default_rng(seed)
    s, t = rng.integers(0, g.n, 60), rng.integers(0, g.n, 60)
    s, t = s[s != t], t[s != t]
    for stretch, sharing, k in ((1.25, 0.8, 3), (3.0, 0.9, 5), (1.6, 0.3, 1)):
        got = {j: [(v, c, way.tolist(), x, y) for v, c, way, x, y in routes] for j, routes in batches.alternatives(g, s, t, stretch, sharing, k)}
        for j, (a, b) in enumerate(zip(s.tolist(), t.tolist(), strict=True)):
            assert got.get(j, []) == routes_one_by_one(g, a, b, stretch, sharing, k)


def test_alternative_routes_of_many_pairs_take_no_search_each(spark, monkeypatch):
    """Every route of sf0.001's pairs as single searches give it, without one of them in ``alternative_routes``."""
    from spanweave.plans import queries

    d = "/root/testdata/sf0.001"
    graph, od = queries.grid(spark, d), queries.pairs(spark, d)
    g, few = graph.local(), od.where("od_id % 25 = 0").toPandas()
    want = []
    for r in few.itertuples():
        found = routes_one_by_one(g, g.at(r.src), g.at(r.dst), 1.25, 0.8, 3) if g.at(r.src) >= 0 and g.at(r.dst) >= 0 else []
        want += [(r.od_id, k, int(g.ids[v]), c, g.ids[way].tolist(), x, y) for k, (v, c, way, x, y) in enumerate(found, 1)]
    monkeypatch.setattr(paths, "dijkstra", None)
    got = paths.alternative_routes(graph, od).where("od_id % 25 = 0").orderBy("od_id", "rank").collect()
    assert [tuple(r) for r in got] == want and want


def test_dependencies_of_many_sources_are_summed_together(monkeypatch):
    """A batch holds more searches than one whose edges are looked at, and levels may be more than a short number counts."""
    n = 1500
    at = np.arange(n)
    src, dst = np.concatenate([at[:-1], at[1:]]), np.concatenate([at[1:], at[:-1]])
    weight = np.tile(np.where(at[:-1] == 20, 100_000.0, 1.0), 2)
    g, searched, own = LocalGraph(at, src, dst, weight), [], batches.spread
    monkeypatch.setattr(batches, "spread", lambda n, rows, starts, *rest: searched.append(len(starts)) or own(n, rows, starts, *rest))
    edge, node = batches.brandes(g, at)
    assert searched == [n]
    np.testing.assert_allclose(node, 2 * at * (n - 1 - at))
    cut = np.maximum(g.src, g.dst)  # nodes before the edge
    np.testing.assert_allclose(edge, cut * (n - cut))


def test_paths_of_many_pairs_take_no_search_each(spark, monkeypatch):
    """The paths of single searches, ties included; unknown and equal ends, null ids and pairs without a way too."""
    rng = np.random.default_rng(3)
    e = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 60, 150), rng.integers(0, 60, 150), rng.integers(1, 4, 150), strict=True)]
    graph = RoadGraph.from_edges(spark.createDataFrame(e, "src long, dst long, weight double"))
    pairs = [(i, int(a), int(b)) for i, (a, b) in enumerate(rng.integers(0, 60, (300, 2)))] + [(900, 5, 5), (901, 5, 777), (902, 777, 5), (903, None, 5), (904, 5, None)]
    od = spark.createDataFrame(pairs, "od_id long, src long, dst long")
    g, want = graph.local(), {}
    for i, a, b in pairs:
        s, t = (g.at(x) if x is not None else -1 for x in (a, b))
        d, p = kernels.dijkstra(g.adjacent, s) if s >= 0 else ([], [])
        way = kernels.path_to(p, s, t) if s >= 0 and t >= 0 else []
        want[i] = (d[t] if way else None, [int(g.ids[v]) for v in way])
    assert any(w[0] is None for w in want.values()) and want[900] == (0.0, [5])
    monkeypatch.setattr(paths, "dijkstra", None)
    assert {r.od_id: (r.dist, r.path) for r in paths.paths(graph, od).collect()} == want
    assert paths.paths(graph, od.limit(0)).count() == 0
