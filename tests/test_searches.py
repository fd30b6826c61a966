"""Searches side by side that stop early, and whose weights are not whole numbers."""

import numpy as np

from spanweave.graph import LocalGraph
from spanweave.operators import batches
from spanweave.operators.kernels import dijkstra


def test_distances_on_the_edge_of_a_round():
    """1.7 lies in round 17 of width 0.1, though 17 * 0.1 is a little more."""
    g = LocalGraph(np.arange(3), np.array([0, 1]), np.array([1, 2]), np.array([1.7, 0.1]))
    assert batches.spread(3, (g.offset, g.dst, g.weight), np.array([0]), 0.1).tolist() == [0.0, 1.7, 1.7 + 0.1]


def test_a_search_goes_as_far_as_its_goals_and_on():
    rng = np.random.default_rng(7)
    n = 200
    g = LocalGraph(np.arange(n), rng.integers(0, n, 700), rng.integers(0, n, 700), rng.integers(1, 30, 700) / 10)
    want = np.array([dijkstra(g.adjacent, s)[0] for s in (3, 90)]).ravel()
    for goals in ([5, n + 6], [17], [n + 120, 199]):
        search = batches.Search(n, (g.offset, g.dst, g.weight), np.array([3, 90]), batches.least_weight(g))
        np.testing.assert_allclose(search.goals(np.array(goals)), want[goals])
        most = want[goals][np.isfinite(want[goals])].max() + 1
        near = want <= most
        np.testing.assert_allclose(search.upto(most)[near], want[near])
        assert (search.dist[~near] > most).all()
        np.testing.assert_allclose(search.upto(), want)


def test_many_pairs_are_searched_together_and_looked_at_in_lots(monkeypatch):
    """Detours of a batch of pairs, its edges looked at a few pairs at a time, are those of a search without each edge."""
    rows, cols = 9, 5
    ids = np.arange(rows * cols).reshape(rows, cols)
    a, b = np.r_[ids[:, :-1].ravel(), ids[:-1].ravel()], np.r_[ids[:, 1:].ravel(), ids[1:].ravel()]
    w = np.random.default_rng(3).integers(1, 9, len(a)).astype(float)
    g = LocalGraph(ids.ravel(), np.r_[a, b], np.r_[b, a], np.r_[w, w])
    lots, own = [], batches._around
    monkeypatch.setattr(batches, "_around", lambda *x: lots.append(len(x[3])) or own(*x))
    monkeypatch.setattr(batches, "CELLS", 5 * g.n)
    rng = np.random.default_rng(5)
    s, t = rng.integers(0, g.n, 40), rng.integers(0, g.n, 40)
    found = batches.replacements(g, s, t)
    assert len(lots) > 2 and max(lots) <= 5 * g.n
    for u, v, (way, far, cost) in zip(s.tolist(), t.tolist(), found, strict=True):
        if u == v:
            assert not len(way)
            continue
        assert far[-1] == dijkstra(g.adjacent, u)[0][v]
        assert cost.tolist() == [dijkstra(g.adjacent, u, {e}, v)[0][v] for e in zip(way.tolist(), way.tolist()[1:])]
    assert batches.round_width(g) > batches.least_weight(g)
    monkeypatch.setattr(batches, "CELLS", 1_200_000)
    assert batches.pair_batch(g) > batches.batch_size(g)


def test_alternative_routes_in_lots_of_pairs(monkeypatch):
    """Routes don't depend on how many pairs are looked at together."""
    ids = np.arange(63).reshape(9, 7)
    a, b = np.r_[ids[:, :-1].ravel(), ids[:-1].ravel()], np.r_[ids[:, 1:].ravel(), ids[1:].ravel()]
    w = np.random.default_rng(4).integers(1, 9, len(a)).astype(float)
    g = LocalGraph(ids.ravel(), np.r_[a, b], np.r_[b, a], np.r_[w, w])
    rng = np.random.default_rng(6)
    s, t = rng.integers(0, g.n, 30), rng.integers(0, g.n, 30)
    routes = lambda: {j: [(v, c, way.tolist(), x) for v, c, way, x, _ in r] for j, r in batches.alternatives(g, s, t, 1.4, 0.8, 3)}
    lots, own = [], batches._via_lot
    monkeypatch.setattr(batches, "_via_lot", lambda *x: lots.append(len(x[3])) or own(*x))
    whole, at_once = routes(), len(lots)
    monkeypatch.setattr(batches, "CELLS", 5 * g.n)
    assert len(whole) > 10 and routes() == whole
    assert len(lots) > 2 * at_once and max(lots[at_once:]) <= 5 * g.n
