"""Many searches side by side as numpy arrays; the same answers as the searches of ``kernels``, for graphs without zero weights.

A cell is a (search, node) pair, numbered search * n + node.  Cells are settled in rounds of a distance width; a cell whose distance
still falls within its round is taken again, so distances never depend on the width.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

from spanweave.graph import LocalGraph

INF = np.inf
CELLS = 1_200_000  # cells of one batch whose edges are looked at together
FAR_CELLS = 8_000_000  # cells of one batch that is only searched
SUM_CELLS = 4_000_000  # cells of one batch whose dependencies are summed


def batch_size(g: LocalGraph, cells: int = CELLS) -> int:
    """Searches that fit a batch."""
    return max(1, cells // max(1, g.n))


def pair_batch(g: LocalGraph) -> int:
    """Pairs whose searches fit a batch; few searches of a large graph fill a round already."""
    return batch_size(g, FAR_CELLS if g.n < CELLS // 4 else CELLS)


def positions(g: LocalGraph, ids) -> np.ndarray:
    """Positions of ids, -1 where the graph has none."""
    ids = np.asarray(ids, np.int64)
    at = np.minimum(np.searchsorted(g.ids, ids), max(0, g.n - 1))
    return np.where(g.ids[at] == ids, at, -1) if g.n else np.full(len(ids), -1)


def least_weight(g: LocalGraph) -> float:
    return float(g.weight.min()) if len(g.weight) else 1.0


def round_width(g: LocalGraph) -> float:
    """Width for searches of pairs: few cells lie in a round of the least weight, and a few taken again cost less than more rounds."""
    return max(least_weight(g), float(g.weight.mean()) / 2) if len(g.weight) else 1.0


def _edges(offset: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edge numbers of all rows of ``nodes``, and for each its place in ``nodes``."""
    first = offset[nodes]
    count = offset[nodes + 1] - first
    place = np.repeat(np.arange(len(nodes)), count)
    return np.arange(len(place)) + np.repeat(first - (np.cumsum(count) - count), count), place


class Search:
    """A search for each of ``starts`` over ``rows`` (offsets, targets, weights), as far as it is asked to go.

    ``dist``: distances of every cell, flat; those beyond the way gone are upper bounds.  ``bound(cells, dist, edges)``: which of the
    cells are worth going to at that distance over these edges.
    """

    def __init__(self, n: int, rows: tuple[np.ndarray, np.ndarray, np.ndarray], starts: np.ndarray, width: float, bound=None):
        self.n, self.rows, self.width, self.bound = n, rows, width, bound
        self.dist = np.full(len(starts) * n, INF)
        self.mark = np.zeros(len(self.dist), np.int32)
        first = np.arange(len(starts)) * n + starts
        self.dist[first] = 0.0
        self.buckets, self.order = {0: [first]}, [0]

    def goals(self, cells: np.ndarray) -> np.ndarray:
        """Distances of ``cells``, for which no search goes further than the furthest of them."""
        while self.order and self.order[0] <= self.dist[cells].max(initial=0.0) / self.width:
            self._round()
        return self.dist[cells]

    def upto(self, most: float = INF) -> np.ndarray:
        """Distances up to ``most``."""
        while self.order and self.order[0] <= most / self.width:
            self._round()
        return self.dist

    def _round(self) -> None:
        n, width, bound, dist, mark, buckets, order = self.n, self.width, self.bound, self.dist, self.mark, self.buckets, self.order
        offset, to, weight = self.rows
        k = heapq.heappop(order)
        cells = buckets.pop(k)
        cells = np.concatenate(cells) if len(cells) > 1 else cells[0]
        cells = cells[dist[cells] / width >= k]  # others were settled in an earlier round
        mark[cells] = np.arange(len(cells))
        cells = cells[mark[cells] == np.arange(len(cells))]
        if not len(cells):
            return
        at = cells % n
        e, place = _edges(offset, at)
        goal = (cells - at)[place] + to[e]
        d = dist[cells][place] + weight[e]
        ok = d < dist[goal]
        if bound is not None:
            ok &= bound(goal, d, e)
        goal, d = goal[ok], d[ok]
        np.minimum.at(dist, goal, d)
        ok = dist[goal] == d
        goal = goal[ok]
        if not len(goal):
            return
        b = (d[ok] / width).astype(np.int64)
        low, high = int(b.min()), int(b.max())
        if high - low > 40:
            by = np.argsort(b, kind="stable")
            cuts = np.flatnonzero(np.diff(b[by])) + 1
            parts = [(int(b[x[0]]), goal[x]) for x in np.split(by, cuts)]
        else:
            parts = [(j, goal[b == j]) for j in range(low, high + 1)] if high > low else [(low, goal)]
        for j, x in parts:
            if len(x):
                if j not in buckets:
                    buckets[j] = []
                    heapq.heappush(order, j)
                buckets[j].append(x)


def spread(n: int, rows: tuple[np.ndarray, np.ndarray, np.ndarray], starts: np.ndarray, width: float, bound=None) -> np.ndarray:
    """Distances of every cell of a whole ``Search``."""
    return Search(n, rows, starts, width, bound).upto()


def before(n: int, back: tuple[np.ndarray, np.ndarray, np.ndarray], dist: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The cell before each of ``cells`` on its shortest path, nearest to the start and then of the lowest node, as a search by
    (distance, node) finds it; -1 at starts."""
    offset, source, weight = back
    at = cells % n
    e, place = _edges(offset, at)
    prior = (cells - at)[place] + source[e]
    d = dist[prior]
    tight = (d + weight[e] == dist[cells][place]) & np.isfinite(d)
    place, prior, d = place[tight], prior[tight], d[tight]
    out = np.full(len(cells), -1, np.int64)
    least = np.full(len(cells), INF)
    np.minimum.at(least, place, d)
    best = d == least[place]
    place, prior = place[best][::-1], prior[best][::-1]  # the last write is of the lowest node
    out[place] = prior
    return out


def walks(n: int, dist: np.ndarray, back: tuple, goals: np.ndarray) -> list[np.ndarray]:
    """Cells from the start of each goal cell's search to it; empty if it is not reached."""
    steps, now = [np.where(np.isfinite(dist[goals]), goals, -1)], None
    alive = np.flatnonzero(steps[0] >= 0)
    while len(alive):
        now = np.full(len(goals), -1, np.int64)
        now[alive] = before(n, back, dist, steps[-1][alive])
        steps.append(now)
        alive = np.flatnonzero(now >= 0)
    table = np.stack(steps, 1)
    return [row[row >= 0][::-1] for row in table]


def brandes(g: LocalGraph, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted dependencies of edges and nodes, summed over ``sources``; as ``kernels.brandes`` without a limit."""
    n, m, step = g.n, len(g.src), least_weight(g) * 0.999
    fresh = np.ones(m, bool)
    fresh[1:] = (g.src[1:] != g.src[:-1]) | (g.dst[1:] != g.dst[:-1])  # heavier parallel copies don't count
    own = np.flatnonzero(fresh)
    src, dst, weight = g.src[own], g.dst[own], g.weight[own]
    edge, node = np.zeros(m), np.zeros(n)
    size = batch_size(g, SUM_CELLS if n < CELLS // 4 else CELLS)  # few searches of a large graph fill a round already
    for lo in range(0, len(sources), size):
        part = sources[lo : lo + size]
        dist = spread(n, (g.offset, g.dst, g.weight), part, least_weight(g))
        ends = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k in range(len(part)):
            d = dist[k * n : (k + 1) * n]
            with np.errstate(invalid="ignore"):
                tight = np.flatnonzero(np.abs(d[src] + weight - d[dst]) <= 1e-10)
            for x, y in zip(ends, (src[tight].astype(np.int64) + k * n, dst[tight].astype(np.int64) + k * n, own[tight]), strict=True):
                x.append(y)
        u, v, e = (np.concatenate(x) for x in ends)
        level = dist[v] / step
        level = level.astype(np.uint16 if level.max(initial=0) < 65536 else np.int64)  # short numbers are sorted by radix
        by = np.argsort(level, kind="stable")
        u, v, e, level = u[by], v[by], e[by], level[by]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(level)) + 1, [len(level)]])
        sigma, delta = np.zeros(len(dist)), np.zeros(len(dist))
        first = np.arange(len(part)) * n + part
        sigma[first] = 1.0
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            np.add.at(sigma, v[a:b], sigma[u[a:b]])
        share = np.zeros(len(e))
        for a, b in zip(cuts[-2::-1], cuts[:0:-1], strict=True):
            c = sigma[u[a:b]] / sigma[v[a:b]] * (1 + delta[v[a:b]])
            share[a:b] = c
            np.add.at(delta, u[a:b], c)
        edge += np.bincount(e, share, m)
        delta[first] = 0.0
        node += delta.reshape(len(part), n).sum(0)
    return edge, node


def replacements(g: LocalGraph, source: np.ndarray, target: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each pair the nodes of its shortest path, their distances, and the pair's distance without each of the path's edges.

    Detours are searched from the target among nodes that lie on some way not longer than a bound; edges that no detour within the
    bound replaces are searched again with a wider one, at last with none.  A detour found within a bound is exact.
    """
    n, out = g.n, [(np.empty(0, np.int64), np.empty(0), np.empty(0))] * len(source)
    step, wide = round_width(g), float(g.weight.max()) if len(g.weight) else 1.0
    froms = (g.offset, g.dst, g.weight)
    by = np.argsort(source, kind="stable")
    size = pair_batch(g)
    for lo in range(0, len(by), size):
        part = by[lo : lo + size]
        starts, row = np.unique(source[part], return_inverse=True)
        search = Search(n, froms, starts, step)
        goal = row * n + target[part]
        search.goals(goal)
        ahead = search.dist
        ways = walks(n, ahead, g.back, goal)
        todo = np.array([k for k, w in enumerate(ways) if len(w) > 1], np.int64)
        costs = {int(k): np.full(len(ways[k]) - 1, INF) for k in todo}
        for slack in (2 * wide, 8 * wide, 40 * wide, INF):
            if not len(todo):
                break
            search.upto(ahead[goal[todo]].max() + 1.01 * slack)
            found = _detours(g, ahead, row[todo], target[part][todo], [ways[k] % n for k in todo], ahead[goal[todo]] + slack, step)
            left = []
            for k, c in zip(todo.tolist(), found, strict=True):
                costs[k] = np.minimum(costs[k], c)
                if not np.isfinite(costs[k]).all():
                    left.append(k)
            todo = np.array(left, np.int64)
        for k, at in enumerate(part.tolist()):
            if k in costs:
                out[at] = (ways[k] % n, ahead[ways[k]], costs[k])
    return out


def _detours(g: LocalGraph, ahead: np.ndarray, row: np.ndarray, target: np.ndarray, ways: list[np.ndarray], most: np.ndarray, step: float) -> list[np.ndarray]:
    """Least detour of at most ``most`` around each edge of each path; ``ahead``: distances from sources, a pair's being in ``row``."""
    n, most = g.n, most * (1 + 1e-9)
    shift = (row - np.arange(len(row))) * n  # from a pair's cell to its source's

    def bound(cells: np.ndarray, d: np.ndarray, _) -> np.ndarray:
        k = cells // n
        return d + ahead[cells + shift[k]] <= most[k]

    rest = spread(n, g.back, target, step, bound)
    local = np.full(len(rest), -1, np.int32)
    return [x for lo, hi, cells in _lots(n, rest) for x in _around(g, ahead, rest, cells, shift, local, lo, ways[lo:hi], most)]


def _lots(n: int, rest: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Ranges of searches whose reached cells are looked at together, one search at least, and these cells."""
    every = np.flatnonzero(np.isfinite(rest))
    ends = np.searchsorted(every, np.arange(len(rest) // n + 1) * n)
    lo = 0
    while lo < len(ends) - 1:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + CELLS, "right")) - 1)
        yield lo, hi, every[ends[lo] : ends[hi]]
        lo = hi


def _around(g: LocalGraph, ahead: np.ndarray, rest: np.ndarray, cells: np.ndarray, shift: np.ndarray, local: np.ndarray, lo: int, ways: list[np.ndarray], most: np.ndarray) -> list[np.ndarray]:
    """Least detours over ``cells``, those of the pairs from ``lo`` on; ``local``: -1 for every cell, before and after."""
    n = g.n
    pair = cells // n
    here = cells + shift[pair]
    front = np.isfinite(ahead[here])
    cells, pair, here = cells[front], pair[front], here[front]
    local[cells] = np.arange(len(cells))
    length = np.array([len(w) - 1 for w in ways])
    base = np.concatenate([[0], np.cumsum(length)])
    on = np.concatenate([(lo + k) * n + w for k, w in enumerate(ways)])
    place = np.full(len(cells), -1, np.int64)
    place[local[on]] = np.concatenate([np.arange(len(w)) for w in ways])

    def leaves(prior: np.ndarray) -> np.ndarray:
        """Position on the path where each cell's tree path meets it; on the path itself the tree is the path."""
        up = np.where(place >= 0, np.arange(len(cells)), local[np.where(place >= 0, 0, prior)])
        while True:
            nxt = up[up]
            if (nxt == up).all():
                return place[up]
            up = nxt

    head = leaves(before(n, g.back, ahead, here) - shift[pair])
    tail = leaves(before(n, (g.offset, g.dst, g.weight), rest, cells))
    e, at = _edges(g.offset, cells - pair * n)
    goal = (pair * n)[at] + g.dst[e]
    cost = ahead[here][at] + g.weight[e] + rest[goal]
    to = local[goal]
    local[cells] = -1
    ok = (to >= 0) & (cost <= most[pair[at]])
    at, to, cost = at[ok], to[ok], cost[ok]
    a, b = head[at], tail[to]
    ok = (a >= 0) & (a < b) & ~((place[at] >= 0) & (place[to] == place[at] + 1))
    a, b, cost, first = a[ok], b[ok], cost[ok], base[pair[at[ok]] - lo]
    level = np.frexp((b - a).astype(float))[1] - 1
    top = int(level.max(initial=0))
    table = np.full((top + 1, base[-1]), INF)
    np.minimum.at(table, (level, first + a), cost)
    np.minimum.at(table, (level, first + b - (1 << level)), cost)
    for j in range(top, 0, -1):
        h = 1 << (j - 1)
        np.minimum(table[j - 1], table[j], out=table[j - 1])
        np.minimum(table[j - 1][h:], table[j][: -h or None], out=table[j - 1][h:])
    return [table[0][base[k] : base[k + 1]] for k in range(len(ways))]


def _summed(up: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Sums of each of ``values`` (of the step from a cell to the one before it) from the roots of a forest to every cell; roots are their own ``up``."""
    out = [np.where(up == np.arange(len(up)), v.dtype.type(0), v) for v in values]
    while True:
        out = [v + v[up] for v in out]
        nxt = up[up]
        if (nxt == up).all():
            return out
        up = nxt


def alternatives(g: LocalGraph, source: np.ndarray, target: np.ndarray, stretch: float, sharing: float, k: int) -> Iterator[tuple[int, list[tuple[int, float, np.ndarray, float, float]]]]:
    """(pair, up to ``k`` of (via, distance, route, sharing, stretch)) of pairs that have any, in lots; as ``paths.alternative_routes`` on single searches.

    Vias come by distance, so a search within a bound gives the first routes; pairs with fewer than ``k`` are searched again with a
    wider one, at last with all the stretch.
    """
    n, step, wide = g.n, round_width(g), float(g.weight.max()) if len(g.weight) else 1.0
    by = np.argsort(source, kind="stable")
    size = pair_batch(g)
    for lo in range(0, len(by), size):
        part = by[lo : lo + size]
        starts, row = np.unique(source[part], return_inverse=True)
        search = Search(n, (g.offset, g.dst, g.weight), starts, step)
        goal = row * n + target[part]
        search.goals(goal)
        ahead = search.dist
        ways = walks(n, ahead, g.back, goal)
        todo = np.array([j for j, w in enumerate(ways) if len(w) > 1], np.int64)
        for slack in (2 * wide, 8 * wide, INF):
            if not len(todo):
                break
            far = ahead[goal[todo]]
            most = np.minimum(stretch * far, far + slack)
            search.upto(1.01 * most.max())
            found = _vias(g, ahead, row[todo], target[part][todo], [ways[j] % n for j in todo], most, sharing, k, step)
            left = []
            for j, routes, m, d in zip(todo.tolist(), found, most.tolist(), far.tolist(), strict=True):
                if len(routes) < k and m < stretch * d:
                    left.append(j)
                elif routes:
                    yield int(part[j]), [(v, c, way, x, c / d) for v, c, way, x in routes]
            todo = np.array(left, np.int64)


def _vias(g: LocalGraph, ahead: np.ndarray, row: np.ndarray, target: np.ndarray, ways: list[np.ndarray], most: np.ndarray, sharing: float, k: int, step: float) -> list[list[tuple[int, float, np.ndarray, float]]]:
    """The first ``k`` routes (via, distance, route, sharing) of each pair over vias off its path, among those of at most ``most``."""
    n, wider = g.n, most * (1 + 1e-9)
    shift = (row - np.arange(len(row))) * n  # from a pair's cell to its source's

    def bound(cells: np.ndarray, d: np.ndarray, _) -> np.ndarray:
        j = cells // n
        return d + ahead[cells + shift[j]] <= wider[j]

    rest = spread(n, g.back, target, step, bound)
    local = np.full(len(rest), -1, np.int32)
    return [x for lo, hi, cells in _lots(n, rest) for x in _via_lot(g, ahead, rest, cells, shift, local, lo, ways[lo:hi], most, sharing, k)]


def _via_lot(g: LocalGraph, ahead: np.ndarray, rest: np.ndarray, cells: np.ndarray, shift: np.ndarray, local: np.ndarray, lo: int, ways: list[np.ndarray], most: np.ndarray, sharing: float, k: int) -> list[list[tuple[int, float, np.ndarray, float]]]:
    """First routes over ``cells``, those of the pairs from ``lo`` on; ``local``: -1 for every cell, before and after."""
    n = g.n
    cells = cells[np.isfinite(ahead[cells + shift[cells // n]])]
    pair, at = cells // n, cells % n
    here = cells + shift[pair]
    local[cells] = np.arange(len(cells))
    place = np.full(len(cells), -1, np.int64)
    place[local[np.concatenate([(lo + j) * n + w for j, w in enumerate(ways)])]] = np.concatenate([np.arange(len(w)) for w in ways])
    itself, totals, trees = np.arange(len(cells)), [], []
    for rows, dist, own, forward in ((g.back, ahead, here, True), ((g.offset, g.dst, g.weight), rest, cells, False)):
        prior = before(n, rows, dist, own)
        up = np.where(prior >= 0, local[np.where(prior >= 0, prior - (shift[pair] if forward else 0), 0)], itself)
        a, b = (up, itself) if forward else (itself, up)  # the step's ends as it is walked
        shared = (place[a] >= 0) & (place[b] == place[a] + 1)
        edge = (at[a] * n + at[b]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        edge = (edge ^ (edge >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        totals.append(_summed(up, np.full(len(up), 1 << 24) + shared, edge ^ (edge >> np.uint64(32))))
        trees.append(up)
    local[cells] = -1
    steps, mark = (x + y for x, y in zip(*totals, strict=True))
    share = (steps & ((1 << 24) - 1)) / np.maximum(1, steps >> 24)
    cost = ahead[here] + rest[cells]
    # a via whose ways to and from it use the same neighbour gives a route that turns round
    ok = np.flatnonzero((place < 0) & (cost <= most[pair]) & (share < sharing) & (trees[0] != trees[1]))
    ok = ok[np.lexsort((at[ok], cost[ok], pair[ok]))]
    # vias of one route have the same edges: its first is kept
    same = np.lexsort((np.arange(len(ok)), mark[ok], pair[ok]))
    new = np.ones(len(ok), bool)
    new[1:] = (mark[ok][same][1:] != mark[ok][same][:-1]) | (pair[ok][same][1:] != pair[ok][same][:-1])
    ok = ok[np.sort(same[new])]
    out: list[list] = [[] for _ in ways]
    first, last = (np.searchsorted(pair[ok], lo + np.arange(len(ways)), side) for side in ("left", "right"))
    while len(some := np.flatnonzero((first < last) & (np.array([len(x) for x in out]) < k))):
        stop = np.minimum(first[some] + 2 * k, last[some])
        lot = ok[np.concatenate([np.arange(a, b) for a, b in zip(first[some], stop, strict=True)])]
        first[some] = stop
        for v, to, fro in zip(lot.tolist(), _chains(trees[0], lot), _chains(trees[1], lot), strict=True):
            routes = out[pair[v] - lo]
            if len(routes) == k:
                continue
            way = at[np.concatenate([to[::-1], fro[1:]])]
            if len(np.unique(way)) == len(way):
                routes.append((int(at[v]), float(cost[v]), way, float(share[v])))
    return out


def _chains(up: np.ndarray, cells: np.ndarray) -> list[np.ndarray]:
    """From each of ``cells`` to its root."""
    steps, now = [cells], cells
    while (up[now] != now).any():
        now = up[now]
        steps.append(now)
    table = np.stack(steps, 1)
    ends = (table != table[:, -1:]).sum(1)
    return [r[: e + 1] for r, e in zip(table, ends.tolist(), strict=True)]


def cut_pairs(g: LocalGraph) -> np.ndarray:
    """Sorted keys (lower * n + higher node) of pairs that only the edges between the two hold together, directions ignored.

    Tarjan's bridges by any spanning forest, here level by level: a subtree whose other edges all stay inside it hangs by one link.
    """
    n = g.n
    u, v = g.src.astype(np.int64), g.dst.astype(np.int64)
    keys = np.unique(np.concatenate([u * n + v, v * n + u])[np.tile(u != v, 2)])
    u, v = keys // max(1, n), keys % max(1, n)
    offset = np.searchsorted(u, np.arange(n + 1))
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        if (a == b).all():
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    front = np.flatnonzero(root == np.arange(n))
    seen, parent, levels = np.zeros(n, bool), np.full(n, -1, np.int64), []
    while len(front):
        seen[front] = True
        levels.append(front)
        e, place = _edges(offset, front)
        e, place = e[~seen[v[e]]], place[~seen[v[e]]]
        above = front[place]
        parent[v[e][::-1]] = above[::-1]
        front = v[e][parent[v[e]] == above]
    size = np.ones(n, np.int64)
    for x in levels[:0:-1]:
        np.add.at(size, parent[x], size[x])
    first = np.zeros(n, np.int64)
    for k, x in enumerate(levels):
        before_ = np.cumsum(size[x]) - size[x]
        if k:  # children of one node are neighbours in their level
            new = np.concatenate([[True], parent[x[1:]] != parent[x[:-1]]])
            before_ += 1 + first[parent[x]] - np.maximum.accumulate(np.where(new, before_, 0))
        first[x] = before_
    low, high = first.copy(), first.copy()
    other = (parent[u] != v) & (parent[v] != u)
    np.minimum.at(low, u[other], first[v[other]])
    np.maximum.at(high, u[other], first[v[other]])
    for x in levels[:0:-1]:
        np.minimum.at(low, parent[x], low[x])
        np.maximum.at(high, parent[x], high[x])
    x = np.flatnonzero((parent >= 0) & (low >= first) & (high < first + size))
    return np.sort(np.minimum(x, parent[x]) * n + np.maximum(x, parent[x]))


def bridges(g: LocalGraph) -> tuple[np.ndarray, np.ndarray]:
    """Ends (lower, higher) of undirected bridges with at most two directed copies, sorted; as ``kernels.bridges``."""
    keys, n = cut_pairs(g), max(1, g.n)
    u, v = g.src.astype(np.int64), g.dst.astype(np.int64)
    at = np.searchsorted(keys, np.minimum(u, v) * n + np.maximum(u, v))
    at = at[(at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == np.minimum(u, v) * n + np.maximum(u, v))] if len(keys) else at[:0]
    keys = keys[np.bincount(at, minlength=len(keys)) <= 2]
    return keys // n, keys % n


def without_edges(g: LocalGraph, source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Distance from each source to its target without the edges that join them directly; pairs that nothing else joins need no search."""
    n, out = g.n, np.full(len(source), INF)
    if getattr(g, "_cut", None) is None:
        g._cut = cut_pairs(g)  # once a process
    todo = np.flatnonzero(~np.isin(np.minimum(source, target) * n + np.maximum(source, target), g._cut))
    for lo in range(0, len(todo), batch_size(g)):
        part = todo[lo : lo + batch_size(g)]
        s, t = source[part], target[part]

        def bound(cells: np.ndarray, _, e: np.ndarray, s=s, t=t) -> np.ndarray:
            k = cells // n
            return (g.src[e] != s[k]) | (g.dst[e] != t[k])

        out[part] = spread(n, (g.offset, g.dst, g.weight), s, least_weight(g), bound)[np.arange(len(s)) * n + t]
    return out


# ---- pairs on large graphs ------------------------------------------------------------------------------------------------

LEAF = 12  # bits of the positions in the least interval


def depth(g: LocalGraph) -> int:
    """Level of the least intervals: positions are halved level by level."""
    return max(0, int(max(1, g.n - 1)).bit_length() - LEAF)


def common_levels(g: LocalGraph, source: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
    """By level, whether a pair lies in one interval."""
    return [(source >> (depth(g) + LEAF - k)) == (target >> (depth(g) + LEAF - k)) for k in range(depth(g) + 1)]


def chunks(level: int) -> int:
    """Tasks that an interval's crossing nodes are dealt to."""
    return max(1, 32 >> level)


class Interval:
    """The subgraph of a range of positions, and the nodes of its lower half with an edge from or to the upper half."""

    def __init__(self, g: LocalGraph, level: int, part: int):
        bits = depth(g) + LEAF - level
        self.low, self.high = part << bits, min(g.n, (part + 1) << bits)
        self.n, self.leaf, self.width = self.high - self.low, level == depth(g), least_weight(g)
        self.rows, self.back = self._cut((g.offset, g.dst, g.weight)), self._cut(g.back)
        mid = min(self.n, 1 << (bits - 1) if bits else 1)
        self.crossing = np.unique(np.concatenate([self._over(r, mid) for r in (self.rows, self.back)]))
        self.same = all(np.array_equal(a, b) for a, b in zip(self.rows, self.back, strict=True))

    def _cut(self, rows: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        offset, to, weight = rows
        a, b = int(offset[self.low]), int(offset[self.high])
        to, weight = to[a:b], weight[a:b]
        ok = (to >= self.low) & (to < self.high)
        return np.concatenate([[0], np.cumsum(ok)])[offset[self.low : self.high + 1] - a], to[ok] - np.int32(self.low), weight[ok]

    def _over(self, rows: tuple, mid: int) -> np.ndarray:
        offset, to, _ = rows
        e = np.flatnonzero(to[: offset[mid]] >= mid)
        return np.searchsorted(offset, e, "right") - 1


def _apart(n: int) -> int:
    return max(1, FAR_CELLS // n)


def interval_distances(g: LocalGraph, level: int, part: int, chunk: int, source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least distance of pairs inside an interval, within it, by way of this chunk's share of its crossing nodes, and the best such
    node; in the least intervals, and where the pairs have fewer sources, by searches from the sources (node -1)."""
    own = Interval(g, level, part)
    s, t = source - own.low, target - own.low
    best, via = np.full(len(s), INF), np.full(len(s), -1, np.int64)
    starts, row = np.unique(s, return_inverse=True)
    if own.leaf or len(starts) <= len(own.crossing):
        ours = np.arange(len(starts)) % chunks(level) == chunk
        by = np.argsort(row, kind="stable")
        by = by[ours[row[by]]]
        kept = np.flatnonzero(ours)
        place = np.searchsorted(kept, row[by])
        for lo in range(0, len(kept), _apart(own.n)):
            d = spread(own.n, own.rows, starts[kept[lo : lo + _apart(own.n)]], own.width)
            x = slice(*np.searchsorted(place, [lo, lo + _apart(own.n)]))
            best[by[x]] = d[(place[x] - lo) * own.n + t[by[x]]]
        return best, via
    nodes = own.crossing[chunk :: chunks(level)]
    for lo in range(0, len(nodes), _apart(own.n)):
        x = nodes[lo : lo + _apart(own.n)]
        out = spread(own.n, own.rows, x, own.width).reshape(len(x), own.n)
        into = out if own.same else spread(own.n, own.back, x, own.width).reshape(len(x), own.n)
        for k in range(len(x)):
            d = into[k][s] + out[k][t]
            better = d < best
            best[better], via[better] = d[better], x[k] + own.low
    return best, via


def parents(n: int, back: tuple[np.ndarray, np.ndarray, np.ndarray], dist: np.ndarray) -> np.ndarray:
    """The node before every node of one search, -1 where there is none."""
    out = np.full(n, -1, np.int64)
    cells = np.flatnonzero(np.isfinite(dist))
    for lo in range(0, len(cells), CELLS // 4):
        part = cells[lo : lo + CELLS // 4]
        out[part] = before(n, back, dist, part)
    return out


def climb(prior: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Nodes from each of ``starts`` up the tree of ``prior`` to its root."""
    steps, now = [starts], starts
    while True:
        now = np.where(now >= 0, prior[now], -1)
        if (now < 0).all():
            break
        steps.append(now)
    table = np.stack(steps, 1)
    return [row[row >= 0] for row in table]


def interval_paths(g: LocalGraph, level: int, part: int, via: np.ndarray, source: np.ndarray, target: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Shortest paths within an interval by way of the node of each pair (-1: straight from its source), in small lots: (pairs, paths)."""
    own = Interval(g, level, part)
    root = np.where(via >= 0, via, source) - own.low
    s, t = source - own.low, target - own.low
    by = np.argsort(root, kind="stable")
    for group in np.split(by, np.flatnonzero(np.diff(root[by])) + 1) if len(by) else []:
        x = root[group[0]]
        down = parents(own.n, own.back, spread(own.n, own.rows, np.array([x]), own.width))
        up = parents(own.n, own.rows, spread(own.n, own.back, np.array([x]), own.width)) if (via[group] >= 0).any() else None
        for lo in range(0, len(group), 64):
            lot = group[lo : lo + 64]
            after = [w[::-1] for w in climb(down, t[lot])]
            if up is not None:
                after = [np.concatenate([a[:-1], b]) for a, b in zip(climb(up, s[lot]), after, strict=True)]
            yield lot, [own.low + w for w in after]
