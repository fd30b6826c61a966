"""Searches and decompositions on a local graph; pure Python and numpy, run inside tasks."""

from __future__ import annotations

import heapq
import math

import numpy as np

from spanweave.graph import LocalGraph

INF = math.inf


def dijkstra(adjacent: list, source: int, blocked: frozenset | set = frozenset(), target: int = -1, limit: float = INF) -> tuple[list[float], list[int]]:
    """Distances and predecessors (first strict improvement wins); ``blocked``: directed pairs; stops at ``target``."""
    n = len(adjacent)
    dist, pred, done = [INF] * n, [-1] * n, bytearray(n)
    dist[source] = 0.0
    heap = [(0.0, source)]
    while heap:
        d, u = heapq.heappop(heap)
        if done[u]:
            continue
        if u == target or d > limit:
            break
        done[u] = 1
        for v, w in adjacent[u]:
            nd = d + w
            if nd < dist[v] and not (blocked and (u, v) in blocked):
                dist[v], pred[v] = nd, u
                heapq.heappush(heap, (nd, v))
    return dist, pred


def nearest(adjacent: list, source: int, goal: set, most: float = INF) -> tuple[int, float]:
    """Nearest node of ``goal`` and its distance, lowest of equals; (-1, INF) if none is nearer than ``most``."""
    best, done = {source: 0.0}, set()
    heap = [(0.0, source)]
    found = (INF, -1)
    while heap and heap[0][0] <= found[0]:
        d, u = heapq.heappop(heap)
        if u in done:
            continue
        done.add(u)
        if u in goal:
            found = min(found, (d, u))
            continue
        for v, w in adjacent[u]:
            nd = d + w
            if nd < most and nd < best.get(v, INF):
                best[v] = nd
                heapq.heappush(heap, (nd, v))
    return found[1], found[0]


def path_to(pred: list[int], source: int, target: int) -> list[int]:
    """Nodes from source to target, empty if there is no way."""
    if source == target:
        return [source]
    if target < 0 or pred[target] < 0:
        return []
    out = [target]
    while out[-1] != source:
        out.append(pred[out[-1]])
    return out[::-1]


def both_ways(pairs) -> set[tuple[int, int]]:
    return {p for u, v in pairs for p in ((u, v), (v, u))}


def bridges(g: LocalGraph) -> list[tuple[int, int]]:
    """Undirected bridges (lo, hi) with at most two directed copies, by a depth-first search without recursion."""
    pairs, count = {}, {}
    for u, v in zip(g.src.tolist(), g.dst.tolist(), strict=True):
        if u != v:
            key = (u, v) if u < v else (v, u)
            count[key] = count.get(key, 0) + 1
            pairs[key] = None
    nbr: list[list[int]] = [[] for _ in range(g.n)]
    for u, v in pairs:
        nbr[u].append(v)
        nbr[v].append(u)
    seen, low, clock, out = [0] * g.n, [0] * g.n, 0, []
    for root in range(g.n):
        if seen[root]:
            continue
        clock += 1
        seen[root] = low[root] = clock
        stack = [(root, -1, iter(nbr[root]))]
        while stack:
            u, parent, rest = stack[-1]
            for v in rest:
                if not seen[v]:
                    clock += 1
                    seen[v] = low[v] = clock
                    stack.append((v, u, iter(nbr[v])))
                    break
                if v != parent:
                    low[u] = min(low[u], seen[v])
            else:
                stack.pop()
                if parent >= 0:
                    low[parent] = min(low[parent], low[u])
                    if low[u] > seen[parent]:
                        key = (min(u, parent), max(u, parent))
                        if count[key] <= 2:
                            out.append(key)
    return sorted(out)


def contract_degree2(g: LocalGraph, protected: set[int] = frozenset()) -> tuple[list[int], list[tuple[int, int, float]]]:
    """Kept positions and merged directed edges: chains through nodes with two neighbours become one edge each way in which every
    link of the chain exists.  Chains that return to their start and pure cycles vanish; isolated nodes stay."""
    nbr: list[set[int]] = [set() for _ in range(g.n)]
    best: dict[tuple[int, int], float] = {}
    for u, v, w in zip(g.src.tolist(), g.dst.tolist(), g.weight.tolist(), strict=True):
        if u != v:
            nbr[u].add(v)
            nbr[v].add(u)
            best[u, v] = min(best.get((u, v), INF), w)
    keep = [len(nbr[v]) != 2 or v in protected for v in range(g.n)]
    merged: dict[tuple[int, int], float] = {}

    def put(a: int, b: int, w: float) -> None:
        if w < merged.get((a, b), INF):
            merged[a, b] = w

    for u in range(g.n):
        if not keep[u]:
            continue
        for v in nbr[u]:
            chain = [u, v]
            while not keep[chain[-1]]:
                a, b = nbr[chain[-1]]
                chain.append(b if a == chain[-2] else a)
            if chain[-1] != u:
                put(u, chain[-1], sum(best.get(p, INF) for p in zip(chain, chain[1:], strict=False)))
    used = sorted(v for v in range(g.n) if keep[v] and nbr[v]) + [v for v in range(g.n) if not nbr[v]]
    return used, sorted((a, b, w) for (a, b), w in merged.items() if w < INF)


def brandes(g: LocalGraph, source: int, limit: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """One source's weighted dependencies: of edges and of nodes (source excluded); ties within 1e-10; parallel copies credit the first."""
    edge, node = np.zeros(len(g.src)), np.zeros(g.n)
    dist, sigma, order, done = [INF] * g.n, [0.0] * g.n, [], bytearray(g.n)
    before: list[list[int]] = [[] for _ in range(g.n)]
    dist[source], sigma[source] = 0.0, 1.0
    heap, off, dst, wt, src = [(0.0, source)], g.offset, g.dst, g.weight, g.src
    while heap:
        d, u = heapq.heappop(heap)
        if done[u]:
            continue
        if limit > 0 and d > limit:
            break
        done[u] = 1
        order.append(u)
        last = -1
        for e in range(off[u], off[u + 1]):
            v = int(dst[e])
            if v == last:
                continue  # a heavier parallel copy
            last, nd = v, d + wt[e]
            if done[v]:
                continue
            if nd < dist[v] - 1e-10:
                dist[v], sigma[v], before[v] = nd, sigma[u], [e]
                heapq.heappush(heap, (nd, v))
            elif abs(nd - dist[v]) <= 1e-10:
                sigma[v] += sigma[u]
                before[v].append(e)
    delta = [0.0] * g.n
    for v in reversed(order):
        for e in before[v]:
            u = int(src[e])
            c = sigma[u] / sigma[v] * (1 + delta[v])
            delta[u] += c
            edge[e] += c
        if v != source:
            node[v] += delta[v]
    return edge, node


def undirected_pairs(g: LocalGraph) -> np.ndarray:
    """Distinct (u, v), u < v."""
    lo, hi = np.minimum(g.src, g.dst), np.maximum(g.src, g.dst)
    return np.unique(np.stack([lo, hi], 1)[lo != hi], axis=0)


def laplacian_dense(g: LocalGraph) -> np.ndarray:
    out = np.zeros((g.n, g.n))
    p = undirected_pairs(g)
    out[p[:, 0], p[:, 1]] = out[p[:, 1], p[:, 0]] = -1
    out[np.arange(g.n), np.arange(g.n)] = -out.sum(1)
    return out


def _matvec(g: LocalGraph, laplacian: bool):
    p = undirected_pairs(g)
    a, b = p[:, 0], p[:, 1]
    degree = np.bincount(np.concatenate([a, b]), minlength=g.n).astype(float)

    def adj(x: np.ndarray) -> np.ndarray:
        return np.bincount(a, x[b], g.n) + np.bincount(b, x[a], g.n)

    return ((lambda x: degree * x - adj(x)) if laplacian else adj), degree


def component_count(g: LocalGraph, most: int = 2) -> int:
    """Directed searches from the least unvisited position, stopped at ``most``."""
    seen, count = bytearray(g.n), 0
    for root in range(g.n):
        if not seen[root]:
            count += 1
            if count >= most:
                return count
            stack = [root]
            seen[root] = 1
            while stack:
                for v, _ in g.adjacent[stack.pop()]:
                    if not seen[v]:
                        seen[v] = 1
                        stack.append(v)
    return count


def lanczos(matvec, start: np.ndarray, steps: int, against: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Diagonal, off-diagonal and steps done; fully reorthogonalized, kept orthogonal to ``against``."""
    q = [start / np.linalg.norm(start)]
    alpha, beta = [], []
    for k in range(steps):
        w = matvec(q[k])
        alpha.append(float(w @ q[k]))
        basis = np.array(q)
        for _ in range(2):
            w = w - basis.T @ (basis @ w)
            if against is not None:
                w = w - against * (against @ w)
        size = float(np.linalg.norm(w))
        if size < 1e-12 or k == steps - 1:
            break
        beta.append(size)
        q.append(w / size)
    return np.array(alpha), np.array(beta[: len(alpha) - 1]), len(alpha)


DENSE = 64
PROXY = 50_000


def algebraic_connectivity(g: LocalGraph) -> float:
    """Second least Laplacian eigenvalue: 0 if not in one piece, dense up to 64 nodes, a degree proxy beyond 50 000, Lanczos between."""
    if g.n <= 1 or component_count(g) > 1:
        return 0.0
    if g.n <= DENSE:
        return max(0.0, float(np.linalg.eigvalsh(laplacian_dense(g))[1]))
    matvec, degree = _matvec(g, True)
    if g.n > PROXY:
        return float(degree.min() / math.sqrt(g.n))
    ones, shift = np.full(g.n, 1 / math.sqrt(g.n)), 2 * degree.max() + 1
    start = np.random.default_rng(0).normal(size=g.n)
    start -= ones * (ones @ start)
    a, b, m = lanczos(lambda x: shift * x - matvec(x), start, min(g.n - 1, 300), ones)
    return max(0.0, float(shift - np.linalg.eigvalsh(np.diag(a) + np.diag(b, 1) + np.diag(b, -1))[-1]))


def kirchhoff(g: LocalGraph, probes: int = 30, seed: int = 42) -> float:
    """n times the sum of inverse non-zero eigenvalues: exact up to 64 nodes, else by random probes and conjugate gradients."""
    if g.n <= 1:
        return 0.0
    if g.n <= DENSE:
        lam = np.linalg.eigvalsh(laplacian_dense(g))
        return float(g.n * sum(1 / x for x in lam if x > 1e-10))
    matvec, _ = _matvec(g, True)
    rng, total = np.random.Generator(np.random.PCG64(seed)), 0.0
    for _ in range(probes):
        z = rng.choice([-1.0, 1.0], g.n)
        z -= z.mean()
        x, r = np.zeros(g.n), z.copy()
        p, rr = r.copy(), float(r @ r)
        for _ in range(10 * g.n):
            if rr < 1e-16 * g.n:
                break
            ap = matvec(p) + p / g.n
            step = rr / float(p @ ap)
            x, r = x + step * p, r - step * ap
            rr, old = float(r @ r), rr
            p = r + rr / old * p
        total += float(z @ x)
    return g.n * total / probes


def natural_connectivity(g: LocalGraph, probes: int = 20, steps: int = 50, seed: int = 42) -> float:
    """ln of the mean of exp over adjacency eigenvalues: exact up to 64 nodes, else stochastic Lanczos quadrature."""
    if g.n == 0:
        return 0.0
    if g.n <= DENSE:
        a = -laplacian_dense(g)
        np.fill_diagonal(a, 0)
        lam = np.linalg.eigvalsh(a)
        return float(lam[-1] + math.log(np.exp(lam - lam[-1]).mean()))
    matvec, _ = _matvec(g, False)
    rng, total = np.random.Generator(np.random.PCG64(seed)), 0.0
    for _ in range(probes):
        a, b, m = lanczos(matvec, rng.choice([-1.0, 1.0], g.n), min(steps, g.n))
        lam, vec = np.linalg.eigh(np.diag(a) + np.diag(b, 1) + np.diag(b, -1))
        total += float((vec[0] ** 2 * np.exp(lam)).sum())
    return math.log(total / probes)
