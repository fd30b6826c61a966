"""Replacement paths and composite vulnerability measures."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanweave.functions.geo import bearing, circle, haversine
from spanweave.graph import LocalGraph, RoadGraph, by_shuffle
from spanweave.operators import batches, kernels
from spanweave.operators.centrality import betweenness
from spanweave.operators.kernels import INF, both_ways, dijkstra, path_to
from spanweave.operators.paths import alt_bound, paths
from spanweave.operators.regions import entry_points
from spanweave.operators.snapping import tiles
from spanweave.operators.topology import bridges
from spanweave.shared import materialize

# ---- replacement paths ----------------------------------------------------------------------------------------------------


def _worst(f: pd.DataFrame) -> pd.DataFrame:
    """Of whole pairs, a pair's rows in order, the one that ``bottleneck`` takes, and the number of its edges."""
    first = np.flatnonzero(f["pos"].to_numpy() == 0)
    if not len(first):
        return f.assign(edges=0)
    rank, edges = f["ratio"].astype(float).fillna(INF).to_numpy(), np.diff(np.append(first, len(f)))
    at = np.flatnonzero(rank == np.repeat(np.maximum.reduceat(rank, first), edges))
    return f.iloc[at[np.searchsorted(at, first)]].assign(edges=edges)


def route_fragility(graph: RoadGraph, od: DataFrame, method: str = "interval", eps: float = 0.1, worst: bool = False) -> DataFrame:
    """(od_id, pos, src, dst, primary, replacement, ratio) for each edge of each pair's shortest path; nulls where nothing replaces it.

    exact: a search without each edge.  interval: two searches a pair; an edge off the path gives a detour that replaces every
    path edge between the place it leaves and the place it returns to, so each path edge takes the least detour that spans it.
    Both agree.  approx: detours are rounded to geometric segments of the path, at most a share ``eps`` below the exact value.
    ``worst``: only the row that ``bottleneck`` takes of each pair, and the number of the pair's edges; the others stay in the task.
    """
    shipped = graph.spark.sparkContext.broadcast(graph.local())
    names = ["od_id", "pos", "src", "dst", "primary", "replacement", "ratio"]

    def exact(g: LocalGraph, s: int, t: int, way: list[int]) -> list[float]:
        return [dijkstra(g.adjacent, s, {(u, v)}, t)[0][t] for u, v in zip(way, way[1:])]

    def spans(g: LocalGraph, s: int, t: int, way: list[int], d: list[float], p: list[int]) -> list[tuple[float, int, int]]:
        e, q = dijkstra(g.reverse, t)
        at, on = {v: k for k, v in enumerate(way)}, set(zip(way, way[1:]))
        last = len(way) - 1

        def leaves(pred: list[int], start: dict[int, int]) -> list[int]:
            """Where each node's tree path leaves the primary path, by position."""
            out = [-1] * g.n
            for v in range(g.n):
                chain, x = [], v
                while x >= 0 and out[x] < 0 and x not in start:
                    chain.append(x)
                    x = pred[x]
                k = -2 if x < 0 else start[x] if x in start else out[x]
                for c in chain:
                    out[c] = k
            for v, k in start.items():
                out[v] = k
            return out

        # on the path itself trees are the path, whatever ties the searches broke differently
        head, tail = leaves(p, at), leaves(q, at)
        out = []
        for u, v, w in zip(g.src.tolist(), g.dst.tolist(), g.weight.tolist(), strict=True):
            if (u, v) not in on and math.isfinite(d[u]) and math.isfinite(e[v]):
                a, b = head[u], tail[v]
                if 0 <= a < b <= last:
                    out.append((d[u] + w + e[v], a, b))
        return out

    def cover(found: list[tuple[float, int, int]], edges: int) -> list[float]:
        out, nxt = [INF] * edges, list(range(edges + 1))

        def free(k: int) -> int:
            while nxt[k] != k:
                nxt[k] = nxt[nxt[k]]
                k = nxt[k]
            return k

        for c, a, b in sorted(found):
            k = free(a)
            while k < b:
                out[k], nxt[k] = c, k + 1
                k = free(k)
        return out

    def segments(bound: list[float], costs: list[float]) -> list[float]:
        """A detour within the bound of the least one may count for a whole segment."""
        starts = [0]
        for k in range(1, len(costs)):
            if bound[k] > bound[starts[-1]] * (1 + eps) + eps:
                starts.append(k)
        seg = [bisect_right(starts, k) - 1 for k in range(len(costs))]
        least = {}
        for k, c in enumerate(costs):
            least[seg[k]] = min(c, least.get(seg[k], INF))
        return [max(least[seg[k]], (1 - eps) * c) if math.isfinite(c) else c for k, c in enumerate(costs)]

    def together(g: LocalGraph, f: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Pairs in batches, those of one origin together."""
        s, t = batches.positions(g, f["src"]), batches.positions(g, f["dst"])
        by = np.flatnonzero((s >= 0) & (t >= 0) & (s != t))
        by = by[np.argsort(s[by], kind="stable")]
        size = batches.pair_batch(g)
        for lo in range(0, len(by), size):
            part = by[lo : lo + size]
            found = batches.replacements(g, s[part], t[part])
            edges = np.array([len(c) for *_, c in found])
            if not edges.sum():
                continue
            costs = np.concatenate([c if method == "interval" else np.array(segments(b.tolist(), c.tolist())) for _, b, c in found])
            far = np.repeat([b[-1] if len(b) else 0.0 for _, b, _ in found], edges)
            ok = np.isfinite(costs)
            yield pd.DataFrame({"od_id": np.repeat(f["od_id"].to_numpy()[part], edges), "pos": np.concatenate([np.arange(k) for k in edges]), "src": g.ids[np.concatenate([w[:-1] for w, *_ in found])], "dst": g.ids[np.concatenate([w[1:] for w, *_ in found])], "primary": far, "replacement": np.where(ok, costs, np.nan), "ratio": np.where(ok, costs / far, np.nan)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shipped.value
        if method != "exact" and batches.least_weight(g) > 0:
            for f in frames:
                yield from together(g, f)
            return
        for f in frames:
            out = []
            for r in f.itertuples():
                s, t = g.at(r.src), g.at(r.dst)
                if s < 0 or t < 0 or s == t:
                    continue
                d, p = dijkstra(g.adjacent, s)
                way = path_to(p, s, t)
                if len(way) < 2:
                    continue
                if method == "exact":
                    costs = exact(g, s, t, way)
                else:
                    found = spans(g, s, t, way, d, p)
                    costs = cover(found, len(way) - 1)
                    if method == "approx":
                        costs = segments([d[v] for v in way], costs)
                for k, c in enumerate(costs):
                    ok = math.isfinite(c)
                    out.append((r.od_id, k, int(g.ids[way[k]]), int(g.ids[way[k + 1]]), d[t], c if ok else None, (c / d[t] if d[t] > 0 else 1.0) if ok else None))
                if len(out) > 50_000:  # a batch of pairs has millions of path edges on a large graph
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    o = od.select("od_id", "src", "dst")
    o = o.repartition(o.sparkSession.sparkContext.defaultParallelism, "od_id") if method == "exact" else o.repartitionByRange(4 * o.sparkSession.sparkContext.defaultParallelism, "src", "od_id")
    schema = "od_id long, pos int, src long, dst long, primary double, replacement double, ratio double"
    if worst:
        return o.mapInPandas(lambda frames: map(_worst, run(frames)), schema + ", edges long")
    return o.mapInPandas(run, schema)


def bottleneck(fragility: DataFrame) -> DataFrame:
    """(od_id, pos, src, dst, ratio): worst edge of each pair, none replaced before all others, first of equals."""
    worst = F.struct(F.coalesce("ratio", F.lit(INF)), -F.col("pos"))
    return fragility.groupBy("od_id").agg(F.max_by(F.struct("pos", "src", "dst", "ratio"), worst).alias("b")).select("od_id", "b.*")


def filtered_route_fragility(graph: RoadGraph, od: DataFrame, levels: DataFrame, marks: DataFrame, percentile: float = 0.8, ratio: float = 1.05) -> DataFrame:
    """As route_fragility, with column screened: bridge (nothing replaces it), level (both ends at or above the level percentile) or
    bound (the landmark bound is within ``ratio`` of the distance), with ratio 1; other edges exactly.

    The screen comes first: only pairs with an edge that passes it are searched for replacements."""
    way = paths(graph, od).where(F.size("path") > 1)
    step = F.posexplode(F.zip_with(F.slice("path", 1, F.size("path") - 1), F.slice("path", 2, F.size("path") - 1), lambda a, b: F.struct(a.alias("src"), b.alias("dst"))))
    edges = way.select("od_id", F.col("dist").alias("primary"), step.alias("pos", "e")).select("od_id", "pos", "e.src", "e.dst", "primary")
    b = bridges(graph).withColumn("bridge", F.lit(True))
    n = levels.count()
    least = levels.withColumn("at", F.row_number().over(Window.orderBy("node_level", "node_id")) - 1).where(F.col("at") == min(max(0, n - 1), int(percentile * n))).select(F.col("node_level").alias("least"))
    lv = levels.select("node_id", "node_level")
    out = edges.join(b, (F.least("src", "dst") == b.u) & (F.greatest("src", "dst") == b.v), "left").drop("u", "v")
    out = out.join(lv.select(F.col("node_id").alias("src"), F.col("node_level").alias("ls")), "src").join(lv.select(F.col("node_id").alias("dst"), F.col("node_level").alias("ld")), "dst").join(F.broadcast(least)).join(alt_bound(od, marks), "od_id")
    why = F.when(F.col("bridge"), "bridge").when((F.col("ls") >= F.col("least")) & (F.col("ld") >= F.col("least")), "level").when((F.col("bound") > 0) & (F.col("primary") / F.col("bound") < ratio), "bound")
    out = materialize(out.select("od_id", "pos", "src", "dst", "primary", why.alias("screened")), "screened")
    left = od.join(out.where("screened is null").select("od_id").distinct(), "od_id", "left_semi")
    exact = route_fragility(graph, left).select("od_id", "pos", "replacement", "ratio")
    out = out.join(by_shuffle(exact), ["od_id", "pos"], "left")  # a row an edge of each pair, though its size is taken for that of the pairs
    soft = F.col("screened").isin("level", "bound")
    return out.select("od_id", "pos", "src", "dst", "primary", F.when(soft, F.col("primary")).when(F.col("screened").isNull(), F.col("replacement")).alias("replacement"), F.when(soft, 1.0).when(F.col("screened").isNull(), F.col("ratio")).alias("ratio"), "screened")


# ---- curves and scores ----------------------------------------------------------------------------------------------------


def percentile_at(n: int, a: int, b: int) -> int:
    """Index of the a/b percentile of n sorted values."""
    return min(n - 1, n * a // b)


def level_stats(curve: DataFrame, keys: Sequence[str] = ("k",), value: str = "value") -> DataFrame:
    """Per key: runs, mean, sample deviation (0 for one run), p25, p50, p75, p90, iqr.  A group has one value a run."""
    s = F.array_sort(F.collect_list(value))
    at = lambda a, b: F.get(s, F.least(F.size(s) - 1, F.floor(F.size(s) * F.lit(a) / F.lit(b))).cast("int"))
    out = curve.groupBy(*keys).agg(F.count(value).alias("runs"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), at(25, 100).alias("p25"), at(1, 2).alias("p50"), at(75, 100).alias("p75"), at(9, 10).alias("p90"))
    return out.withColumn("iqr", F.col("p75") - F.col("p25"))


def curve_metrics(curve: DataFrame, keys: Sequence[str] = (), critical: float = 0.7, jump: float = 0.15) -> DataFrame:
    """Of curves (keys, k, mean): auc_raw, auc_norm, auc_excess, critical_k, jump_k and jump_size.

    critical_k: first k of 1 or more above ``critical``; the jump: largest step, if beyond ``jump`` times the base (0.01 at least).
    """
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    c = curve.withColumn("step", F.col("mean") - F.lag("mean").over(by.orderBy("k"))).withColumn("base", F.first("mean").over(by.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    big = F.col("step") > jump * F.greatest("base", F.lit(0.01))
    g = c.groupBy(*keys).agg(F.sum("mean").alias("auc_raw"), F.max("k").alias("k_max"), F.max("base").alias("base"), F.min(F.when((F.col("k") >= 1) & (F.col("mean") > critical), F.col("k"))).alias("critical_k"), F.max_by(F.when(big, F.col("k")), F.when(big, F.struct("step", -F.col("k")))).alias("jump_k"), F.max(F.when(big, F.col("step"))).alias("jump_size"))
    return g.select(*keys, "auc_raw", (F.col("auc_raw") / (F.col("k_max") + 1)).alias("auc_norm"), F.when(F.col("k_max") > 0, (F.col("auc_raw") - F.col("base") * (F.col("k_max") + 1)) / F.col("k_max")).otherwise(0.0).alias("auc_excess"), "critical_k", "jump_k", "jump_size")


def isolation_score(rows: DataFrame, keys: Sequence[str], bins: int = 8) -> DataFrame:
    """Of (keys, sector, full, blocked): risk = .5 disconnected + .3 min(1, (mean ratio - 1) / 5) + .2 share of sectors without reach, in [0, 1]."""
    ok = rows.where("full is not null")
    ratio = F.least(F.lit(6.0), F.col("blocked") / F.greatest(F.lit(1.0), F.col("full")))
    g = ok.groupBy(*keys).agg((F.count(F.when(F.col("blocked").isNull(), 1)) / F.count("*")).alias("disconnected_frac"), F.coalesce(F.avg(ratio), F.lit(1.0)).alias("mean_ratio"), (1 - F.countDistinct(F.when(F.col("blocked").isNotNull(), F.col("sector"))) / bins).alias("coverage_gap"))
    g = g.withColumn("distance_inflation", F.least(F.lit(1.0), (F.col("mean_ratio") - 1) / 5))
    risk = 0.5 * F.col("disconnected_frac") + 0.3 * F.col("distance_inflation") + 0.2 * F.col("coverage_gap")
    return g.withColumn("isolation_risk", F.least(F.lit(1.0), F.greatest(F.lit(0.0), risk))).drop("mean_ratio")


def composite_score(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of (keys, primary, dist): .6 (1 - reachable share) + .4 min(1, (mean stretch - 1) / 5); the mean stretch of none reachable is 0.
    Also whether any pair is unreachable."""
    r = F.count("dist") / F.count("*")
    mean = F.coalesce(F.avg(F.col("dist") / F.col("primary")), F.lit(0.0))
    return rows.groupBy(*keys).agg((0.6 * (1 - r) + 0.4 * F.least(F.lit(1.0), (mean - 1) / 5)).alias("value"), (F.count("dist") < F.count("*")).alias("any_disconnected"))


def hhi(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, hhi): sum of squared shares, 0 if there is nothing to share."""
    total = F.sum(value).over(Window.partitionBy(*keys))
    return rows.withColumn("__s", F.when(total > 0, F.pow(F.col(value) / total, 2)).otherwise(0.0)).groupBy(*keys).agg(F.sum("__s").alias("hhi"))


def state_ranking(scores: DataFrame, code: str, value: str) -> DataFrame:
    """(state, areas, mean, median) by the code's first two characters."""
    return scores.groupBy(F.substring(code, 1, 2).alias("state")).agg(F.count("*").alias("areas"), F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"))


def weight_sensitivity(sub_scores: DataFrame, weights: dict[str, float], spread: float = 0.2, points: int = 5) -> DataFrame:
    """(id, dim, sensitivity, low, high): range of the composite while one weight moves by +-spread and all are renormalised.

    The composite is linear in the sub-scores, so these are taken once and only the weights vary.
    """
    if points < 2:
        raise ValueError("at least two points")
    names, rows = list(weights), []
    for dim in names:
        for i in range(points):
            w = {n: weights[n] * (1 - spread + 2 * spread * i / (points - 1)) if n == dim else weights[n] for n in names}
            rows.append((dim, i, *[w[n] / sum(w.values()) for n in names]))
    grid = sub_scores.sparkSession.createDataFrame(rows, "dim string, step int, " + ", ".join(f"w_{n} double" for n in names))
    key = [c for c in sub_scores.columns if c not in names]
    c = sub_scores.crossJoin(F.broadcast(grid)).withColumn("composite", sum((F.col(n) * F.col(f"w_{n}") for n in names), F.lit(0.0)))
    base = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("dim"))
    return c.groupBy(*key, "dim").agg(F.min("composite").alias("low"), F.max("composite").alias("high")).withColumn("sensitivity", (F.col("high") - F.col("low")) / (2 * spread * base))


# ---- trials ---------------------------------------------------------------------------------------------------------------


def _order(seed: int, run: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([seed, run])).permutation(n)


@dataclass(frozen=True)
class LocationConfig:
    radius_m: float = 80_467.0
    bins: int = 8
    removal: float = 0.1
    samples: int = 200
    runs: int = 20
    seed: int = 42
    strategy: str = "mc"  # mc, betweenness or fragility
    betweenness_samples: int = 100


def _location_setup(graph: RoadGraph, lat: float, lon: float, cfg: LocationConfig):
    """Local graph, source, targets with sectors and full distances, shortest-path edges; None where there is nothing to measure."""
    sub = graph.subgraph(circle(lat, lon, cfg.radius_m * 1.1))
    near = graph.nodes.where("lat is not null").agg(F.min_by("node_id", F.struct(haversine(lat, lon, "lat", "lon"), "node_id"))).first()[0]
    g = sub.local()
    s = g.at(near) if near is not None else -1
    if g.n < 3 or s < 0:
        return None
    coords = {r["node_id"]: r["b"] for r in sub.nodes.select("node_id", bearing(lat, lon, "lat", "lon").alias("b")).collect()}
    full, _ = dijkstra(g.adjacent, s)
    reach = [v for v in range(g.n) if v != s and math.isfinite(full[v])]
    if not reach:
        return None
    pick = np.random.Generator(np.random.PCG64(cfg.seed)).permutation(len(reach))[: cfg.samples]
    targets = [reach[i] for i in sorted(pick)]
    sector = [int(coords[int(g.ids[v])] / (2 * math.pi / cfg.bins)) % cfg.bins for v in targets]
    on = [(u, v) for u, v, w in zip(g.src.tolist(), g.dst.tolist(), g.weight.tolist(), strict=True) if math.isfinite(full[u]) and math.isfinite(full[v]) and abs(full[u] + w - full[v]) < 1e-6 * max(1.0, full[u], full[v])]
    return g, s, targets, sector, full, on


def _risk(targets: list[int], sector: list[int], full: list[float], blocked: list[float], bins: int) -> tuple[float, float, float, float]:
    cut = [v for v in targets if not math.isfinite(blocked[v])]
    ratios = [min(6.0, blocked[v] / max(1.0, full[v])) for v in targets if math.isfinite(blocked[v])]
    gap = 1 - len({b for v, b in zip(targets, sector, strict=True) if math.isfinite(blocked[v])}) / bins
    disc, infl = len(cut) / len(targets), min(1.0, (sum(ratios) / len(ratios) if ratios else 1.0) / 5 - 0.2)
    return min(1.0, max(0.0, 0.5 * disc + 0.3 * infl + 0.2 * gap)), disc, infl, gap


def location_fragility(graph: RoadGraph, lat: float, lon: float, cfg: LocationConfig | None = None) -> DataFrame:
    """(run, k, value, disconnected_frac, distance_inflation, coverage_gap): isolation of a place as k of its shortest-path edges fail.

    mc: nested prefixes of one seeded order a run, a run a task.  betweenness: the order of edge scores.  fragility: the worst
    edge next, its candidates being tasks.
    """
    cfg = cfg or LocationConfig()
    spark, schema = graph.spark, "run int, k int, value double, disconnected_frac double, distance_inflation double, coverage_gap double"
    made = _location_setup(graph, lat, lon, cfg)
    if made is None or not made[5]:
        return spark.createDataFrame([], schema)
    g, s, targets, sector, full, on = made
    k_max = max(1, min(len(on), math.ceil(cfg.removal * len(on))))
    shipped = spark.sparkContext.broadcast(made)

    def one(removed: list[tuple[int, int]]) -> tuple[float, float, float, float]:
        own = shipped.value
        d, _ = dijkstra(own[0].adjacent, own[1], both_ways(removed))
        return _risk(own[2], own[3], own[4], d, cfg.bins)

    if cfg.strategy == "mc":
        orders = [[on[i] for i in _order(cfg.seed, r, len(on))[:k_max]] for r in range(cfg.runs)]
    elif cfg.strategy == "betweenness":
        score, _ = betweenness(graph.restrict(spark.createDataFrame([(int(i),) for i in g.ids], "node_id long")), cfg.betweenness_samples, seed=cfg.seed)
        by = {(r["src"], r["dst"]): r["score"] for r in score.collect()}
        orders = [sorted(on, key=lambda e: (-by.get((int(g.ids[e[0]]), int(g.ids[e[1]])), 0.0), e))[:k_max]]
    else:
        done, rest = [], sorted(set(on))
        for _ in range(k_max):
            fixed = spark.sparkContext.broadcast(done)
            cand = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(rest)], "i int, a int, b int").repartition(spark.sparkContext.defaultParallelism)
            tried = cand.mapInPandas(lambda fs, fixed=fixed: (f.assign(v=[one([*fixed.value, (a, b)])[0] for a, b in zip(f["a"], f["b"], strict=True)]) for f in fs), "i int, a int, b int, v double")
            best = tried.agg(F.max_by("i", F.struct("v", -F.col("i")))).first()[0]
            done = [*done, rest.pop(best)]
        orders = [done]
    work = spark.createDataFrame([(r, k) for r in range(len(orders)) for k in range(k_max + 1)], "run int, k int")
    lists = spark.sparkContext.broadcast(orders)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(r, k, *one(lists.value[r][:k])) for r, k in zip(f["run"], f["k"], strict=True)], columns=[c.split()[0] for c in schema.split(", ")])

    return work.repartition(spark.sparkContext.defaultParallelism * 2).mapInPandas(run, schema)


def location_summary(curve: DataFrame) -> DataFrame:
    """One row: isolation_risk at the most removed edges, baseline at none, auc_norm."""
    lv = level_stats(curve)
    return lv.agg(F.max_by("mean", "k").alias("isolation_risk"), F.min_by("mean", "k").alias("baseline"), F.avg("mean").alias("auc_norm"), F.max("k").alias("k_max"))


def directional_asymmetry(graph: RoadGraph, lat: float, lon: float, cfg: LocationConfig | None = None) -> DataFrame:
    """(sector, inflation) of the first run with all its edges removed; sectors without reach have 0."""
    cfg = cfg or LocationConfig()
    made = _location_setup(graph, lat, lon, cfg)
    if made is None or not made[5]:
        return graph.spark.createDataFrame([], "sector int, inflation double")
    g, s, targets, sector, full, on = made
    k = max(1, min(len(on), math.ceil(cfg.removal * len(on))))
    d, _ = dijkstra(g.adjacent, s, both_ways([on[i] for i in _order(cfg.seed, 0, len(on))[:k]]))
    by: dict[int, list[float]] = {b: [] for b in range(cfg.bins)}
    for v, b in zip(targets, sector, strict=True):
        if math.isfinite(d[v]):
            by[b].append(min(6.0, d[v] / max(1.0, full[v])))
    return graph.spark.createDataFrame([(b, sum(x) / len(x) - 1 if x else 0.0) for b, x in by.items()], "sector int, inflation double")


def tiled(graph: RoadGraph, lat0: float, lat1: float, lon0: float, lon1: float, tile_m: float = 16_000.0, cfg: LocationConfig | None = None) -> DataFrame:
    """(tile_row, tile_col, lat, lon, risk) of the middle of every tile; empty surroundings have risk 0."""
    cfg = cfg or LocationConfig()
    rows, cols, dlat, dlon = tiles(lat0, lat1, lon0, lon1, tile_m)
    spark = graph.spark
    shipped = spark.sparkContext.broadcast(graph.local("lat", "lon"))
    grid = spark.range(rows).select(F.col("id").cast("int").alias("tile_row")).withColumn("tile_col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    grid = grid.select("tile_row", "tile_col", (lat0 + (F.col("tile_row") + 0.5) * dlat).alias("lat"), (lon0 + (F.col("tile_col") + 0.5) * dlon).alias("lon"))

    def risk(lat: float, lon: float) -> float:
        g = shipped.value
        ys, xs = g.at_nodes("lat"), g.at_nodes("lon")
        ring = circle(lat, lon, cfg.radius_m * 1.1)
        south, west = np.min(ring, 0)
        north, east = np.max(ring, 0)
        box = np.flatnonzero((ys >= south) & (ys <= north) & (xs >= west) & (xs <= east)).tolist()
        xy = {v: (float(ys[v]), float(xs[v])) for v in box}
        inside = [v for v in box if _in_ring(*xy[v], ring)]
        if len(inside) < 3:
            return 0.0
        s = min(inside, key=lambda v: ((xy[v][0] - lat) ** 2 + ((xy[v][1] - lon) * math.cos(math.radians(lat))) ** 2, v))
        # the tile alone, numbered in the same order
        rank = {v: k for k, v in enumerate(inside)}
        adj = [[(rank[v], w) for v, w in g.adjacent[u] if v in rank] for u in inside]
        xy, s, inside = [xy[v] for v in inside], rank[s], range(len(inside))
        full, _ = dijkstra(adj, s)
        reach = [v for v in inside if v != s and math.isfinite(full[v])]
        if not reach:
            return 0.0
        pick = [reach[i] for i in sorted(np.random.Generator(np.random.PCG64(cfg.seed)).permutation(len(reach))[: cfg.samples])]
        sector = [int(math.atan2(xy[v][1] - lon, xy[v][0] - lat) % (2 * math.pi) / (2 * math.pi / cfg.bins)) % cfg.bins for v in pick]
        on = [(u, v) for u in inside for v, w in adj[u] if math.isfinite(full[u]) and abs(full[u] + w - full[v]) < 1e-6 * max(1.0, full[u], full[v])]
        k = max(1, math.ceil(cfg.removal * len(on)))
        vals = [_risk(pick, sector, full, dijkstra(adj, s, both_ways([on[i] for i in _order(cfg.seed, r, len(on))[:k]]))[0], cfg.bins)[0] for r in range(cfg.runs)]
        return float(np.mean(vals))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(risk=[risk(a, b) for a, b in zip(f["lat"], f["lon"], strict=True)])

    return grid.repartition(spark.sparkContext.defaultParallelism * 2).mapInPandas(run, "tile_row int, tile_col int, lat double, lon double, risk double")


def tiled_summary(t: DataFrame) -> DataFrame:
    """One row: tiles, mean, max, min risk and the middle of the riskiest tile, if it has any risk."""
    return t.agg(F.count("*").alias("tiles"), F.avg("risk").alias("mean_risk"), F.max("risk").alias("max_risk"), F.min("risk").alias("min_risk"), F.max_by(F.when(F.col("risk") > 0, F.struct("lat", "lon")), F.struct("risk", -F.col("tile_row"), -F.col("tile_col"))).alias("worst"))


def _in_ring(lat: float, lon: float, ring: list[tuple[float, float]]) -> bool:
    inside = False
    for (ay, ax), (by, bx) in zip(ring, ring[1:]):
        if (ay > lat) != (by > lat) and lon < (bx - ax) * (lat - ay) / (by - ay) + ax:
            inside = not inside
    return inside


def _od_context(g: LocalGraph, count: int, seed: int) -> list[tuple[int, int, float]]:
    rng, out, cache = np.random.Generator(np.random.PCG64(seed)), [], {}
    for s, t in rng.integers(0, g.n, (count * 5, 2)).tolist() if g.n else ():
        if s != t and len(out) < count:
            if s not in cache:
                cache[s] = dijkstra(g.adjacent, s)[0]
            if math.isfinite(cache[s][t]) and cache[s][t] > 0:
                out.append((s, t, cache[s][t]))
    return out


@dataclass(frozen=True)
class ProgressiveConfig:
    strategy: str = "mc"  # mc, betweenness or fragility
    k_max: int = 5
    k_fraction: float = 0.0
    runs: int = 50
    od: int = 20
    seed: int = 42


def progressive(graph: RoadGraph, ring: Sequence[tuple[float, float]], cfg: ProgressiveConfig | None = None) -> DataFrame:
    """(run, k, value, any_disconnected): composite score of an area's sampled pairs as k of its undirected edges fail."""
    cfg = cfg or ProgressiveConfig()
    if len(ring) < 3 or cfg.k_max < 1 and not cfg.k_fraction or cfg.strategy == "mc" and cfg.runs < 1 or cfg.od < 1:
        raise ValueError("a polygon, a positive k, runs and pairs are needed")
    spark, g = graph.spark, graph.subgraph(ring).local()
    cand = [tuple(p) for p in kernels.undirected_pairs(g).tolist()]
    k_max = min(len(cand) - 1, int(cfg.k_fraction * len(cand)) if cfg.k_fraction else cfg.k_max)
    pairs = _od_context(g, cfg.od, cfg.seed)
    if k_max < 1 or not pairs:
        return spark.createDataFrame([], "run int, k int, value double, any_disconnected boolean")
    shipped = spark.sparkContext.broadcast((g, pairs, cand))

    def score(removed: list[int]) -> tuple[float, bool]:
        own, od, all_ = shipped.value
        gone, dist = both_ways([all_[i] for i in removed]), {}
        ratios = []
        for s, t, full in od:
            if s not in dist:
                dist[s] = dijkstra(own.adjacent, s, gone)[0]
            if math.isfinite(dist[s][t]):
                ratios.append(dist[s][t] / full)
        mean = sum(ratios) / len(ratios) if ratios else 0.0
        return 0.6 * (1 - len(ratios) / len(od)) + 0.4 * min(1.0, (mean - 1) / 5), len(ratios) < len(od)

    if cfg.strategy == "mc":
        orders = [_order(cfg.seed, r, len(cand))[:k_max].tolist() for r in range(cfg.runs)]
    elif cfg.strategy == "betweenness":
        edge, _ = betweenness(graph.subgraph(ring), seed=cfg.seed)
        by: dict[tuple[int, int], float] = {}
        for r in edge.collect():
            key = (min(g.at(r["src"]), g.at(r["dst"])), max(g.at(r["src"]), g.at(r["dst"])))
            by[key] = by.get(key, 0.0) + r["score"]
        orders = [sorted(range(len(cand)), key=lambda i: (-by.get(cand[i], 0.0), i))[:k_max]]
    else:
        done: list[int] = []
        for _ in range(k_max):
            fixed = spark.sparkContext.broadcast(list(done))
            rest = spark.createDataFrame([(i,) for i in range(len(cand)) if i not in set(done)], "i int").repartition(spark.sparkContext.defaultParallelism)
            tried = rest.mapInPandas(lambda fs, fixed=fixed: (f.assign(v=[score([*fixed.value, i])[0] for i in f["i"]]) for f in fs), "i int, v double")
            done.append(tried.agg(F.max_by("i", F.struct("v", -F.col("i")))).first()[0])
        orders = [done]
    lists = spark.sparkContext.broadcast(orders)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(r, k, *score(lists.value[r][:k])) for r, k in zip(f["run"], f["k"], strict=True)], columns=["run", "k", "value", "any_disconnected"])

    work = spark.createDataFrame([(r, k) for r in range(len(orders)) for k in range(k_max + 1)], "run int, k int")
    return work.repartition(spark.sparkContext.defaultParallelism * 2).mapInPandas(run, "run int, k int, value double, any_disconnected boolean")


def inter_region(reduced: RoadGraph, k_max: int = 20, runs: int = 10, seed: int = 42) -> DataFrame:
    """(region_a, region_b, run, k, seconds, baseline): distance between two regions' centrals as k of their shared border edges fail.

    ``reduced``: a graph with is_central and region_idx on its nodes.  Null seconds: disconnected.
    """
    r = reduced.nodes.select("node_id", "region_idx")
    cross = reduced.edges.join(r.select(F.col("node_id").alias("src"), F.col("region_idx").alias("ra")), "src").join(r.select(F.col("node_id").alias("dst"), F.col("region_idx").alias("rb")), "dst").where("ra <> rb")
    pairs: dict[tuple[int, int], set] = {}
    for e in cross.select("src", "dst", "ra", "rb").distinct().collect():  # border crossings of a reduced graph
        pairs.setdefault((min(e.ra, e.rb), max(e.ra, e.rb)), set()).add((min(e.src, e.dst), max(e.src, e.dst)))
    central = {x["region_idx"]: x["node_id"] for x in reduced.nodes.where("is_central").select("region_idx", "node_id").collect()}
    g = reduced.local()
    shipped = reduced.spark.sparkContext.broadcast((g, {k: sorted(v) for k, v in pairs.items()}, central))
    work = reduced.spark.createDataFrame([(a, b, i) for a, b in sorted(pairs) if a in central and b in central for i in range(runs)], "region_a int, region_b int, run int")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, edges, mid = shipped.value
        for f in frames:
            out = []
            for a, b, i in zip(f["region_a"], f["region_b"], f["run"], strict=True):
                s, t = own.at(mid[a]), own.at(mid[b])
                base = dijkstra(own.adjacent, s, target=t)[0][t]
                if not math.isfinite(base):
                    continue
                e = edges[a, b]
                order = [e[j] for j in _order(seed, i, len(e))[: min(k_max, len(e))]]
                for k in range(len(order) + 1):
                    d = dijkstra(own.adjacent, s, both_ways([(own.at(u), own.at(v)) for u, v in order[:k]]), t)[0][t]
                    out.append((a, b, i, k, d if math.isfinite(d) else None, base))
            yield pd.DataFrame(out, columns=["region_a", "region_b", "run", "k", "seconds", "baseline"])

    return work.repartition(reduced.spark.sparkContext.defaultParallelism).mapInPandas(run, "region_a int, region_b int, run int, k int, seconds double, baseline double")


def inter_region_summary(curve: DataFrame) -> DataFrame:
    """(region_a, region_b, baseline, k_used, auc_inflation, auc_disconnection)."""
    lv = curve.groupBy("region_a", "region_b", "k").agg(F.max("baseline").alias("baseline"), F.coalesce(F.avg("seconds"), F.lit(0.0)).alias("mean"), (F.count(F.when(F.col("seconds").isNull(), 1)) / F.count("*")).alias("disc"))
    infl = F.when((F.col("mean") > 0) & (F.col("baseline") > 0), F.col("mean") / F.col("baseline") - 1).otherwise(0.0)
    return lv.groupBy("region_a", "region_b").agg(F.max("baseline").alias("baseline"), F.max("k").alias("k_used"), F.avg(infl).alias("auc_inflation"), F.avg("disc").alias("auc_disconnection"))


def regional_isolation(graph: RoadGraph, assignment: DataFrame, cfg: LocationConfig | None = None) -> DataFrame:
    """(region_idx, nodes, edges, baseline, isolation_risk) of every region from its middle, over its inner edges.

    The batch form of ``location_fragility``: a region's edges travel with it by one shuffle, nothing is broadcast, and regions
    are worked on side by side.
    """
    cfg = cfg or LocationConfig()
    place = graph.nodes.where("lat is not null and lon is not null").join(assignment.where("region_idx is not null"), "node_id").select("node_id", "lat", "lon", "region_idx")
    a = place.select(F.col("node_id").alias("src"), F.col("lat").alias("ay"), F.col("lon").alias("ax"), "region_idx")
    b = place.select(F.col("node_id").alias("dst"), F.col("lat").alias("by"), F.col("lon").alias("bx"), F.col("region_idx").alias("rb"))
    inner = graph.edges.join(a, "src").join(b, "dst").where("region_idx = rb").select("region_idx", "src", "dst", F.col("weight").cast("double").alias("weight"), "ay", "ax", "by", "bx")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        at = {**dict(zip(f["src"], zip(f["ay"], f["ax"], strict=True), strict=True)), **dict(zip(f["dst"], zip(f["by"], f["bx"], strict=True), strict=True))}
        ids = np.array(sorted(at))
        xy = np.array([at[i] for i in ids])
        g = LocalGraph(ids, np.searchsorted(ids, f["src"].to_numpy()), np.searchsorted(ids, f["dst"].to_numpy()), f["weight"].to_numpy())
        mid = xy.mean(0)
        off = (xy - mid) * [1.0, math.cos(math.radians(mid[0]))]
        s = int(np.argmin((off**2).sum(1)))
        full, _ = dijkstra(g.adjacent, s)
        reach = [v for v in range(g.n) if v != s and math.isfinite(full[v])]
        base = risk = 0.0
        if reach:
            pick = [reach[i] for i in sorted(np.random.Generator(np.random.PCG64(cfg.seed)).permutation(len(reach))[: cfg.samples])]
            sector = [int(math.atan2(off[v][1], off[v][0]) % (2 * math.pi) / (2 * math.pi / cfg.bins)) % cfg.bins for v in pick]
            on = [(u, v) for u, v, w in zip(g.src.tolist(), g.dst.tolist(), g.weight.tolist(), strict=True) if math.isfinite(full[u]) and abs(full[u] + w - full[v]) < 1e-6 * max(1.0, full[u], full[v])]
            k = max(1, math.ceil(cfg.removal * len(on)))
            base = _risk(pick, sector, full, full, cfg.bins)[0]
            risk = float(np.mean([_risk(pick, sector, full, dijkstra(g.adjacent, s, both_ways([on[i] for i in _order(cfg.seed, r, len(on))[:k]]))[0], cfg.bins)[0] for r in range(cfg.runs)]))
        return pd.DataFrame({"region_idx": [int(f["region_idx"].iloc[0])], "nodes": [g.n], "edges": [len(f)], "baseline": [base], "isolation_risk": [risk]})

    return inner.groupBy("region_idx").applyInPandas(run, "region_idx int, nodes long, edges long, baseline double, isolation_risk double")


# ---- areas ----------------------------------------------------------------------------------------------------------------

AREA_WEIGHTS = {"bridge": 0.30, "connectivity": 0.25, "accessibility": 0.25, "fragility": 0.20}


def accessibility(graph: RoadGraph, sub: RoadGraph) -> DataFrame:
    """One row: entry_points, score.  1 / (1 + mean finite bottleneck) over every pair of entries; fewer than two entries score 0,
    as do pairs that all lack a replacement."""
    at = entry_points(graph, sub.nodes).select((F.row_number().over(Window.orderBy("node_id")) - 1).cast("long").alias("at"), "node_id")
    at = materialize(at, "entries")  # of an area's rim
    n = at.count()
    a, b = at.select(F.col("at").alias("i"), F.col("node_id").alias("src")), at.select(F.col("at").alias("j"), F.col("node_id").alias("dst"))
    od = a.join(b, F.col("i") < F.col("j")).select((F.col("i") * n + F.col("j")).alias("od_id"), "src", "dst")
    worst = bottleneck(route_fragility(graph, od, worst=True)).agg(F.avg("ratio").alias("m"))
    return worst.select(F.lit(n).cast("long").alias("entry_points"), F.when(F.col("m").isNotNull(), 1 / (1 + F.col("m"))).otherwise(0.0).alias("score"))


@dataclass(frozen=True)
class Area:
    """What the scores of an area's runs share: its graph, bridges, connectivity, entries and accessibility."""

    graph: LocalGraph
    bridges: int
    connectivity: float
    entries: int
    access: float


def _area(graph: RoadGraph, ring: Sequence[tuple[float, float]], spectra: bool = True, context: bool = False) -> Area:
    sub = graph.subgraph(ring)
    sub = RoadGraph(materialize(sub.nodes, "area_nodes"), materialize(sub.edges, "area_edges"))
    g = sub.local()
    if context:
        entries = entry_points(graph, sub.nodes).count()
        access = 0.5 if entries > 1 else 0.0
    else:
        entries, access = accessibility(graph, sub).first()
    return Area(g, len(kernels.bridges(g)), kernels.algebraic_connectivity(g) if spectra else 0.0, entries, access)


def area_scores(graph: RoadGraph, ring: Sequence[tuple[float, float]], od: int = 100, seed: int = 42, blocked: DataFrame | None = None, spectra: bool = True, context: bool = False, area: Area | None = None) -> DataFrame:
    """One row of sub-scores of an area: bridge, connectivity, accessibility, fragility, and the counts they come from.

    ``blocked`` (src, dst) fails both ways for the sampled pairs only; disconnected pairs are counted, not averaged.  With
    ``context`` the accessibility is 0.5 for more than one entry and 0 otherwise.  ``area``: what is known of the ring already.
    """
    area = area or _area(graph, ring, spectra, context)
    spark, g, n_bridges, ac, entries, access = graph.spark, area.graph, area.bridges, area.connectivity, area.entries, area.access
    gone = both_ways((g.at(r[0]), g.at(r[1])) for r in blocked.select("src", "dst").collect()) if blocked is not None else frozenset()
    ratios, lost = [], 0
    rng = np.random.Generator(np.random.PCG64(seed))
    for s, t in rng.integers(0, g.n, (od, 2)).tolist() if g.n > 1 else ():
        if s != t:
            full = dijkstra(g.adjacent, s, target=t)[0][t]
            if math.isfinite(full) and full > 0:
                d = dijkstra(g.adjacent, s, gone, t)[0][t] if gone else full
                ratios.append(d / full) if math.isfinite(d) else None
                lost += not math.isfinite(d)
    ratios.sort()
    at = [ratios[percentile_at(len(ratios), a, 100)] if ratios else None for a in (25, 50, 75, 90, 99)]
    fragility = 1 - (1 / (1 + sum(ratios) / len(ratios)) if ratios else 0.5)
    row = (g.n, len(g.src), n_bridges, int(entries), float(ac), lost, n_bridges / max(1, len(g.src) // 2), 1 / (1 + ac) if ac > 0 else 1.0, 1 - float(access), fragility, *at)
    return spark.createDataFrame([row], "nodes long, edges long, bridges long, entries long, algebraic_connectivity double, n_disconnected long, bridge double, connectivity double, accessibility double, fragility double, p25 double, p50 double, p75 double, p90 double, p99 double")


def area_index(scores: DataFrame, weights: dict[str, float] = AREA_WEIGHTS) -> DataFrame:
    """Sub-scores with their weighted composite."""
    return scores.withColumn("composite", sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0)))


def scenario(graph: RoadGraph, ring: Sequence[tuple[float, float]], hazard: Sequence[tuple[float, float]] | None = None, blocked: DataFrame | None = None, spectra: bool = True, context: bool = False, **how) -> DataFrame:
    """One row: baseline, scenario, delta, relative, blocked edges and bridges blocked, for a hazard polygon or given (src, dst)."""
    cut = graph.edges_in_polygon(hazard) if hazard is not None else blocked.select("src", "dst")
    cut = materialize(cut.distinct(), "blocked")
    area = _area(graph, ring, spectra, context)
    a, b = (area_index(area_scores(graph, ring, blocked=x, area=area, **how)).first() for x in (None, cut))
    hits = bridges(graph.subgraph(ring)).join(cut.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct(), ["u", "v"], "left_semi").count()
    base, now = a["composite"], b["composite"]
    return graph.spark.createDataFrame([(base, now, now - base, (now - base) / base if base else 0.0, cut.count(), hits)], "baseline double, scenario double, delta double, relative double, blocked long, bridges_blocked long")


def ensemble(graph: RoadGraph, ring: Sequence[tuple[float, float]], runs: int = 20, seed: int = 42, spectra: bool = True, context: bool = False, **how) -> DataFrame:
    """(run, composite): run i has the seed ``seed`` + i for its sampled pairs; nothing else of the area depends on it."""
    area = _area(graph, ring, spectra, context)
    rows = [(i, area_index(area_scores(graph, ring, seed=seed + i, area=area, **how)).first()["composite"]) for i in range(runs)]
    return graph.spark.createDataFrame(rows, "run int, composite double")


def ensemble_stats(runs: DataFrame) -> DataFrame:
    """One row: mean, std, min, max, p25, p50, p75, cv."""
    s = F.array_sort(F.collect_list("composite"))
    at = lambda a: F.get(s, F.least(F.size(s) - 1, F.floor(F.size(s) * a / 100)).cast("int"))
    return runs.agg(F.avg("composite").alias("mean"), F.coalesce(F.stddev_samp("composite"), F.lit(0.0)).alias("std"), F.min("composite").alias("min"), F.max("composite").alias("max"), *[at(p).alias(f"p{p}") for p in (25, 50, 75)]).withColumn("cv", F.when(F.col("mean") != 0, F.col("std") / F.col("mean")).otherwise(0.0))

