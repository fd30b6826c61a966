"""Shortest paths.  Two ways for the same answers: kernels over a shipped local graph (one row of work a task unit), and an
iterative join for graphs too large to ship."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.graph import LocalGraph, RoadGraph
from spanweave.operators import batches
from spanweave.operators.kernels import INF, dijkstra, path_to
from spanweave.shared import materialize


def _tasks(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def _ship(graph: RoadGraph | LocalGraph, spark):
    return spark.sparkContext.broadcast(graph if isinstance(graph, LocalGraph) else graph.local())


def shortest_paths(graph: RoadGraph, sources: DataFrame, limit: float = INF) -> DataFrame:
    """(source, node_id, dist, pred) of every node reachable from each of ``sources`` (source); pred is null at the source."""
    spark = graph.spark
    shipped = _ship(graph, spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shipped.value
        for f in frames:
            for s in f["source"]:
                at = g.at(int(s))
                if at < 0:
                    continue
                d, p = dijkstra(g.adjacent, at, limit=limit)
                d, p = np.array(d), np.array(p)
                ok = np.flatnonzero(d <= limit) if limit < INF else np.flatnonzero(np.isfinite(d))
                pred = pd.array(np.where(p[ok] >= 0, g.ids[np.maximum(p[ok], 0)], 0), "Int64")
                pred[p[ok] < 0] = pd.NA
                yield pd.DataFrame({"source": int(s), "node_id": g.ids[ok], "dist": d[ok], "pred": pred})

    s = sources.select(F.col("source").cast("long")).distinct()
    return s.repartition(_tasks(s), "source").mapInPandas(run, "source long, node_id long, dist double, pred long")


def shortest_paths_by_joins(graph: RoadGraph, sources: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """The same as ``shortest_paths`` without pred, for graphs of any size: frontier rows join the edges until nothing improves.

    Each round is written to the shared folder, so lineage stays short and lost executors cost one round at most.
    """
    e = graph.edges.groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    best = materialize(sources.select(F.col("source").cast("long").alias("source")).distinct().select("source", F.col("source").alias("node_id"), F.lit(0.0).alias("dist")), "sssp")
    front = best
    for _ in range(most_rounds):
        step = front.join(e, front.node_id == e.src).groupBy("source", F.col("dst").alias("node_id")).agg(F.min(F.col("dist") + F.col("weight")).alias("dist"))
        old = best.withColumnRenamed("dist", "old")
        front = materialize(step.join(old, ["source", "node_id"], "left").where("old is null or dist < old").select("source", "node_id", "dist"), "front")
        if front.isEmpty():
            return best
        best = materialize(best.union(front).groupBy("source", "node_id").agg(F.min("dist").alias("dist")), "sssp")
    raise RuntimeError("shortest paths did not settle")


def _per_pair(graph: RoadGraph, od: DataFrame, schema: str, answer) -> DataFrame:
    """Groups pairs by origin, so each origin is searched once; ``answer(g, dist, pred, source, row)`` gives a row."""
    shipped = _ship(graph, graph.spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shipped.value
        for f in frames:
            out = []
            for s, rows in f.groupby("src"):
                at = g.at(int(s))
                d, p = dijkstra(g.adjacent, at) if at >= 0 else ([INF] * g.n, [-1] * g.n)
                out += [answer(g, d, p, at, r) for r in rows.itertuples()]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    o = od.select("od_id", "src", "dst")
    return o.repartition(_tasks(o), "src").mapInPandas(run, schema)


def _finite(x: float) -> float | None:
    return None if not math.isfinite(x) else x


def _pairs_apart(graph: RoadGraph, g: LocalGraph, od: DataFrame) -> DataFrame:
    """(od_id, dist, level, part, via, s, t) of pairs on a large graph, null where there is no way; s, t: positions.

    Positions are halved level by level.  A shortest path between nodes of an interval either leaves its lower half through one of the
    nodes that border on the upper half, or stays in one half, or leaves the interval.  So searches from these bordering nodes,
    within each interval, give the distance of every pair as the least over the intervals that hold both its ends.
    """
    shipped = graph.spark.sparkContext.broadcast(g)

    def spots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shipped.value
        for f in frames:
            f = f.assign(s=batches.positions(own, f["src"]), t=batches.positions(own, f["dst"]))[["od_id", "s", "t"]]
            s, t = f["s"].to_numpy(), f["t"].to_numpy()
            inside = (s >= 0) & (t >= 0)
            yield f[~inside].assign(level=-1, part=0, chunk=0)
            for level, both in enumerate(batches.common_levels(own, s, t)):
                some = f[both & inside]
                for chunk in range(batches.chunks(level)):
                    yield some.assign(level=level, part=some["s"].to_numpy() >> (batches.depth(own) + batches.LEAF - level), chunk=chunk)

    def search(f: pd.DataFrame) -> pd.DataFrame:
        level, part, chunk = (int(f[c].iloc[0]) for c in ("level", "part", "chunk"))
        s, t = f["s"].to_numpy(), f["t"].to_numpy()
        best, via = batches.interval_distances(shipped.value, level, part, chunk, s, t) if level >= 0 else (np.full(len(f), INF), np.full(len(f), -1))
        return f[["od_id", "level", "part", "s", "t"]].assign(dist=best, via=via)[np.isfinite(best) | (chunk == 0)]

    o = od.select(*[F.col(c).cast("long").alias(c) for c in ("od_id", "src", "dst")])
    units = o.mapInPandas(spots, "od_id long, s long, t long, level int, part long, chunk int")
    found = units.repartition(8 * _tasks(o), "level", "part", "chunk").groupBy("level", "part", "chunk").applyInPandas(search, "od_id long, level int, part long, s long, t long, dist double, via long")
    best = found.groupBy("od_id", "s", "t").agg(F.min(F.struct("dist", "level", "part", "via")).alias("b")).select("od_id", "s", "t", "b.*")
    return best.withColumn("dist", F.when(F.col("dist") < INF, F.col("dist")))


FAR_NODES = 100_000  # nodes from which on pairs are searched by intervals
FEW_SOURCES = 64  # unless they have no more sources than these


def _far(graph: RoadGraph, od: DataFrame) -> LocalGraph | None:
    """The graph, if it is large and ``od`` has many sources, for searches by intervals."""
    g = graph.local()
    if g.n < FAR_NODES or batches.least_weight(g) <= 0:
        return None
    return g if od.select("src").distinct().limit(FEW_SOURCES + 1).count() > FEW_SOURCES else None


def distances(graph: RoadGraph, od: DataFrame) -> DataFrame:
    """(od_id, dist) of pairs (od_id, src, dst); null if there is no way."""
    far = _far(graph, od)
    if far is not None:
        return _pairs_apart(graph, far, od).select("od_id", "dist")
    return _per_pair(graph, od, "od_id long, dist double", lambda g, d, p, s, r: (r.od_id, _finite(d[g.at(r.dst)]) if g.at(r.dst) >= 0 else None))


def paths(graph: RoadGraph, od: DataFrame) -> DataFrame:
    """(od_id, dist, path): path is [src] for equal ends and empty if there is no way."""
    far = _far(graph, od)
    if far is not None:
        return _paths_apart(graph, far, od)

    g = graph.local()
    if batches.least_weight(g) > 0:
        return _paths_together(graph, g, od)

    def answer(g: LocalGraph, d: list, p: list, s: int, r) -> tuple:
        t = g.at(r.dst)
        return r.od_id, _finite(d[t]) if t >= 0 else None, [int(g.ids[v]) for v in path_to(p, s, t)] if s >= 0 and t >= 0 else []

    return _per_pair(graph, od, "od_id long, dist double, path array<bigint>", answer)


def _paths_together(graph: RoadGraph, g: LocalGraph, od: DataFrame) -> DataFrame:
    """As ``paths``, searches in batches."""
    shipped = graph.spark.sparkContext.broadcast(g)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shipped.value
        rows, none = (own.offset, own.dst, own.weight), np.empty(0, np.int64)
        for f in frames:
            s, t = batches.positions(own, f["src"]), batches.positions(own, f["dst"])
            by, size = np.argsort(s, kind="stable"), batches.batch_size(own)
            for lo in range(0, len(by), size):
                part = by[lo : lo + size]
                known = (s[part] >= 0) & (t[part] >= 0)
                dist, way = np.full(len(part), np.nan), [none] * len(part)
                if known.any():
                    starts, row = np.unique(s[part[known]], return_inverse=True)
                    ahead = batches.spread(own.n, rows, starts, batches.least_weight(own))
                    goal = row * own.n + t[part[known]]
                    for k, w in zip(np.flatnonzero(known).tolist(), batches.walks(own.n, ahead, own.back, goal), strict=True):
                        way[k] = own.ids[w % own.n]
                    dist[known] = np.where(np.isfinite(ahead[goal]), ahead[goal], np.nan)
                yield pd.DataFrame({"od_id": f["od_id"].to_numpy()[part], "dist": dist, "path": way})

    o = od.select("od_id", "src", "dst")
    out = o.repartitionByRange(4 * _tasks(o), "src", "od_id").mapInPandas(run, "od_id long, dist double, path array<bigint>")
    return out.withColumn("dist", F.when(~F.isnan("dist"), F.col("dist")))


def _paths_apart(graph: RoadGraph, g: LocalGraph, od: DataFrame) -> DataFrame:
    """As ``paths``, on a large graph: by way of the node that gave each pair's distance."""
    shipped = graph.spark.sparkContext.broadcast(g)
    found = materialize(_pairs_apart(graph, g, od), "pairs")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shipped.value
        for f in frames:
            for (level, part), rows in f.groupby(["level", "part"]):
                for lot, ways in batches.interval_paths(own, int(level), int(part), *(rows[c].to_numpy() for c in ("via", "s", "t"))):
                    yield pd.DataFrame({"od_id": rows["od_id"].to_numpy()[lot], "dist": rows["dist"].to_numpy()[lot], "path": [own.ids[w] for w in ways]})

    root = F.when(F.col("via") >= 0, F.col("via")).otherwise(F.col("s"))
    some = found.where("dist is not null").withColumn("root", root)
    some = some.repartitionByRange(8 * _tasks(od), "level", "part", "root", "od_id").sortWithinPartitions("level", "part", "root")
    none = found.where("dist is null").select("od_id", "dist", F.array().cast("array<bigint>").alias("path"))
    return some.drop("root").mapInPandas(run, "od_id long, dist double, path array<bigint>").union(none)


def distance_matrix(graph: RoadGraph, origins: DataFrame, destinations: DataFrame) -> DataFrame:
    """(origin, dest, dist) of all pairs of (node_id) tables; one search for each node of the smaller table, null if there is no way."""
    g = graph.local()
    shipped = graph.spark.sparkContext.broadcast(g)
    o, d = (materialize(x.select(F.col("node_id").cast("long")).distinct(), "ends") for x in (origins, destinations))
    turned = d.count() < o.count()
    few, many = (d, o) if turned else (o, d)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shipped.value
        quick = batches.least_weight(own) > 0
        for f in frames:
            a, b = f["a"].to_numpy(), f["b"].to_numpy()
            from_, to = batches.positions(own, a), batches.positions(own, b)
            for s in np.unique(from_):
                rows = np.flatnonzero(from_ == s)
                if s < 0:
                    dist = np.full(own.n, INF)
                elif quick:
                    dist = searched(own, s)
                else:
                    dist = np.array(dijkstra(own.reverse if turned else own.adjacent, int(s))[0])
                out = np.where(to[rows] >= 0, dist[np.maximum(to[rows], 0)] if own.n else INF, INF)
                x, y = (b[rows], a[rows]) if turned else (a[rows], b[rows])
                yield pd.DataFrame({"origin": x, "dest": y, "dist": np.where(np.isfinite(out), out, np.nan)})

    held: dict = {}

    def searched(own: LocalGraph, s: int) -> np.ndarray:
        """A partition's rows come sorted, so the last search is often the one wanted."""
        if s not in held:
            held.clear()
            held[s] = batches.spread(own.n, own.back if turned else (own.offset, own.dst, own.weight), np.array([s]), batches.least_weight(own))
        return held[s]

    pairs = few.withColumnRenamed("node_id", "a").crossJoin(many.withColumnRenamed("node_id", "b")).repartition(4 * _tasks(o), "a").sortWithinPartitions("a")
    return pairs.mapInPandas(run, "origin long, dest long, dist double").withColumn("dist", F.when(~F.isnan("dist"), F.col("dist")))


def distances_blocked(graph: RoadGraph, od: DataFrame, blocked: DataFrame) -> DataFrame:
    """Distances without the directed pairs (src, dst) of ``blocked``, all parallel edges of them."""
    e = graph.edges.join(blocked.select("src", "dst").distinct(), ["src", "dst"], "left_anti").select(*graph.edges.columns)
    return distances(RoadGraph(graph.nodes, e), od)


def distances_snapped(graph: RoadGraph, trips: DataFrame) -> DataFrame:
    """(od_id, dist) between snapped points: (od_id, a_src, a_dst, a_t, a_weight, b_src, b_dst, b_t, b_weight).

    The least of four combinations of ends, each with its part of the edge's weight; null for unsnapped points.
    """
    ends = lambda p: F.array(F.struct(F.col(f"{p}_src").alias("n"), (F.col(f"{p}_t") * F.col(f"{p}_weight")).alias("c")), F.struct(F.col(f"{p}_dst").alias("n"), ((1 - F.col(f"{p}_t")) * F.col(f"{p}_weight")).alias("c")))
    four = trips.select("od_id", F.explode(ends("a")).alias("a"), ends("b").alias("bs")).select("od_id", "a", F.explode("bs").alias("b"))
    four = four.select("od_id", F.col("a.n").alias("source"), F.col("b.n").alias("node_id"), (F.col("a.c") + F.col("b.c")).alias("extra")).where("source is not null and node_id is not null")
    ways = four.select("source", "node_id").distinct().select(F.monotonically_increasing_id().alias("od_id"), F.col("source").alias("src"), F.col("node_id").alias("dst"))
    ways = materialize(ways, "ways")
    d = ways.join(distances(graph, ways).where("dist is not null"), "od_id").select(F.col("src").alias("source"), F.col("dst").alias("node_id"), "dist")
    best = four.join(d, ["source", "node_id"]).groupBy("od_id").agg(F.min(F.col("dist") + F.col("extra")).alias("dist"))
    return trips.select("od_id").join(best, "od_id", "left")


def landmarks(graph: RoadGraph, count: int = 16, seed: int = 42) -> DataFrame:
    """(landmark, node_id, d_from, d_to): farthest-first landmarks from a seeded start, ties to the lowest id."""
    g = graph.local()
    chosen, least = [], np.full(g.n, INF)
    nxt = int(np.random.Generator(np.random.PCG64(seed)).integers(g.n)) if g.n else -1
    while nxt >= 0 and len(chosen) < count:
        chosen.append(nxt)
        least = np.minimum(least, np.array(dijkstra(g.adjacent, nxt)[0]))
        reach = np.where(np.isfinite(least), least, -1)
        nxt = int(np.argmax(reach)) if reach.max() > 0 else -1
    spark, shipped = graph.spark, _ship(g, graph.spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shipped.value
        for f in frames:
            for k in f["at"]:
                a, b = (np.array(dijkstra(adj, int(k))[0]) for adj in (own.adjacent, own.reverse))
                yield pd.DataFrame({"landmark": int(own.ids[k]), "node_id": own.ids, "d_from": np.where(np.isfinite(a), a, np.nan), "d_to": np.where(np.isfinite(b), b, np.nan)})

    out = spark.createDataFrame([(k,) for k in chosen], "at long").repartition(max(1, len(chosen))).mapInPandas(run, "landmark long, node_id long, d_from double, d_to double")
    return out.select("landmark", "node_id", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("d_from", "d_to")])


def alt_bound(od: DataFrame, marks: DataFrame) -> DataFrame:
    """(od_id, bound): greatest triangle bound over landmarks, of distances both from and to them; for symmetric graphs."""
    marks = materialize(marks, "marks")  # its true size decides on the joins
    s = marks.select("landmark", F.col("node_id").alias("src"), F.col("d_from").alias("fs"), F.col("d_to").alias("ts"))
    t = marks.select("landmark", F.col("node_id").alias("dst"), F.col("d_from").alias("ft"), F.col("d_to").alias("tt"))
    gap = F.greatest(F.abs(F.col("fs") - F.col("ft")), F.abs(F.col("ts") - F.col("tt")))
    best = od.join(s, "src").join(t, ["landmark", "dst"]).groupBy("od_id").agg(F.max(gap).alias("bound"))
    return od.select("od_id").join(best, "od_id", "left").select("od_id", F.coalesce("bound", F.lit(0.0)).alias("bound"))


def shortest_path_edges(graph: RoadGraph, dist: DataFrame) -> DataFrame:
    """Edges on some shortest path from each source of ``dist`` (source, node_id, dist), within 1e-6 of the larger distance."""
    dist = materialize(dist.select("source", "node_id", "dist"), "dist")  # its true size decides on the joins
    a = dist.select("source", F.col("node_id").alias("src"), F.col("dist").alias("du"))
    b = dist.select("source", F.col("node_id").alias("dst"), F.col("dist").alias("dv"))
    on = F.abs(F.col("du") + F.col("weight") - F.col("dv")) < 1e-6 * F.greatest(F.lit(1.0), F.col("du"), F.col("dv"))
    return graph.edges.join(a, "src").join(b, ["source", "dst"]).where(on).select("source", *[c for c in graph.edges.columns])


def alternative_routes(graph: RoadGraph, od: DataFrame, max_stretch: float = 1.25, max_sharing: float = 0.8, k: int = 3) -> DataFrame:
    """(od_id, rank, via, dist, path, sharing, stretch): up to k routes over a via node off the primary path.

    Candidates by d(s, v) + d(v, t); rejected beyond the stretch, at the sharing limit or as a repeated path.
    """
    shipped = _ship(graph, graph.spark)
    names = ["od_id", "rank", "via", "dist", "path", "sharing", "stretch"]

    def together(g: LocalGraph, f: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Pairs in batches, those of one origin together."""
        s, t = batches.positions(g, f["src"]), batches.positions(g, f["dst"])
        some = np.flatnonzero((s >= 0) & (t >= 0) & (s != t))
        od_id, out = f["od_id"].to_numpy()[some], []
        for j, routes in batches.alternatives(g, s[some], t[some], max_stretch, max_sharing, k):
            out += [(od_id[j], rank, g.ids[v], c, g.ids[way], sharing, longer) for rank, (v, c, way, sharing, longer) in enumerate(routes, 1)]
            if len(out) > 2000:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shipped.value
        for f in frames:
            if batches.least_weight(g) > 0:
                yield from together(g, f)
                continue
            out = []
            for r in f.itertuples():
                s, t = g.at(r.src), g.at(r.dst)
                if s < 0 or t < 0 or s == t:
                    continue
                d, p = dijkstra(g.adjacent, s)
                e, q = dijkstra(g.reverse, t)
                if not math.isfinite(d[t]):
                    continue
                main = path_to(p, s, t)
                own, used, seen = set(zip(main, main[1:])), set(main), {tuple(main)}
                total = [(d[v] + e[v], v) for v in range(g.n) if v not in used and d[v] + e[v] <= max_stretch * d[t]]
                found = 0
                for c, v in sorted(total):
                    way = path_to(p, s, v) + path_to(q, t, v)[::-1][1:]
                    key = tuple(way)
                    if key in seen or len(set(way)) < len(way):
                        continue
                    seen.add(key)
                    steps = list(zip(way, way[1:]))
                    sharing = sum(x in own for x in steps) / len(steps)
                    if sharing >= max_sharing:
                        continue
                    found += 1
                    out.append((r.od_id, found, int(g.ids[v]), c, [int(g.ids[x]) for x in way], sharing, c / d[t] if d[t] else 1.0))
                    if found == k:
                        break
            yield pd.DataFrame(out, columns=names)

    o = od.select("od_id", "src", "dst")
    return o.repartitionByRange(4 * _tasks(o), "src", "od_id").mapInPandas(run, "od_id long, rank int, via long, dist double, path array<bigint>, sharing double, stretch double")

