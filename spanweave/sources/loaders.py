"""Sources: edge lists, arrays, map extracts, region files, elevation tiles, synthetic graphs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanweave.functions.geo import haversine
from spanweave.functions.overlays import SPEED_CAR, lookup
from spanweave.graph import RoadGraph

#: Tags kept from ways.
WAY_TAGS = ("highway", "name", "surface", "bridge", "tunnel", "maxspeed", "lanes", "ref")

#: Property names of ids and labels in census region files.
TIGER = {"county": ("GEOID", "NAMELSAD"), "state": ("STATEFP", "NAME"), "cbsa": ("CBSAFP", "NAME"), "place": ("GEOID", "NAMELSAD"), "urban_area": ("UACE10", "NAME10")}


def edges_from_lines(lines: DataFrame, src: str = "source", dst: str = "target", weight: str = "weight", delimiter: str = ",", header: bool = True, bidirectional: bool = False) -> RoadGraph:
    """Graph of delimited lines (seq, line): ids become dense by first appearance, source before target.

    Columns are found by name in the first line, or are the first three without a header; fields are trimmed of blanks and rows
    that are too short or not numeric are skipped.
    """
    cut = lines.select("seq", F.transform(F.split("line", delimiter.replace("|", r"\|").replace("\t", r"\t")), lambda x: F.trim(x)).alias("f"))
    at = (0, 1, 2)
    if header:
        first = cut.orderBy("seq").first()
        if first is None:
            raise ValueError("no lines")
        missing = [c for c in (src, dst, weight) if c not in first["f"]]
        if missing:
            raise ValueError(f"no column {', '.join(missing)}")
        at = tuple(first["f"].index(c) for c in (src, dst, weight))
        cut = cut.where(F.col("seq") > first["seq"])
    e = cut.select("seq", *[F.get("f", F.lit(i)).try_cast(t).alias(n) for i, t, n in zip(at, ("long", "long", "double"), ("a", "b", "weight"), strict=True)]).where("a is not null and b is not null and weight is not null")
    seen = e.select(F.col("a").alias("id"), (F.col("seq") * 2).alias("s")).union(e.select("b", F.col("seq") * 2 + 1)).groupBy("id").agg(F.min("s").alias("s"))
    ids = seen.select("id", (F.row_number().over(Window.orderBy("s")) - 1).cast("long").alias("node_id"))
    out = e.join(ids.select(F.col("id").alias("a"), F.col("node_id").alias("src")), "a").join(ids.select(F.col("id").alias("b"), F.col("node_id").alias("dst")), "b").select("src", "dst", "weight")
    if bidirectional:
        out = out.union(out.select("dst", "src", "weight"))
    return RoadGraph.from_edges(out, ids.select("node_id", F.col("id").alias("original_id")))


def read_edge_csv(spark: SparkSession, path: str, **how) -> RoadGraph:
    """As ``edges_from_lines``, of a file; line order within a file is kept."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line")).where("trim(line) <> ''")
    return edges_from_lines(lines, **how)


def read_od_csv(spark: SparkSession, path: str) -> DataFrame:
    """(od_id, src, dst) of source,target rows; lines that begin with # are comments."""
    od = spark.read.csv(path, schema="src long, dst long", comment="#").where("src is not null and dst is not null")
    return od.select((F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) - 1).cast("long").alias("od_id"), "src", "dst")


def from_arrays(spark: SparkSession, offsets: Sequence[int], targets: Sequence[int], weights: Sequence[float]) -> RoadGraph:
    """Graph of compressed rows: node u has the targets from offsets[u] up to offsets[u + 1]."""
    n = len(offsets) - 1
    src = np.repeat(np.arange(n), np.diff(np.asarray(offsets)))
    e = spark.createDataFrame(pd.DataFrame({"edge_id": np.arange(len(src)), "src": src, "dst": np.asarray(targets, np.int64), "weight": np.asarray(weights, float)}), "edge_id long, src long, dst long, weight double")
    return RoadGraph(spark.range(n).select(F.col("id").alias("node_id")), e)


def rows_to_edges(rows: DataFrame) -> RoadGraph:
    """The same from a table (node_id, targets array, weights array)."""
    e = rows.select(F.col("node_id").alias("src"), F.posexplode(F.arrays_zip("targets", "weights")).alias("at", "x")).select((F.row_number().over(Window.orderBy("src", "at")) - 1).cast("long").alias("edge_id"), "src", F.col("x.targets").alias("dst"), F.col("x.weights").alias("weight"))
    return RoadGraph(rows.select("node_id"), e)


def from_osm_tables(osm_nodes: DataFrame, osm_ways: DataFrame, speeds: dict[str, float] = SPEED_CAR, keep_tags: bool = False) -> RoadGraph:
    """Graph of extracted map tables: (id, lat, lon) and (way_id, nodes array, highway, oneway, other tags).

    Ways of a class with a speed; weight is metres over metres a second; oneway yes, 1 or true and motorways (and their links) run
    one way; consecutive references to missing nodes give no edge.
    """
    tags = [t for t in WAY_TAGS if t in osm_ways.columns] if keep_tags else []
    ways = osm_ways.withColumn("kmh", lookup(F.col("highway"), speeds)).where("kmh is not null and size(nodes) > 1")
    one = F.coalesce(F.col("oneway").isin("yes", "1", "true"), F.lit(False)) | F.col("highway").isin("motorway", "motorway_link")
    steps = ways.select("kmh", one.alias("one"), *[F.col(t) for t in tags], F.explode(F.expr("transform(sequence(0, size(nodes) - 2), i -> struct(nodes[i] as src, nodes[i + 1] as dst))")).alias("s")).select("kmh", "one", *tags, "s.src", "s.dst")
    c = osm_nodes.select("id", "lat", "lon")
    e = steps.join(c.select(F.col("id").alias("src"), F.col("lat").alias("a"), F.col("lon").alias("b")), "src").join(c.select(F.col("id").alias("dst"), F.col("lat").alias("c"), F.col("lon").alias("d")), "dst")
    e = e.select("src", "dst", (haversine("a", "b", "c", "d") / (F.col("kmh") / 3.6)).alias("weight"), "one", *tags)
    both = e.select("src", "dst", "weight", *tags).union(e.where("not one").select(F.col("dst"), F.col("src"), "weight", *tags))
    used = both.select(F.col("src").alias("node_id")).union(both.select("dst")).distinct()
    return RoadGraph.from_edges(both, used.join(osm_nodes.select(F.col("id").alias("node_id"), "lat", "lon"), "node_id"))


def regions_from_text(texts: DataFrame, id_prop: str = "GEOID", label_prop: str = "NAMELSAD") -> DataFrame:
    """(region_idx, region_id, label, boundary) of feature collections (file, text).

    Outer ring of a polygon, of the first polygon of several; [lon, lat] becomes lat, lon; fewer than three vertices and other
    geometries go; no features gives no rows; an id that is no string is written as JSON.
    """
    feats = texts.select("file", F.from_json("text", "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>").alias("j")).select("file", F.posexplode("j.features").alias("i", "f"))
    polygon = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    several = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    ring = F.when(F.col("f.geometry.type") == "Polygon", F.get(polygon, F.lit(0))).when(F.col("f.geometry.type") == "MultiPolygon", F.get(F.get(several, F.lit(0)), F.lit(0)))
    out = feats.select("file", "i", F.col("f.properties")[id_prop].alias("region_id"), F.col("f.properties")[label_prop].alias("label"), F.transform(ring, lambda p: F.struct(F.get(p, F.lit(1)).alias("lat"), F.get(p, F.lit(0)).alias("lon"))).alias("boundary")).where("size(boundary) >= 3")
    return out.select((F.row_number().over(Window.orderBy("file", "i")) - 1).cast("int").alias("region_idx"), "region_id", "label", "boundary")


def read_regions_geojson(spark: SparkSession, path: str, id_prop: str = "GEOID", label_prop: str = "NAMELSAD") -> DataFrame:
    return regions_from_text(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")), id_prop, label_prop)


def read_tiger(spark: SparkSession, path: str, level: str = "county") -> DataFrame:
    """Census regions of a level: county, state, cbsa, place or urban_area."""
    return read_regions_geojson(spark, path, *TIGER[level])


VOID = -32768


def srtm_elevation(graph: RoadGraph, folder: str) -> DataFrame:
    """(node_id, elevation) from one-degree tiles such as N35W083.hgt of 1201 or 3601 squared big-endian 16-bit values.

    Bilinear between the four corners; with a void corner, the first known one; null without a tile.  Nodes meet tiles by name.
    """
    name = lambda v, pos, neg, width: F.concat(F.when(F.floor(v) >= 0, pos).otherwise(neg), F.lpad(F.abs(F.floor(v)).cast("string"), width, "0"))
    n = graph.nodes.where("lat is not null and lon is not null").select("node_id", "lat", "lon", F.concat(name(F.col("lat"), "N", "S", 2), name(F.col("lon"), "E", "W", 3)).alias("tile"))
    tiles = graph.spark.read.format("binaryFile").option("pathGlobFilter", "*.hgt").load(folder).select(F.upper(F.regexp_extract("path", r"([NSns]\d+[EWew]\d+)\.hgt$", 1)).alias("tile"), "content")
    a, b = n.groupBy("tile"), tiles.groupBy("tile")

    def run(pts: pd.DataFrame, tile: pd.DataFrame) -> pd.DataFrame:
        out = np.full(len(pts), np.nan)
        if len(tile) and len(pts):
            raw = np.frombuffer(tile["content"].iloc[0], ">i2")
            size = int(round(len(raw) ** 0.5))
            if size in (1201, 3601) and size * size == len(raw):
                z = raw.reshape(size, size).astype(float)
                y, x = (np.floor(pts["lat"]) + 1 - pts["lat"]).to_numpy() * (size - 1), (pts["lon"] - np.floor(pts["lon"])).to_numpy() * (size - 1)
                i, j = np.minimum(y.astype(int), size - 2), np.minimum(x.astype(int), size - 2)
                c = np.stack([z[i, j], z[i, j + 1], z[i + 1, j], z[i + 1, j + 1]])
                fy, fx = y - i, x - j
                out = c[0] * (1 - fy) * (1 - fx) + c[1] * (1 - fy) * fx + c[2] * fy * (1 - fx) + c[3] * fy * fx
                void = (c == VOID).any(0)
                first = np.where(c != VOID, c, np.nan)
                for k in np.flatnonzero(void):
                    known = first[:, k][~np.isnan(first[:, k])]
                    out[k] = known[0] if len(known) else np.nan
        return pd.DataFrame({"node_id": pts["node_id"].to_numpy(), "elevation": out})

    found = a.cogroup(b).applyInPandas(run, "node_id long, elevation double")
    return found.select("node_id", F.when(~F.isnan("elevation"), F.col("elevation")).alias("elevation"))


def grid_graph(spark: SparkSession, rows: int, cols: int) -> RoadGraph:
    """Unit grid, id = row * cols + col, both directions."""
    n = spark.range(rows * cols).select(F.col("id").alias("node_id"))
    right = n.where((F.col("node_id") % cols) < cols - 1).select(F.col("node_id").alias("src"), (F.col("node_id") + 1).alias("dst"))
    down = n.where(F.col("node_id") < (rows - 1) * cols).select("node_id", (F.col("node_id") + cols))
    e = right.union(down)
    return RoadGraph.from_edges(e.union(e.select("dst", "src")).withColumn("weight", F.lit(1.0)), n)


def _draw(seed: int, n: int, *cols) -> F.Column:
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(n))


def random_graph(spark: SparkSession, n: int, m: int, low: float = 1.0, high: float = 100.0, seed: int = 42) -> RoadGraph:
    """Random spanning tree and m - n + 1 further edges, both directions, weights in [low, high]; seeded by hashes."""
    nodes = spark.range(n).select(F.col("id").alias("node_id"))
    tree = spark.range(1, n).select(F.col("id").alias("src"), F.pmod(F.xxhash64("id", F.lit(seed)), F.col("id")).alias("dst"), F.col("id").alias("k"))
    more = spark.range(max(0, m - n + 1)).select(_draw(seed + 1, n, "id").alias("src"), _draw(seed + 2, n, "id").alias("dst"), (F.col("id") + n).alias("k")).where("src <> dst")
    e = tree.union(more).withColumn("weight", low + (high - low) * _draw(seed + 3, 1 << 30, "k") / float(1 << 30)).drop("k")
    return RoadGraph.from_edges(e.union(e.select("dst", "src", "weight")), nodes)


def tree_graph(spark: SparkSession, n: int, extra: int, seed: int = 42) -> RoadGraph:
    """Random tree with ``extra`` further edges, weights in [1, 50]."""
    return random_graph(spark, n, n - 1 + extra, 1.0, 50.0, seed)

