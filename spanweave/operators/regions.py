"""Regions: assignment, borders, coarsening, crosswalk, reduced graphs.  Region tables: (region_idx, region_id, label, boundary)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanweave.functions.geo import haversine, point_in_polygon
from spanweave.graph import RoadGraph, by_shuffle
from spanweave.operators.paths import shortest_paths
from spanweave.shared import materialize

CELL = 0.25  # degrees of the grid that nodes and region boxes meet on


def _boxes(regions: DataFrame) -> DataFrame:
    low = lambda f: F.aggregate("boundary", F.lit(None).cast("double"), lambda a, v: F.least(a, v[f]))
    high = lambda f: F.aggregate("boundary", F.lit(None).cast("double"), lambda a, v: F.greatest(a, v[f]))
    return regions.where(F.size("boundary") >= 3).select("region_idx", "boundary", low("lat").alias("a"), high("lat").alias("b"), low("lon").alias("c"), high("lon").alias("d"))


def assign_regions(nodes: DataFrame, regions: DataFrame) -> DataFrame:
    """(node_id, region_idx): the first region in list order that holds the node, null if none.

    Nodes and region boxes meet by equal grid cells, so the join is an equi-join whatever the sizes; then box, then polygon.
    """
    cell = lambda x: F.floor(x / CELL)
    box = _boxes(regions).withColumn("ci", F.explode(F.sequence(cell(F.col("a")), cell(F.col("b"))))).withColumn("cj", F.explode(F.sequence(cell(F.col("c")), cell(F.col("d")))))
    pts = nodes.where("lat is not null and lon is not null").select("node_id", "lat", "lon", cell(F.col("lat")).alias("ci"), cell(F.col("lon")).alias("cj"))
    hit = pts.join(box, ["ci", "cj"]).where("lat between a and b and lon between c and d").where(point_in_polygon("lat", "lon", "boundary"))
    found = hit.groupBy("node_id").agg(F.min("region_idx").alias("region_idx"))
    return nodes.select("node_id").join(by_shuffle(found), "node_id", "left")


def region_counts(assignment: DataFrame, regions: DataFrame) -> DataFrame:
    """(region_idx, node_count) of every region, and a row with a null region for unassigned nodes."""
    n = assignment.groupBy("region_idx").agg(F.count("*").alias("node_count"))
    named = regions.select("region_idx").join(n, "region_idx", "left").select("region_idx", F.coalesce("node_count", F.lit(0)).alias("node_count"))
    return named.union(assignment.where("region_idx is null").groupBy("region_idx").count())


def with_regions(graph: RoadGraph, assignment: DataFrame) -> DataFrame:
    """Edges with the regions of their ends, ra and rb."""
    a = assignment.select(F.col("node_id").alias("src"), F.col("region_idx").alias("ra"))
    b = assignment.select(F.col("node_id").alias("dst"), F.col("region_idx").alias("rb"))
    return graph.edges.join(by_shuffle(a), "src", "left").join(by_shuffle(b), "dst", "left")


def border_edges(graph: RoadGraph, assignment: DataFrame) -> DataFrame:
    """(region_a, region_b, edge_count, total_weight, min_weight, max_weight) of each unordered pair of different regions."""
    e = with_regions(graph, assignment).where("ra <> rb")
    return e.groupBy(F.least("ra", "rb").alias("region_a"), F.greatest("ra", "rb").alias("region_b")).agg(F.count("*").alias("edge_count"), F.sum("weight").alias("total_weight"), F.min("weight").alias("min_weight"), F.max("weight").alias("max_weight"))


def border_totals(graph: RoadGraph, assignment: DataFrame) -> DataFrame:
    """One row: connected_pairs, border_edges, unassigned_edges (one end assigned only)."""
    e = with_regions(graph, assignment)
    return e.agg(F.countDistinct(F.when(F.col("ra") != F.col("rb"), F.struct(F.least("ra", "rb"), F.greatest("ra", "rb")))).alias("connected_pairs"), F.count(F.when(F.col("ra") != F.col("rb"), 1)).alias("border_edges"), F.count(F.when(F.col("ra").isNull() != F.col("rb").isNull(), 1)).alias("unassigned_edges"))


def boundary_nodes(graph: RoadGraph, assignment: DataFrame) -> DataFrame:
    """Unassigned nodes, nodes with an edge into another region, and the first such edge's target (by edge id)."""
    e = with_regions(graph, assignment).where("ra is not null and (rb is null or ra <> rb)")
    first = e.groupBy(F.col("src")).agg(F.min_by("dst", "edge_id").alias("dst"))
    loose = assignment.where("region_idx is null").select("node_id")
    return loose.union(first.select("src")).union(first.select("dst")).distinct()


def coarsen(graph: RoadGraph, assignment: DataFrame, regions: DataFrame, min_edges: int = 1) -> RoadGraph:
    """A node for each region (node_count, internal_edges, mean coordinates) and edges both ways with the least border weight."""
    inner = with_regions(graph, assignment).where("ra = rb").groupBy(F.col("ra").alias("region_idx")).agg(F.count("*").alias("internal_edges"))
    own = assignment.where("region_idx is not null").join(graph.nodes.select("node_id", "lat", "lon"), "node_id").groupBy("region_idx").agg(F.count("*").alias("node_count"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    nodes = regions.select("region_idx").join(own, "region_idx", "left").join(inner, "region_idx", "left").select(F.col("region_idx").cast("long").alias("node_id"), zero("node_count"), zero("internal_edges"), "lat", "lon")
    b = border_edges(graph, assignment).where(F.col("edge_count") >= min_edges)
    e = b.select(F.col("region_a").cast("long").alias("src"), F.col("region_b").cast("long").alias("dst"), F.col("min_weight").alias("weight"))
    return RoadGraph.from_edges(e.union(e.select("dst", "src", "weight")), nodes)


def entry_points(graph: RoadGraph, inside: DataFrame) -> DataFrame:
    """(node_id) of nodes of the subgraph (node_id) with an edge out of it."""
    ids = inside.select("node_id").distinct()
    e = graph.edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_anti")
    return e.select(F.col("src").alias("node_id")).distinct()


def fips_crosswalk(counties: DataFrame, cbsas: DataFrame | None = None) -> DataFrame:
    """(county_fips, county_name, state_fips, cbsa_code, cbsa_name): the first area that holds the county's first vertex."""
    c = counties.select(F.col("region_id").alias("county_fips"), F.col("label").alias("county_name"), F.substring("region_id", 1, 2).alias("state_fips"), F.get("boundary", F.lit(0)).alias("v"))
    if cbsas is None:
        return c.select("county_fips", "county_name", "state_fips", F.lit(None).cast("string").alias("cbsa_code"), F.lit(None).cast("string").alias("cbsa_name"))
    pts = c.select(F.col("county_fips").alias("node_id"), F.col("v.lat").alias("lat"), F.col("v.lon").alias("lon"))
    found = assign_regions(pts, cbsas).join(cbsas.select("region_idx", F.col("region_id").alias("cbsa_code"), F.col("label").alias("cbsa_name")), "region_idx")
    return c.join(found, c.county_fips == found.node_id, "left").select("county_fips", "county_name", "state_fips", "cbsa_code", "cbsa_name")


def counties_in(crosswalk: DataFrame, column: str) -> DataFrame:
    """(``column``, counties): sorted county codes of each area or state."""
    return crosswalk.where(F.col(column).isNotNull()).groupBy(column).agg(F.array_sort(F.collect_set("county_fips")).alias("counties"))


def region_centrals(graph: RoadGraph, assignment: DataFrame, regions: DataFrame, method: str = "centroid") -> DataFrame:
    """(region_idx, central): the node nearest to the mean of the ring's vertices (as listed), or of the highest out-degree; lowest id of equals."""
    own = assignment.where("region_idx is not null").join(by_shuffle(graph.nodes), "node_id")
    if method == "degree":
        own = own.join(graph.out_degree().where("degree > 0"), "node_id")
        return own.groupBy("region_idx").agg(F.min_by("node_id", F.struct(-F.col("degree"), "node_id")).alias("central"))
    mean = lambda f: F.aggregate("boundary", F.lit(0.0), lambda a, v: a + v[f]) / F.size("boundary")
    mid = regions.select("region_idx", mean("lat").alias("mlat"), mean("lon").alias("mlon"))
    d = haversine("mlat", "mlon", "lat", "lon")
    return own.join(mid, "region_idx").groupBy("region_idx").agg(F.min_by("node_id", F.struct(d, "node_id")).alias("central"))


def centrals_by_score(assignment: DataFrame, scores: DataFrame) -> DataFrame:
    """(region_idx, central): the node of the highest score (node_id, score) in each region, lowest id of equals."""
    own = assignment.where("region_idx is not null").join(scores.select("node_id", "score"), "node_id")
    return own.groupBy("region_idx").agg(F.min_by("node_id", F.struct(-F.col("score"), "node_id")).alias("central"))


def reduced_graph(graph: RoadGraph, assignment: DataFrame, regions: DataFrame, centrals: DataFrame | None = None) -> RoadGraph:
    """Central and border nodes; central to border both ways at the shortest distance from the central, and border crossings as they are."""
    centrals = centrals if centrals is not None else region_centrals(graph, assignment, regions)
    cross = with_regions(graph, assignment).where("ra <> rb")
    border = cross.select(F.col("src").alias("node_id"), F.col("ra").alias("region_idx")).union(cross.select("dst", "rb")).distinct()
    d = materialize(shortest_paths(graph, centrals.select(F.col("central").alias("source"))), "dist")  # its true size decides on the joins
    spoke = border.join(centrals, "region_idx").join(d, (d.source == F.col("central")) & (d.node_id == border.node_id)).where(border.node_id != F.col("central")).select(F.col("central").alias("src"), border.node_id.alias("dst"), F.col("dist").alias("weight"))
    e = spoke.union(spoke.select("dst", "src", "weight")).union(cross.select("src", "dst", "weight"))
    nodes = centrals.select(F.col("central").alias("node_id"), "region_idx", F.lit(True).alias("is_central")).union(border.join(centrals.select(F.col("central").alias("node_id")), "node_id", "left_anti").select("node_id", "region_idx", F.lit(False)))
    return RoadGraph.from_edges(e, nodes)


def adjacent_regions(regions: DataFrame) -> DataFrame:
    """(region_a, region_b) of regions whose rings touch: they share a vertex or cross edges; pairs come from shared grid cells."""
    cell = lambda x: F.floor(x / CELL)
    seg = regions.select("region_idx", F.posexplode("boundary").alias("i", "p"), "boundary").select("region_idx", "p", F.expr("element_at(boundary, (i + 1) % size(boundary) + 1)").alias("q"))
    seg = seg.select("region_idx", F.col("p.lat").alias("ay"), F.col("p.lon").alias("ax"), F.col("q.lat").alias("by"), F.col("q.lon").alias("bx"))
    box = seg.withColumn("ci", F.explode(F.sequence(cell(F.least("ay", "by")), cell(F.greatest("ay", "by"))))).withColumn("cj", F.explode(F.sequence(cell(F.least("ax", "bx")), cell(F.greatest("ax", "bx")))))
    o = box.select(*[F.col(c).alias(c if c in ("ci", "cj") else f"o_{c}") for c in box.columns])
    turn = lambda a, b, c: F.signum((F.col(f"{b}x") - F.col(f"{a}x")) * (F.col(f"{c}y") - F.col(f"{a}y")) - (F.col(f"{b}y") - F.col(f"{a}y")) * (F.col(f"{c}x") - F.col(f"{a}x")))
    meets = (turn("a", "b", "o_a") * turn("a", "b", "o_b") <= 0) & (turn("o_a", "o_b", "a") * turn("o_a", "o_b", "b") <= 0)
    overlap = (F.least("ax", "bx") <= F.greatest("o_ax", "o_bx")) & (F.least("o_ax", "o_bx") <= F.greatest("ax", "bx")) & (F.least("ay", "by") <= F.greatest("o_ay", "o_by")) & (F.least("o_ay", "o_by") <= F.greatest("ay", "by"))
    return box.join(o, ["ci", "cj"]).where("region_idx < o_region_idx").where(meets & overlap).select(F.col("region_idx").alias("region_a"), F.col("o_region_idx").alias("region_b")).distinct()


def hilbert_order(graph: RoadGraph) -> DataFrame:
    """(node_id, hilbert, new_id): nodes in the order of a Hilbert curve over their bounding box, ties by id."""
    from spanweave.functions.geo import HILBERT_ORDER, hilbert_index

    n = graph.nodes.where("lat is not null and lon is not null")
    b = n.agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("c"), F.max("lon").alias("d"))
    span = lambda lo, hi: F.when(F.col(hi) - F.col(lo) < 1e-12, 1.0).otherwise(F.col(hi) - F.col(lo))
    top = (1 << HILBERT_ORDER) - 1
    place = lambda v, lo, hi: F.floor((F.col(v) - F.col(lo)) / span(lo, hi) * top)
    h = n.join(F.broadcast(b)).select("node_id", hilbert_index(place("lon", "c", "d"), place("lat", "a", "b")).alias("hilbert"))
    return h.withColumn("new_id", (F.row_number().over(Window.orderBy("hilbert", "node_id")) - 1).cast("long"))
