"""Registered queries of the road operators: name -> (spark, sf_dir) -> DataFrame.  Doubles are rounded to six places."""

from __future__ import annotations



from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanweave.functions import geo, overlays
from spanweave.graph import RoadGraph
from spanweave.operators import centrality, fragility, paths, regions, sampling, snapping, topology
from spanweave.plans import derived as d
from spanweave.shared import materialize
from spanweave.sources import loaders, sinks

QUERIES: dict = {}
SMALL_RING = [(34.995, -83.005), (34.995, -82.895), (35.075, -82.895), (35.075, -83.005)]


def query(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(f(spark, sf_dir))

    QUERIES[f.__name__] = run
    return f


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, counts to long."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


def grid(spark, sf) -> RoadGraph:
    return d.part_grid(spark, sf)


def assigned(spark, sf):
    g = grid(spark, sf)
    return g, regions.assign_regions(g.nodes, d.strips(spark, sf))


def trips(spark, sf) -> DataFrame:
    return d.sql(spark, sf, d.TRIPS)


def pairs(spark, sf) -> DataFrame:
    return d.sql(spark, sf, d.PAIRS)


def points(spark, sf) -> DataFrame:
    return d.sql(spark, sf, d.POINTS)


# ---- sources --------------------------------------------------------------------------------------------------------------


@query
def s1_csv_lines(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    head = spark.createDataFrame([(-1, "source, target,weight")], "seq long, line string")
    lines = o.select(F.col("o_orderkey").alias("seq"), F.concat_ws(",", (F.col("o_custkey") % 50).cast("string"), F.concat(F.lit(" "), (F.col("o_orderkey") % 37 + 100).cast("string")), (F.col("o_orderkey") % 9 + 1).cast("string")).alias("line"))
    g = loaders.edges_from_lines(head.union(lines))
    return g.edges.groupBy("src", "dst").agg(F.count("*").alias("copies"), F.sum("weight").alias("total"))


@query
def s2_edge_list(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    e = li.select(F.col("l_partkey").cast("long").alias("src"), (F.col("l_suppkey") + 1_000_000_000).cast("long").alias("dst"), F.col("l_quantity").cast("double").alias("weight"))
    nodes = e.select(F.col("src").alias("node_id")).union(e.select("dst")).distinct()
    return RoadGraph(nodes, e).out_degree()


@query
def s3_arrays(spark, sf):
    g = grid(spark, sf)
    rows = g.edges.groupBy(F.col("src").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("dst", "weight"))).alias("x")).select("node_id", F.col("x.dst").alias("targets"), F.col("x.weight").alias("weights"))
    return loaders.rows_to_edges(rows).edges


def osm_tables(spark, sf):
    n = grid(spark, sf).nodes
    ways = n.groupBy(F.floor(F.col("node_id") / 50).alias("way_id")).agg(F.array_sort(F.collect_list("node_id")).alias("nodes"))
    kinds = F.array(*[F.lit(x) for x in ("motorway", "residential", "footway", "tertiary")])
    ways = ways.withColumn("highway", F.element_at(kinds, (F.col("way_id") % 4 + 1).cast("int"))).withColumn("oneway", F.when(F.col("way_id") % 3 == 0, "yes")).withColumn("name", F.concat(F.lit("way "), F.col("way_id").cast("string")))
    return n.select(F.col("node_id").alias("id"), "lat", "lon"), ways


@query
def s4_osm_extract(spark, sf):
    return loaders.from_osm_tables(*osm_tables(spark, sf)).edges.select("src", "dst", "weight")


@query
def s5_osm_extract_tags(spark, sf):
    return loaders.from_osm_tables(*osm_tables(spark, sf), keep_tags=True).edges.groupBy("highway", "name").agg(F.count("*").alias("edges"), F.sum("weight").alias("seconds"))


@query
def s6_speed_profile(spark, sf):
    e = grid(spark, sf).edges
    return e.groupBy("label").agg(F.count("*").alias("edges"), F.max(overlays.lookup(F.col("label"), overlays.SPEED_CAR)).alias("kmh"))


@query
def s7_geojson_regions(spark, sf):
    f = d.strips(spark, sf).select(F.struct(F.lit("Feature").alias("type"), F.struct(F.col("region_id").alias("GEOID"), F.col("label").alias("NAMELSAD")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(F.transform("boundary", lambda v: F.array(v["lon"], v["lat"]))).alias("coordinates")).alias("geometry")).alias("f"))
    text = f.groupBy().agg(F.to_json(F.struct(F.array_sort(F.collect_list("f"), lambda a, b: F.when(a["properties"]["GEOID"] < b["properties"]["GEOID"], -1).otherwise(1)).alias("features"))).alias("text")).select(F.lit("f").alias("file"), "text")
    r = loaders.regions_from_text(text, *loaders.TIGER["county"])
    return r.select("region_idx", "region_id", "label", F.size("boundary").alias("vertices"), F.get("boundary", F.lit(0))["lon"].alias("west"), F.get("boundary", F.lit(1))["lon"].alias("east"))


@query
def s10_elevation(spark, sf):
    g = grid(spark, sf)
    e = g.nodes.where("node_id % 3 = 0").select("node_id", (F.col("elevation") * 2).alias("elevation"))
    return RoadGraph(g.nodes.drop("elevation"), g.edges).with_elevation(e).nodes.select("node_id", "elevation")


@query
def s16_grid(spark, sf):
    return loaders.grid_graph(spark, 20, 30).edges


@query
def s17_random(spark, sf):
    return loaders.random_graph(spark, 300, 500).edges


@query
def s18_tree(spark, sf):
    return loaders.tree_graph(spark, 200, 10).edges


# ---- sinks ----------------------------------------------------------------------------------------------------------------


@query
def k1_fragility_rows(spark, sf):
    g, od = grid(spark, sf), pairs(spark, sf)
    return sinks.fragility_rows(fragility.route_fragility(g, od, worst=True), od)


@query
def k4_fragility_json(spark, sf):
    g, od = grid(spark, sf), pairs(spark, sf)
    return sinks.fragility_json(fragility.route_fragility(g, od, worst=True), od)


@query
def k5_path_geojson(spark, sf):
    g, od = grid(spark, sf), pairs(spark, sf)
    return sinks.path_geojson(paths.paths(g, od), g.nodes, ("dist",))


@query
def k10_state_ranking(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("code"), F.col("c_acctbal").cast("double").alias("value"))
    return fragility.state_ranking(c, "code", "value")


# ---- column expressions ---------------------------------------------------------------------------------------------------


@query
def f1_haversine(spark, sf):
    return grid(spark, sf).nodes.select("node_id", geo.haversine("lat", "lon", *d.CENTRE).alias("metres"))


@query
def f2_point_in_polygon(spark, sf):
    triangle = [(35.0049, -82.9951), (35.0049, -82.5951), (35.4049, -82.9951)]
    return grid(spark, sf).nodes.select("node_id", geo.point_in_polygon("lat", "lon", geo.ring(triangle)).alias("inside"))


@query
def f3_project_to_segment(spark, sf):
    p = geo.project_to_segment("lat", "lon", 35.0, -83.0, 35.03, -82.6)
    return points(spark, sf).select("point_id", p["lat"].alias("p_lat"), p["lon"].alias("p_lon"), p["t"].alias("t"), p["distance_m"].alias("distance_m"))


@query
def f4_bearing(spark, sf):
    return grid(spark, sf).nodes.select("node_id", geo.bearing(*d.CENTRE, "lat", "lon").alias("bearing"))


@query
def f5_circle(spark, sf):
    r = geo.circle(*d.CENTRE, 5000.0)
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(r)], "i long, lat double, lon double")


@query
def f6_hilbert(spark, sf):
    return regions.hilbert_order(grid(spark, sf))


@query
def f7_reorder(spark, sf):
    g = grid(spark, sf)
    m = g.nodes.select("node_id", (F.lit(10_000_000) - F.col("node_id")).alias("new_id"))
    return g.reorder(m).edges.select("edge_id", "src", "dst", "weight")


@query
def f8_category(spark, sf):
    return grid(spark, sf).edges.select("edge_id", overlays.category(F.col("label"), {"motorway": 0, "trunk": 1}).alias("rank"))


@query
def f9_road_ranks(spark, sf):
    return grid(spark, sf).edges.groupBy("label").agg(F.max(overlays.category(F.col("label"))).alias("rank"))


@query
def f10_category_filter(spark, sf):
    r = F.when(F.col("edge_id") % 10 > 0, overlays.category(F.col("label")))
    return grid(spark, sf).edges.where(overlays.category_at_most(r, 2)).select("edge_id")


@query
def f11_subgraph(spark, sf):
    return grid(spark, sf).subgraph(d.HAZARD).edges.select("edge_id", "src", "dst", "weight")


@query
def f12_edges_in_polygon(spark, sf):
    return grid(spark, sf).edges_in_polygon(d.HAZARD)


@query
def f13_filter_edges(spark, sf):
    return grid(spark, sf).filter_edges(F.col("weight") <= 3).nodes.select("node_id")


@query
def f14_level_prune(spark, sf):
    g = grid(spark, sf)
    return topology.prune_by_level(g, g.nodes.select("node_id", ((F.col("node_id") * 7919) % 1009).alias("node_level")), 0.4).edges.select("edge_id")


@query
def f15_edge_elevation(spark, sf):
    g = grid(spark, sf)
    n = g.nodes.select("node_id", F.when(F.col("node_id") % 3 > 0, F.col("elevation")).alias("e"))
    j = g.edges.join(n.select(F.col("node_id").alias("src"), F.col("e").alias("a")), "src").join(n.select(F.col("node_id").alias("dst"), F.col("e").alias("b")), "dst")
    return j.select("edge_id", overlays.edge_max_elevation(F.col("a"), F.col("b")).alias("elevation"))


def risk_tiers(spark, sf):
    g = grid(spark, sf)
    n = g.nodes.select("node_id", F.when(F.col("node_id") % 11 > 0, F.col("elevation")).alias("e"))
    j = g.edges.join(n.select(F.col("node_id").alias("src"), F.col("e").alias("a")), "src").join(n.select(F.col("node_id").alias("dst"), F.col("e").alias("b")), "dst")
    return j.select("edge_id", overlays.closure_risk(overlays.edge_max_elevation(F.col("a"), F.col("b")), F.col("label")).alias("tier"))


@query
def f16_closure_risk(spark, sf):
    return risk_tiers(spark, sf)


@query
def f17_tier_fractions(spark, sf):
    t = risk_tiers(spark, sf)
    return t.groupBy("tier").agg(F.count("*").alias("n")).withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).select("tier", "fraction")


@query
def f18_seasonal_multiplier(spark, sf):
    return risk_tiers(spark, sf).select("edge_id", overlays.seasonal_multiplier(F.col("tier")).alias("factor"))


def confident(spark, sf):
    k = F.col("edge_id")
    e = grid(spark, sf).edges
    return e.select("edge_id", overlays.osm_confidence(F.col("label"), F.when(k % 2 == 0, "n"), F.when(k % 3 == 0, "s").otherwise(""), F.when(k % 5 == 0, "2"), F.when(k % 7 == 0, "50")).alias("score"))


@query
def f19_osm_confidence(spark, sf):
    return confident(spark, sf)


@query
def f20_confidence_multiplier(spark, sf):
    c = confident(spark, sf).where("edge_id % 4 > 0").withColumnRenamed("score", "confidence")
    return grid(spark, sf).with_confidence(c).edges.select("edge_id", overlays.confidence_multiplier(F.col("confidence")).alias("factor"))


@query
def f21_out_degree(spark, sf):
    return grid(spark, sf).out_degree()


@query
def f22_region_accessors(spark, sf):
    _, a = assigned(spark, sf)
    return a.join(d.strips(spark, sf).select("region_idx", "region_id", "label"), "region_idx", "left").select("node_id", "region_id", "label", F.substring("region_id", 1, 2).alias("state"))


# ---- joins and aggregations -----------------------------------------------------------------------------------------------


@query
def j1_assign_regions(spark, sf):
    return assigned(spark, sf)[1]


@query
def j2_boundary_nodes(spark, sf):
    return regions.boundary_nodes(*assigned(spark, sf))


@query
def j4_entry_points(spark, sf):
    g = grid(spark, sf)
    return regions.entry_points(g, g.subgraph(d.HAZARD).nodes)


@query
def j5_border_nodes(spark, sf):
    g, a = assigned(spark, sf)
    c = regions.with_regions(g, a).where("ra <> rb")
    return c.select(F.col("src").alias("node_id"), F.col("ra").alias("region_idx")).union(c.select("dst", "rb")).distinct()


@query
def j6_nearest_node(spark, sf):
    return snapping.nearest_node(points(spark, sf), grid(spark, sf).nodes)


@query
def j7_nearest_edges(spark, sf):
    return snapping.nearest_edges(points(spark, sf), grid(spark, sf), 4, 1200.0).groupBy("point_id", "rank").agg(F.max("distance_m").alias("distance_m"))


@query
def j8_snap(spark, sf):
    return snapping.snap(points(spark, sf), grid(spark, sf)).select("point_id", "snap_m", F.col("src").isNotNull().alias("snapped"))


@query
def j10_fips_crosswalk(spark, sf):
    r = d.strips(spark, sf)
    areas = spark.createDataFrame([(0, "C1", "West")], "region_idx int, region_id string, label string").withColumn("boundary", geo.ring([(34.0, -84.0), (34.0, -82.8), (61.0, -82.8), (61.0, -84.0)]))
    return regions.fips_crosswalk(r, areas)


@query
def j11_counties_in_state(spark, sf):
    return regions.counties_in(regions.fips_crosswalk(d.strips(spark, sf)), "state_fips").select("state_fips", F.array_join("counties", ",").alias("counties"))


@query
def j12_adjacent_regions(spark, sf):
    return regions.adjacent_regions(d.strips(spark, sf))


@query
def a1_border_edges(spark, sf):
    return regions.border_edges(*d.nation_trade(spark, sf))


@query
def a1_border_totals(spark, sf):
    return regions.border_totals(*assigned(spark, sf))


@query
def a2_coarsen(spark, sf):
    return regions.coarsen(*assigned(spark, sf), d.strips(spark, sf)).nodes


@query
def a2_coarsen_edges(spark, sf):
    return regions.coarsen(*assigned(spark, sf), d.strips(spark, sf), 2).edges.select("src", "dst", "weight")


@query
def a3_region_counts(spark, sf):
    return regions.region_counts(assigned(spark, sf)[1], d.strips(spark, sf))


@query
def a4_snap_quality(spark, sf):
    return snapping.snap_quality(snapping.snap(points(spark, sf), grid(spark, sf)))


def quantity_curve(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    return li.groupBy((F.col("l_suppkey") % 20).alias("run"), (F.col("l_linenumber") % 7).cast("int").alias("k")).agg((F.avg("l_quantity").cast("double") / 50 + F.col("k") * 0.05).alias("value"))


@query
def a5_level_stats(spark, sf):
    return fragility.level_stats(quantity_curve(spark, sf))


@query
def a8_curve_metrics(spark, sf):
    return fragility.curve_metrics(quantity_curve(spark, sf).select("run", "k", F.col("value").alias("mean")), ["run"], critical=0.6, jump=0.05)


@query
def a9_hhi(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return fragility.hhi(o.groupBy(F.col("o_orderpriority").alias("g"), (F.col("o_custkey") % 10).alias("b")).agg(F.sum("o_totalprice").cast("double").alias("v")), ["g"], "v")


# ---- shortest paths -------------------------------------------------------------------------------------------------------


def sources(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "source long")


@query
def g1_sssp(spark, sf):
    return paths.shortest_paths(grid(spark, sf), sources(spark, 0)).select("source", "node_id", "dist")


@query
def g1_sssp_by_joins(spark, sf):
    g, _ = d.nation_trade(spark, sf)
    return paths.shortest_paths_by_joins(g, sources(spark, 0, 7))


@query
def g2_distances(spark, sf):
    return paths.distances(grid(spark, sf), trips(spark, sf))


@query
def g3_paths(spark, sf):
    return paths.paths(grid(spark, sf), trips(spark, sf)).select("od_id", "dist", F.get("path", F.lit(0)).alias("first"), F.try_element_at("path", F.lit(-1)).alias("last"))


@query
def g8_distance_matrix(spark, sf):
    """From the place of every supplier to the place of every nation."""
    t = trips(spark, sf)
    n = grid(spark, sf).nodes.select("node_id")
    hubs = spark.read.parquet(f"{sf}/nation.parquet").select((F.col("n_nationkey").cast("long") * 5 + 1).alias("node_id"))
    return paths.distance_matrix(grid(spark, sf), n.join(t, n.node_id == t.src, "left_semi"), n.join(hubs, "node_id", "left_semi"))


@query
def g9_snapped_distance(spark, sf):
    """A trip of every supplier between places on two edges."""
    g = grid(spark, sf)
    e = g.edges.select("edge_id", "src", "dst", "weight")
    t = trips(spark, sf)
    one = e.groupBy("src").agg(F.min(F.struct("dst", "weight")).alias("e"))
    end = lambda p, at, share: t.join(one, t[at] == one.src).select("od_id", F.col("e.dst").alias(f"{p}_dst"), one.src.alias(f"{p}_src"), F.col("e.weight").alias(f"{p}_weight"), F.lit(share).alias(f"{p}_t"))
    return paths.distances_snapped(g, end("a", "src", 0.25).join(end("b", "dst", 0.6), "od_id"))


@query
def g11_blocked_distance(spark, sf):
    g = grid(spark, sf)
    return paths.distances_blocked(g, trips(spark, sf), g.edges.where("src % 7 = 0").select("src", "dst"))


@query
def g15_landmarks(spark, sf):
    return paths.landmarks(grid(spark, sf), 4)


@query
def g16_alt_bound(spark, sf):
    g = grid(spark, sf)
    s = paths.shortest_paths(g, sources(spark, 0, 60)).select(F.col("source").alias("landmark"), "node_id", F.col("dist").alias("d_from"), F.col("dist").alias("d_to"))
    return paths.alt_bound(trips(spark, sf), s)


@query
def g19_alternative_routes(spark, sf):
    return paths.alternative_routes(grid(spark, sf), pairs(spark, sf)).select("od_id", "rank", "dist", "sharing", "stretch")


@query
def r13_shortest_path_edges(spark, sf):
    g = grid(spark, sf)
    return paths.shortest_path_edges(g, paths.shortest_paths(g, sources(spark, 0))).select("source", "edge_id")


# ---- topology -------------------------------------------------------------------------------------------------------------


def chains(spark, sf) -> RoadGraph:
    """The grid without vertical edges but in a few columns."""
    g = grid(spark, sf)
    keep = (F.abs(F.col("src") - F.col("dst")) == 1) | (F.col("src") % 50).isin(0, 10, 20, 30, 40, 49)
    return RoadGraph(g.nodes, g.edges.where(keep))


def comb(spark, sf) -> RoadGraph:
    """Rows of the grid that only the first column holds together: every edge along a row is a bridge."""
    g = grid(spark, sf)
    return RoadGraph(g.nodes, g.edges.where((F.abs(F.col("src") - F.col("dst")) == 1) | (F.col("src") % 50 == 0) & (F.col("dst") % 50 == 0)))


@query
def p1_bridges(spark, sf):
    return topology.bridges(comb(spark, sf))


@query
def p2_bridge_costs(spark, sf):
    g = comb(spark, sf)
    return topology.bridge_costs(g, topology.bridges(g))


@query
def p3_classify_bridges(spark, sf):
    g = grid(spark, sf)
    return topology.classify_bridges(g, (F.abs(F.col("src") - F.col("dst")) == 1) | (F.col("src") % 50 == 0))


@query
def p4_degree2(spark, sf):
    return topology.contract_degree2(chains(spark, sf)).edges.select("src", "dst", "weight")


@query
def p5_simplify(spark, sf):
    return topology.simplify(chains(spark, sf), F.col("weight") < 10, keep=0.8)[1]


@query
def p6_degradation(spark, sf):
    g = chains(spark, sf)
    return topology.degradation(g, topology.contract_degree2(g), 100)


@query
def p7_reduced_graph(spark, sf):
    g, a = assigned(spark, sf)
    c = spark.createDataFrame([(0, 55), (1, 68), (2, 80), (3, 90)], "region_idx int, central long")
    return regions.reduced_graph(g, a, d.strips(spark, sf), c).edges.groupBy("src", "dst").agg(F.min("weight").alias("weight"))


@query
def p9_components(spark, sf):
    g = grid(spark, sf)
    return topology.components(RoadGraph(g.nodes, g.edges.where("src % 3 > 0 and dst % 3 > 0")))


@query
def p10_centrals_by_degree(spark, sf):
    g, a = assigned(spark, sf)
    return regions.centrals_by_score(a, g.out_degree().select("node_id", F.col("degree").cast("double").alias("score")))


# ---- replacement paths and measures ---------------------------------------------------------------------------------------


@query
def r1_route_fragility(spark, sf):
    return fragility.route_fragility(grid(spark, sf), pairs(spark, sf), "exact")


@query
def r3_bottleneck(spark, sf):
    return fragility.bottleneck(fragility.route_fragility(grid(spark, sf), pairs(spark, sf), worst=True))


@query
def r4_interval_replacement(spark, sf):
    return fragility.route_fragility(grid(spark, sf), pairs(spark, sf))


@query
def r5_approximate_replacement(spark, sf):
    return fragility.route_fragility(grid(spark, sf), pairs(spark, sf), "approx")


@query
def r6_filtered_fragility(spark, sf):
    g = grid(spark, sf)
    return fragility.filtered_route_fragility(g, pairs(spark, sf), topology.node_levels(g), paths.landmarks(g, 4))


@query
def r7_accessibility(spark, sf):
    g = grid(spark, sf)
    return fragility.accessibility(g, g.subgraph(d.HAZARD))


@query
def r8_area_index(spark, sf):
    return fragility.area_index(fragility.area_scores(grid(spark, sf), SMALL_RING, od=30))


@query
def r10_scenario(spark, sf):
    return fragility.scenario(grid(spark, sf), SMALL_RING, d.HAZARD, od=20)


LOCATION = fragility.LocationConfig(radius_m=9000.0, runs=6, samples=60)


@query
def r11_location_fragility(spark, sf):
    return fragility.level_stats(fragility.location_fragility(grid(spark, sf), *d.CENTRE, LOCATION))


@query
def r12_isolation_score(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    rows = o.select((F.col("o_custkey") % 5).alias("run"), (F.col("o_orderkey") % 8).alias("sector"), F.when(F.col("o_orderkey") % 13 > 0, (F.col("o_orderkey") % 50 + 1).cast("double")).alias("full"), F.when((F.col("o_orderkey") % 4 > 0) & (F.col("o_orderkey") % 8 != F.col("o_custkey") % 5), (F.col("o_orderkey") % 90 + 10).cast("double")).alias("blocked"))
    return fragility.isolation_score(rows, ["run"])


@query
def r14_tiled(spark, sf):
    t = fragility.tiled(grid(spark, sf), 34.99, 35.08, -83.0, -82.6, 9000.0, fragility.LocationConfig(radius_m=4000.0, runs=3, samples=30))
    return t


@query
def r16_progressive_mc(spark, sf):
    return fragility.level_stats(fragility.progressive(grid(spark, sf), SMALL_RING, fragility.ProgressiveConfig(k_max=4, runs=8)))


@query
def r17_progressive_betweenness(spark, sf):
    return fragility.progressive(grid(spark, sf), SMALL_RING, fragility.ProgressiveConfig("betweenness", k_max=4))


@query
def r18_progressive_fragility(spark, sf):
    return fragility.progressive(grid(spark, sf), SMALL_RING, fragility.ProgressiveConfig("fragility", k_max=2))


@query
def r19_composite_score(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    rows = o.select((F.col("o_custkey") % 6).alias("run"), (F.col("o_orderkey") % 40 + 1).cast("double").alias("primary"), F.when(F.col("o_orderkey") % (F.col("o_custkey") % 6 + 2) > 0, (F.col("o_orderkey") % 40 + 1 + F.col("o_custkey") % 9).cast("double")).alias("dist"))
    return fragility.composite_score(rows, ["run"])


@query
def r21_inter_region(spark, sf):
    g, a = assigned(spark, sf)
    red = regions.reduced_graph(g, a, d.strips(spark, sf))
    red = RoadGraph(materialize(red.nodes, "reduced_nodes"), materialize(red.edges, "reduced_edges"))
    return fragility.inter_region_summary(fragility.inter_region(red, 4, 3))


@query
def r22_weight_sensitivity(spark, sf):
    c = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("area"), *[((F.col("n_nationkey") * k) % 11 / 10.0).cast("double").alias(n) for n, k in zip(fragility.AREA_WEIGHTS, (3, 5, 7, 2), strict=True)])
    return fragility.weight_sensitivity(c, fragility.AREA_WEIGHTS)


@query
def r23_ensemble(spark, sf):
    return fragility.ensemble_stats(fragility.ensemble(grid(spark, sf), SMALL_RING, 5, od=10))


@query
def r24_regional_isolation(spark, sf):
    return fragility.regional_isolation(*assigned(spark, sf), fragility.LocationConfig(runs=4, samples=60))


@query
def c1_edge_betweenness(spark, sf):
    return centrality.betweenness(grid(spark, sf))[0]


@query
def c1_node_betweenness(spark, sf):
    return centrality.betweenness(grid(spark, sf))[1]


@query
def c2_adjacency(spark, sf):
    return centrality.adjacency(d.nation_trade(spark, sf)[0])


@query
def c2_laplacian(spark, sf):
    return centrality.laplacian(d.nation_trade(spark, sf)[0])


@query
def c3_spectral(spark, sf):
    return centrality.spectral(d.nation_trade(spark, sf)[0])


@query
def m1_uniform_edges(spark, sf):
    return sampling.sample_edges(grid(spark, sf), 50)


@query
def m2_stratified_edges(spark, sf):
    return sampling.sample_edges(grid(spark, sf), 70, "stratified").groupBy("label").count()


@query
def m3_importance_edges(spark, sf):
    return sampling.sample_edges(grid(spark, sf), 50, "importance")


@query
def m4_spatial_edges(spark, sf):
    return sampling.sample_edges(grid(spark, sf), 50, "spatial")


@query
def m5_dispersed_edges(spark, sf):
    return sampling.sample_edges(grid(spark, sf), 20, "dispersed")


@query
def m6_midpoints(spark, sf):
    return sampling.midpoints(grid(spark, sf))


@query
def m7_stratified_od(spark, sf):
    return sampling.sample_od(grid(spark, sf), 60, pilot=100)



