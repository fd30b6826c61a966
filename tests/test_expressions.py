"""Golden values of column expressions, sources and sinks."""

import json
import math
import struct

import pytest
from pyspark.sql import functions as F

from spanweave.functions import geo, overlays
from spanweave.graph import RoadGraph
from spanweave.operators import regions, snapping
from spanweave.sources import loaders, sinks


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def test_distances_and_bearings(spark):
    assert abs(one(spark, geo.haversine(40.7128, -74.006, 51.5074, -0.1278)) / 5_570_000 - 1) < 0.02
    assert abs(one(spark, geo.haversine(35.0, -83.0, 36.0, -83.0)) / 111_000 - 1) < 0.01
    assert abs(one(spark, geo.bearing(0.0, 0.0, 0.0, 1.0)) - math.pi / 2) < 1e-12 and abs(one(spark, geo.bearing(0.0, 0.0, -1.0, 0.0)) - math.pi) < 1e-12
    p = one(spark, geo.project_to_segment(0.0, 2.0, 0.0, 0.0, 0.0, 1.0))
    assert p.t == 1.0 and p.lon == 1.0
    assert one(spark, geo.project_to_segment(1.0, 1.0, 0.0, 0.0, 0.0, 0.0)).t == 0.0
    assert len(geo.circle(35, -83, 100)) == 9


def test_polygons(spark):
    square = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)]
    for ring in (square, [*square, square[0]]):
        assert one(spark, geo.point_in_polygon(0.5, 0.5, geo.ring(ring))) and not one(spark, geo.point_in_polygon(0.5, 1.5, geo.ring(ring)))
    assert not one(spark, geo.point_in_polygon(0.5, 0.5, geo.ring(square[:2])))
    notch = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (2.0, 2.0)]
    assert not one(spark, geo.point_in_polygon(2.0, 1.0, geo.ring(notch))) and one(spark, geo.point_in_polygon(1.0, 1.5, geo.ring(notch)))


def test_hilbert_visits_every_cell_by_neighbours(spark):
    n = 8
    rows = spark.range(n * n).select((F.col("id") % n).alias("x"), F.floor(F.col("id") / n).alias("y"), geo.hilbert_index(F.col("id") % n, F.floor(F.col("id") / n), 3).alias("h")).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(n * n))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) == 1 for a, b in zip(rows, rows[1:]))


def test_overlays(spark):
    tier = lambda z, label: one(spark, overlays.closure_risk(F.lit(z).cast("double"), F.lit(label).cast("string")))
    assert [tier(800, "unclassified"), tier(1300, "unclassified"), tier(1600, "unclassified")] == [0, 2, 3]
    assert tier(1600, "motorway") == 1 and tier(None, "service") == 1 and tier(None, "motorway") == 0 and tier(None, "") == 1 and tier(1600, None) == 3
    assert [one(spark, overlays.seasonal_multiplier(F.lit(t))) for t in range(4)] == [1.0, 1.0, 1.5, 3.0]
    c = overlays.osm_confidence(F.lit("primary"), F.lit("A"), F.lit(""), F.lit(None).cast("string"), F.lit("50"))
    assert abs(one(spark, c) - 0.75) < 1e-12
    assert one(spark, overlays.category(F.lit("footway"))) == 255 and one(spark, overlays.confidence_multiplier(F.lit(None).cast("double"))) == 1.0
    assert one(spark, overlays.edge_max_elevation(F.lit(None).cast("double"), F.lit(3.0))) == 3.0


def test_csv_and_arrays(spark, tmp_path):
    (tmp_path / "g.csv").write_text("weight,target,source\n1.5, 7 ,5\nbad\n2,5,7\n3,9,5\n")
    g = loaders.read_edge_csv(spark, str(tmp_path / "g.csv"))
    assert sorted((r.src, r.dst, r.weight) for r in g.edges.collect()) == [(0, 1, 1.5), (0, 2, 3.0), (1, 0, 2.0)]
    assert loaders.read_edge_csv(spark, str(tmp_path / "g.csv"), bidirectional=True).edges.count() == 6
    with pytest.raises(ValueError):
        loaders.read_edge_csv(spark, str(tmp_path / "g.csv"), src="from")
    (tmp_path / "od.csv").write_text("# pairs\n1,2\n3,4\n")
    assert [(r.src, r.dst) for r in loaders.read_od_csv(spark, str(tmp_path / "od.csv")).orderBy("od_id").collect()] == [(1, 2), (3, 4)]
    g = loaders.from_arrays(spark, [0, 2, 2, 3], [1, 2, 0], [1.0, 2.0, 3.0])
    assert {r.node_id: r.degree for r in g.out_degree().collect()} == {0: 2, 1: 0, 2: 1}
    g.save(str(tmp_path / "saved"))
    assert RoadGraph.load(spark, str(tmp_path / "saved")).edges.count() == 3


def test_geojson(spark, tmp_path):
    ring = [[0, 0], [2, 0], [2, 1], [0, 0]]
    feats = [{"properties": {"GEOID": "1", "NAMELSAD": "A"}, "geometry": {"type": "Polygon", "coordinates": [ring, ring]}}, {"properties": {"GEOID": 7}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [[[5, 5], [6, 5], [6, 6]]]]}}, {"properties": {}, "geometry": {"type": "Point", "coordinates": [1, 2]}}, {"properties": {"GEOID": "x"}, "geometry": {"type": "Polygon", "coordinates": [ring[:2]]}}]
    (tmp_path / "r.json").write_text(json.dumps({"type": "FeatureCollection", "features": feats}))
    got = loaders.read_tiger(spark, str(tmp_path / "r.json")).collect()
    assert [(r.region_idx, r.region_id, r.label, len(r.boundary), r.boundary[1].lon) for r in got] == [(0, "1", "A", 4, 2.0), (1, "7", None, 4, 2.0)]
    assert loaders.regions_from_text(spark.createDataFrame([("f", "{}")], "file string, text string")).count() == 0


def test_elevation_tiles(spark, tmp_path):
    z = [[-32768 if (i, j) == (600, 600) else 10 * i for j in range(1201)] for i in range(1201)]
    (tmp_path / "N35W083.hgt").write_bytes(b"".join(struct.pack(">1201h", *row) for row in z))
    nodes = spark.createDataFrame([(0, 35.75, -82.5), (1, 35.5, -82.5), (2, 10.0, 10.0), (3, None, None)], "node_id long, lat double, lon double")
    got = {r.node_id: r.elevation for r in loaders.srtm_elevation(RoadGraph(nodes, nodes), str(tmp_path)).collect()}
    assert abs(got[0] - 3000) < 1e-6 and got[1] == 6000 and got[2] is None


def test_osm_tables(spark):
    nodes = spark.createDataFrame([(i, 35.0 + i / 100, -83.0) for i in range(4)], "id long, lat double, lon double")
    ways = spark.createDataFrame([(1, [0, 1, 2], "residential", None), (2, [2, 3], "motorway", "no"), (3, [0, 3], "footway", None), (4, [0, 9], "primary", None)], "way_id long, nodes array<long>, highway string, oneway string")
    e = loaders.from_osm_tables(nodes, ways, keep_tags=True).edges.collect()
    assert sorted((r.src, r.dst) for r in e) == [(0, 1), (1, 0), (1, 2), (2, 1), (2, 3)]
    assert abs(next(r.weight for r in e if r.src == 0) - 1111.95 / (30 / 3.6)) < 0.1


def two_regions(spark):
    nodes = spark.createDataFrame([(0, 35.25, -83.75), (1, 35.25, -83.6), (2, 35.25, -83.4), (3, 35.25, -83.25), (4, 0.0, 0.0)], "node_id long, lat double, lon double")
    e = [(0, 1, 10.0), (1, 2, 20.0), (2, 3, 10.0)]
    edges = spark.createDataFrame([x for a, b, w in e for x in ((a, b, w), (b, a, w))], "src long, dst long, weight double")
    box = lambda a, b: [(35.0, a), (35.0, b), (35.5, b), (35.5, a)]
    regs = spark.createDataFrame([(i, f"r{i}", f"R{i}", [{"lat": p, "lon": o} for p, o in box(a, b)]) for i, (a, b) in enumerate([(-84.0, -83.5), (-83.5, -83.0)])], "region_idx int, region_id string, label string, boundary array<struct<lat:double,lon:double>>")
    return RoadGraph.from_edges(edges, nodes), regs


def test_two_regions(spark):
    g, regs = two_regions(spark)
    a = regions.assign_regions(g.nodes, regs)
    assert {r.node_id: r.region_idx for r in a.collect()} == {0: 0, 1: 0, 2: 1, 3: 1, 4: None}
    b = regions.border_edges(g, a).collect()
    assert [(r.edge_count, r.min_weight, r.max_weight, r.total_weight) for r in b] == [(2, 20.0, 20.0, 40.0)]
    assert regions.border_totals(g, a).first().unassigned_edges == 0
    assert {r.node_id for r in regions.boundary_nodes(g, a).collect()} == {1, 2, 4}
    c = regions.coarsen(g, a, regs)
    assert {r.node_id: (r.node_count, r.internal_edges) for r in c.nodes.collect()} == {0: (2, 2), 1: (2, 2)} and c.edges.count() == 2
    red = regions.reduced_graph(g, a, regs, spark.createDataFrame([(0, 0), (1, 3)], "region_idx int, central long"))
    assert sorted((r.src, r.dst, r.weight) for r in red.edges.collect()) == [(0, 1, 10.0), (1, 0, 10.0), (1, 2, 20.0), (2, 1, 20.0), (2, 3, 10.0), (3, 2, 10.0)]


def test_snapping(spark):
    g, _ = two_regions(spark)
    pts = spark.createDataFrame([(1, 35.2501, -83.5), (2, 40.0, -83.5), (3, 35.25, -83.75)], "point_id long, lat double, lon double")
    got = {r.point_id: r for r in snapping.snap(pts, g).collect()}
    assert {got[1].src, got[1].dst} == {1, 2} and abs(got[1].t - 0.5) < 1e-6 and not got[1].exact and got[2].src is None and got[3].exact
    q = snapping.snap_quality(snapping.snap(pts, g)).first()
    assert (q.total, q.snapped, q.failed, q.exact) == (3, 2, 1, 1)
    near = {r.point_id: r.node_id for r in snapping.nearest_node(pts, g.nodes).collect()}
    assert near[3] == 0 and near[2] in (1, 2)


def test_sinks(spark, tmp_path):
    frag = spark.createDataFrame([(0, 0, 1, 2, 3.0, None, None), (0, 1, 2, 3, 3.0, 6.0, 2.0)], "od_id long, pos int, src long, dst long, primary double, replacement double, ratio double")
    od = spark.createDataFrame([(0, 1, 3), (1, 1, 9)], "od_id long, src long, dst long")
    rows = {r.target: r for r in sinks.fragility_rows(frag, od).collect()}
    assert (rows[3].bottleneck_source, rows[3].bottleneck_ratio, rows[9].primary_distance, rows[9].bottleneck_source) == (1, -1.0, -1.0, 0)
    js = {r.od_id: json.loads(r.json) for r in sinks.fragility_json(frag, od).collect()}
    assert js[1] == {"source": 1, "target": 9, "primary_distance": None, "path_edges": 0} and js[0]["bottleneck_ratio"] is None
    sinks.write_fragility(frag, od, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 2
    nodes = spark.createDataFrame([(1, 10.0, 20.0), (2, 11.0, 21.0)], "node_id long, lat double, lon double")
    f = sinks.path_geojson(spark.createDataFrame([(5, [2, 1], 1.5)], "od_id long, path array<long>, dist double"), nodes, ("dist",))
    assert json.loads(f.first().geojson)["geometry"]["coordinates"] == [[21.0, 11.0], [20.0, 10.0]]
    sinks.write_geojson(f, str(tmp_path / "x.json"))
    assert len(json.loads((tmp_path / "x.json").read_text())["features"]) == 1
