"""DuckDB SQL of the road queries, by name."""

from __future__ import annotations

from spanweave.functions.overlays import OSM_RANKS, SPEED_CAR
from spanweave.plans.derived import CENTRE, EDGES, HAZARD, NODES, POINTS, STRIPS, TRADE, WITH, plain, sssp_sql

HAV = "6371000e0 * 2 * atan2(sqrt({s}), sqrt(1 - ({s})))"


def hav(a: str, b: str, c: str, d: str) -> str:
    s = f"pow(sin(radians({c} - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - ({b})) / 2), 2)"
    return HAV.format(s=s)


def case(col: str, values: dict, default: str = "NULL") -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {default} END"


INSIDE = f"lat > {HAZARD[0][0]} AND lat < {HAZARD[2][0]} AND lon > {HAZARD[0][1]} AND lon < {HAZARD[1][1]}"
G = f"WITH RECURSIVE nodes AS ({plain(NODES)}), edges AS ({plain(EDGES)})"
A = WITH
RISK = f"""{G}, t AS (SELECT e.edge_id, e.label, CASE WHEN e.src % 11 = 0 THEN b WHEN e.dst % 11 = 0 THEN a ELSE greatest(a, b) END AS z, e.src % 11 = 0 AND e.dst % 11 = 0 AS unknown FROM edges e
  JOIN (SELECT node_id, elevation AS a FROM nodes) x ON x.node_id = e.src JOIN (SELECT node_id, elevation AS b FROM nodes) y ON y.node_id = e.dst),
tiers AS (SELECT edge_id, CASE WHEN unknown THEN CASE WHEN {case('label', OSM_RANKS, '5')} >= 5 THEN 1 ELSE 0 END WHEN z >= 1500 AND {case('label', OSM_RANKS, '5')} >= 4 THEN 3 WHEN z >= 1200 AND {case('label', OSM_RANKS, '5')} >= 3 THEN 2 WHEN z >= 900 THEN 1 ELSE 0 END AS tier FROM t)"""
CONF = f"""{G}, c AS (SELECT edge_id, least(1e0, 2e-1 + CASE WHEN {case('label', OSM_RANKS, '255')} <= 3 THEN 25e-2 ELSE 0e0 END + CASE WHEN edge_id % 2 = 0 THEN 2e-1 ELSE 0e0 END + CASE WHEN edge_id % 3 = 0 THEN 15e-2 ELSE 0e0 END + CASE WHEN edge_id % 5 = 0 THEN 1e-1 ELSE 0e0 END + CASE WHEN edge_id % 7 = 0 THEN 1e-1 ELSE 0e0 END) AS score FROM edges)"""
BORDER = "SELECT e.*, x.region_idx AS ra, y.region_idx AS rb FROM edges e JOIN assignment x ON x.node_id = e.src JOIN assignment y ON y.node_id = e.dst"
CURVE = "SELECT run, k, q / 50 + k * 5e-2 AS value FROM (SELECT l_suppkey % 20 AS run, l_linenumber % 7 AS k, CAST(avg(l_quantity) AS DOUBLE) AS q FROM lineitem GROUP BY 1, 2)"
OSM = f"""{G}, way AS (SELECT CAST(floor(node_id / 50) AS BIGINT) AS w, node_id, lat, lon, lead(node_id) OVER p AS nxt, lead(lat) OVER p AS lat2, lead(lon) OVER p AS lon2 FROM nodes WINDOW p AS (PARTITION BY CAST(floor(node_id / 50) AS BIGINT) ORDER BY node_id)),
step AS (SELECT w, node_id AS a, nxt AS b, CASE w % 4 WHEN 0 THEN 'motorway' WHEN 1 THEN 'residential' WHEN 3 THEN 'tertiary' END AS highway, {hav('lat', 'lon', 'lat2', 'lon2')} AS m FROM way WHERE nxt IS NOT NULL AND w % 4 <> 2),
osm AS (SELECT w, a AS src, b AS dst, m / (({case('highway', SPEED_CAR)}) / 36e-1) AS weight, highway FROM step UNION ALL SELECT w, b, a, m / (({case('highway', SPEED_CAR)}) / 36e-1), highway FROM step WHERE w % 3 <> 0 AND w % 4 <> 0)"""
SNAPS = f"""{A}, one AS (SELECT src, dst, min(edge_id) AS edge_id FROM edges GROUP BY 1, 2),
e AS (SELECT edge_id, u.lat AS y1, u.lon AS x1, v.lat AS y2, v.lon AS x2, cos(radians(u.lat)) AS k FROM one JOIN nodes u ON u.node_id = src JOIN nodes v ON v.node_id = dst),
f AS (SELECT point_id, edge_id, lat, lon, y1, x1, y2, x2, least(1e0, greatest(0e0, ((lon - x1) * k * ((x2 - x1) * k) + (lat - y1) * (y2 - y1)) / ((x2 - x1) * k * ((x2 - x1) * k) + (y2 - y1) * (y2 - y1)))) AS t FROM points, e),
near AS (SELECT point_id, edge_id, t, {hav('lat', 'lon', 'y1 + t * (y2 - y1)', 'x1 + t * (x2 - x1)')} AS m FROM f),
snaps AS (SELECT p.point_id, m AS snap_m, t FROM points p LEFT JOIN (SELECT point_id, min(m) AS m, arg_min(t, (m, edge_id)) AS t FROM near WHERE m < 500 GROUP BY 1) n ON n.point_id = p.point_id)"""
LA, LO = CENTRE


def at(values: str, a: int, b: int) -> str:
    return f"list_sort(list({values}))[least(count({values}) - 1, count({values}) * {a} // {b}) + 1]"


ORACLE_SQL = {
    "s1_csv_lines": """WITH e AS (SELECT o_orderkey AS seq, o_custkey % 50 AS a, o_orderkey % 37 + 100 AS b, o_orderkey % 9 + 1 AS w FROM orders),
i AS (SELECT id, row_number() OVER (ORDER BY min(s)) - 1 AS node FROM (SELECT a AS id, seq * 2 AS s FROM e UNION ALL SELECT b, seq * 2 + 1 FROM e) GROUP BY id)
SELECT x.node AS src, y.node AS dst, count(*) AS copies, CAST(sum(w) AS DOUBLE) AS total FROM e JOIN i x ON x.id = a JOIN i y ON y.id = b GROUP BY ALL""",
    "s2_edge_list": "SELECT l_partkey AS node_id, count(*) AS degree FROM lineitem GROUP BY 1 UNION ALL SELECT DISTINCT 1000000000 + l_suppkey, 0 FROM lineitem",
    "s3_arrays": f"{G} SELECT edge_id, src, dst, weight FROM edges",
    "s4_osm_extract": f"{OSM} SELECT src, dst, round(weight, 6) AS weight FROM osm",
    "s5_osm_extract_tags": f"{OSM} SELECT highway, 'way ' || w AS name, count(*) AS edges, round(sum(weight), 6) AS seconds FROM osm GROUP BY ALL",
    "s6_speed_profile": f"{G} SELECT label, count(*) AS edges, CAST({case('label', SPEED_CAR)} AS DOUBLE) AS kmh FROM edges GROUP BY label",
    "s7_geojson_regions": "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '3702{i}', 'Strip {i}', 4::BIGINT, {a!r}::DOUBLE, {b!r}::DOUBLE)" for i, (a, b) in enumerate(zip(STRIPS, STRIPS[1:]))) + ") t(region_idx, region_id, label, vertices, west, east)",
    "s10_elevation": f"{G} SELECT node_id, CASE WHEN node_id % 3 = 0 THEN elevation * 2 END AS elevation FROM nodes",
    "s16_grid": "WITH n AS (SELECT range AS i FROM range(600)), u AS (SELECT i AS a, i + 1 AS b FROM n WHERE i % 30 < 29 UNION ALL SELECT i, i + 30 FROM n WHERE i < 570) SELECT row_number() OVER (ORDER BY src, dst) - 1 AS edge_id, src, dst, 1e0 AS weight FROM (SELECT a AS src, b AS dst FROM u UNION ALL SELECT b, a FROM u)",
    "k10_state_ranking": "SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS state, count(*) AS areas, round(avg(CAST(c_acctbal AS DOUBLE)), 6) AS mean, round(quantile_cont(CAST(c_acctbal AS DOUBLE), 0.5), 6) AS median FROM customer GROUP BY 1",
    "f1_haversine": f"{G} SELECT node_id, round({hav('lat', 'lon', str(LA), str(LO))}, 6) AS metres FROM nodes",
    "f2_point_in_polygon": f"{G} SELECT node_id, lat > 350049e-4 AND lon > -829951e-4 AND (lat - 350049e-4) + (lon + 829951e-4) < 4e-1 AS inside FROM nodes",
    "f3_project_to_segment": f"""WITH p AS ({plain(POINTS)}), k AS (SELECT *, (4e-1) * cos(radians(35e0)) AS dx, 3e-2 AS dy FROM p),
t AS (SELECT *, least(1e0, greatest(0e0, ((lon + 83) * cos(radians(35e0)) * dx + (lat - 35) * dy) / (dx * dx + dy * dy))) AS t FROM k)
SELECT point_id, round(35 + t * 3e-2, 6) AS p_lat, round(-83 + t * 4e-1, 6) AS p_lon, round(t, 6) AS t, round({hav('lat', 'lon', '(35 + t * 3e-2)', '(-83 + t * 4e-1)')}, 6) AS distance_m FROM t""",
    "f4_bearing": f"{G}, b AS (SELECT node_id, atan2(sin(radians(lon - ({LO}))) * cos(radians(lat)), cos(radians({LA})) * sin(radians(lat)) - sin(radians({LA})) * cos(radians(lat)) * cos(radians(lon - ({LO})))) AS b FROM nodes) SELECT node_id, round(CASE WHEN b < 0 THEN b + 2 * pi() ELSE b END, 6) AS bearing FROM b",
    "f5_circle": f"SELECT i, round({LA} + 5000 / 111320e0 * cos(2 * pi() * (i % 8) / 8), 6) AS lat, round({LO} + 5000 / (111320e0 * cos(radians({LA}))) * sin(2 * pi() * (i % 8) / 8), 6) AS lon FROM range(9) t(i)",
    "f7_reorder": f"{G} SELECT edge_id, 10000000 - src AS src, 10000000 - dst AS dst, weight FROM edges",
    "f8_category": f"{G} SELECT edge_id, CAST(CASE label WHEN 'motorway' THEN 0 WHEN 'trunk' THEN 1 ELSE 255 END AS BIGINT) AS rank FROM edges",
    "f9_road_ranks": f"{G} SELECT DISTINCT label, CAST({case('label', OSM_RANKS, '255')} AS BIGINT) AS rank FROM edges",
    "f10_category_filter": f"{G} SELECT edge_id FROM edges WHERE edge_id % 10 = 0 OR {case('label', OSM_RANKS, '255')} <= 2",
    "f11_subgraph": f"{G}, i AS (SELECT node_id FROM nodes WHERE {INSIDE}) SELECT edge_id, src, dst, weight FROM edges WHERE src IN (FROM i) AND dst IN (FROM i)",
    "f12_edges_in_polygon": f"{G}, i AS (SELECT node_id FROM nodes WHERE {INSIDE}) SELECT src, dst FROM edges WHERE src IN (FROM i) AND dst IN (FROM i)",
    "f13_filter_edges": f"{G} SELECT src AS node_id FROM edges WHERE weight <= 3 UNION SELECT dst FROM edges WHERE weight <= 3",
    "f14_level_prune": f"{G}, l AS (SELECT node_id, (node_id * 7919) % 1009 AS lv FROM nodes), o AS (SELECT lv, row_number() OVER (ORDER BY lv, node_id) - 1 AS i, count(*) OVER () AS n FROM l), k AS (SELECT node_id FROM l WHERE lv >= (SELECT lv FROM o WHERE i = least(n - 1, CAST(floor((1 - 0.4::DOUBLE) * n) AS BIGINT)))) SELECT edge_id FROM edges WHERE src IN (FROM k) AND dst IN (FROM k)",
    "f15_edge_elevation": f"{G} SELECT edge_id, CASE WHEN src % 3 = 0 AND dst % 3 = 0 THEN NULL WHEN src % 3 = 0 THEN y.elevation WHEN dst % 3 = 0 THEN x.elevation ELSE greatest(x.elevation, y.elevation) END AS elevation FROM edges JOIN nodes x ON x.node_id = src JOIN nodes y ON y.node_id = dst",
    "f16_closure_risk": f"{RISK} SELECT edge_id, CAST(tier AS BIGINT) AS tier FROM tiers",
    "f17_tier_fractions": f"{RISK} SELECT CAST(tier AS BIGINT) AS tier, round(count(*) / (SELECT count(*) FROM tiers), 6) AS fraction FROM tiers GROUP BY 1",
    "f18_seasonal_multiplier": f"{RISK} SELECT edge_id, CAST(CASE tier WHEN 2 THEN 1.5 WHEN 3 THEN 3.0 ELSE 1.0 END AS DOUBLE) AS factor FROM tiers",
    "f19_osm_confidence": f"{CONF} SELECT edge_id, round(score, 6) AS score FROM c",
    "f20_confidence_multiplier": f"{CONF} SELECT edge_id, round(CASE WHEN edge_id % 4 > 0 THEN 2 - score ELSE 1e0 END, 6) AS factor FROM c",
    "f21_out_degree": f"{G} SELECT node_id, count(src) AS degree FROM nodes LEFT JOIN edges ON src = node_id GROUP BY 1",
    "f22_region_accessors": f"{A} SELECT node_id, '3702' || region_idx AS region_id, 'Strip ' || region_idx AS label, CASE WHEN region_idx IS NOT NULL THEN '37' END AS state FROM assignment",
    "j1_assign_regions": f"{A} SELECT node_id, CAST(region_idx AS BIGINT) AS region_idx FROM assignment",
    "j2_boundary_nodes": f"{A}, e AS ({BORDER}), f AS (SELECT src, arg_min(dst, edge_id) AS dst FROM e WHERE ra IS NOT NULL AND (rb IS NULL OR ra <> rb) GROUP BY src) SELECT node_id FROM assignment WHERE region_idx IS NULL UNION SELECT src FROM f UNION SELECT dst FROM f",
    "j4_entry_points": f"{G}, i AS (SELECT node_id FROM nodes WHERE {INSIDE}) SELECT DISTINCT src AS node_id FROM edges WHERE src IN (FROM i) AND dst NOT IN (FROM i)",
    "j5_border_nodes": f"{A}, e AS ({BORDER}) SELECT src AS node_id, CAST(ra AS BIGINT) AS region_idx FROM e WHERE ra <> rb UNION SELECT dst, rb FROM e WHERE ra <> rb",
    "j7_nearest_edges": f"{SNAPS} SELECT point_id, row_number() OVER (PARTITION BY point_id ORDER BY m, edge_id) AS rank, round(m, 6) AS distance_m FROM near WHERE m <= 1200 QUALIFY rank <= 4",
    "j8_snap": f"{SNAPS} SELECT point_id, round(snap_m, 6) AS snap_m, snap_m IS NOT NULL AS snapped FROM snaps",
    "a4_snap_quality": f"""{SNAPS} SELECT count(*) AS total, count(snap_m) AS snapped, count(*) FILTER (snap_m IS NULL) AS failed, count(*) FILTER (t < 1e-2 OR t > 99e-2) AS exact,
  count(*) FILTER (snap_m > 200) AS warned, round(max(snap_m), 6) AS max_m, {', '.join(f"round(list_sort(list(snap_m) FILTER (snap_m IS NOT NULL))[least(count(snap_m) - 1, count(snap_m) * {p} // 100) + 1], 6) AS p{p}" for p in (50, 90, 95, 99))} FROM snaps""",
    "j6_nearest_node": f"{A}, d AS (SELECT point_id, node_id, {hav('p.lat', 'p.lon', 'n.lat', 'n.lon')} AS m FROM points p, nodes n) SELECT point_id, arg_min(node_id, (m, node_id)) AS node_id, round(min(m), 6) AS distance_m FROM d GROUP BY 1",
    "a1_border_edges": f"WITH t AS ({plain(TRADE)}), e AS (SELECT t.*, x.n_regionkey AS ra, y.n_regionkey AS rb FROM t JOIN nation x ON x.n_nationkey = src JOIN nation y ON y.n_nationkey = dst) SELECT CAST(least(ra, rb) AS BIGINT) AS region_a, CAST(greatest(ra, rb) AS BIGINT) AS region_b, count(*) AS edge_count, sum(weight) AS total_weight, min(weight) AS min_weight, max(weight) AS max_weight FROM e WHERE ra <> rb GROUP BY 1, 2",
    "a1_border_totals": f"{A}, e AS ({BORDER}) SELECT count(DISTINCT CASE WHEN ra <> rb THEN least(ra, rb) * 100 + greatest(ra, rb) END) AS connected_pairs, count(*) FILTER (ra <> rb) AS border_edges, count(*) FILTER ((ra IS NULL) <> (rb IS NULL)) AS unassigned_edges FROM e",
    "a2_coarsen": f"{A}, e AS ({BORDER}), i AS (SELECT ra AS r, count(*) AS n FROM e WHERE ra = rb GROUP BY 1), o AS (SELECT region_idx AS r, count(*) AS n, avg(lat) AS lat, avg(lon) AS lon FROM assignment JOIN nodes USING (node_id) GROUP BY 1) SELECT k AS node_id, coalesce(o.n, 0) AS node_count, coalesce(i.n, 0) AS internal_edges, round(lat, 6) AS lat, round(lon, 6) AS lon FROM range(4) t(k) LEFT JOIN o ON o.r = k LEFT JOIN i ON i.r = k",
    "a2_coarsen_edges": f"{A}, e AS ({BORDER}), b AS (SELECT least(ra, rb) AS a, greatest(ra, rb) AS b, min(weight) AS w FROM e WHERE ra <> rb GROUP BY 1, 2 HAVING count(*) >= 2) SELECT a::BIGINT AS src, b::BIGINT AS dst, w AS weight FROM b UNION ALL SELECT b, a, w FROM b",
    "a3_region_counts": f"{A} SELECT k AS region_idx, count(node_id) AS node_count FROM range(4) t(k) LEFT JOIN assignment ON region_idx = k GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM assignment WHERE region_idx IS NULL HAVING count(*) > 0",
    "j10_fips_crosswalk": "SELECT '3702' || k AS county_fips, 'Strip ' || k AS county_name, '37' AS state_fips, CASE WHEN k < 2 THEN 'C1' END AS cbsa_code, CASE WHEN k < 2 THEN 'West' END AS cbsa_name FROM range(4) t(k)",
    "j11_counties_in_state": "SELECT '37' AS state_fips, '37020,37021,37022,37023' AS counties",
    "j12_adjacent_regions": "SELECT k AS region_a, k + 1 AS region_b FROM range(3) t(k)",
    "a5_level_stats": f"WITH c AS ({CURVE}) SELECT k, count(*) AS runs, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, round({at('value', 25, 100)}, 6) AS p25, round({at('value', 1, 2)}, 6) AS p50, round({at('value', 75, 100)}, 6) AS p75, round({at('value', 9, 10)}, 6) AS p90, round({at('value', 75, 100)} - {at('value', 25, 100)}, 6) AS iqr FROM c GROUP BY k",
    "a8_curve_metrics": f"""WITH c AS (SELECT *, value - lag(value) OVER w AS step, first_value(value) OVER w AS base FROM ({CURVE}) WINDOW w AS (PARTITION BY run ORDER BY k)),
g AS (SELECT run, sum(value) AS auc, max(k) AS m, max(base) AS base, min(k) FILTER (k >= 1 AND value > 0.6) AS ck, arg_max(k, (step, -k)) FILTER (step > 5e-2 * greatest(base, 1e-2)) AS jk, max(step) FILTER (step > 5e-2 * greatest(base, 1e-2)) AS js FROM c GROUP BY run)
SELECT run, round(auc, 6) AS auc_raw, round(auc / (m + 1), 6) AS auc_norm, round(CASE WHEN m > 0 THEN (auc - base * (m + 1)) / m ELSE 0 END, 6) AS auc_excess, ck AS critical_k, jk AS jump_k, round(js, 6) AS jump_size FROM g""",
    "a9_hhi": "WITH b AS (SELECT o_orderpriority AS g, o_custkey % 10 AS b, CAST(sum(o_totalprice) AS DOUBLE) AS v FROM orders GROUP BY ALL) SELECT g, round(sum(pow(v / t, 2)), 6) AS hhi FROM (SELECT *, sum(v) OVER (PARTITION BY g) AS t FROM b) GROUP BY g",
    "g1_sssp": f"{G}, {sssp_sql('SELECT 0::BIGINT')} SELECT s AS source, v AS node_id, d AS dist FROM r",
    "g1_sssp_by_joins": f"WITH RECURSIVE trade AS ({plain(TRADE)}), {sssp_sql('SELECT 0::BIGINT UNION ALL SELECT 7::BIGINT', 'trade')} SELECT s AS source, v AS node_id, d AS dist FROM r",
    "g2_distances": f"{A}, {sssp_sql('SELECT DISTINCT src FROM od')} SELECT od_id, d AS dist FROM od LEFT JOIN r ON s = src AND v = dst",
    "g3_paths": f"{A}, {sssp_sql('SELECT DISTINCT src FROM od')} SELECT od_id, d AS dist, CASE WHEN d IS NOT NULL THEN src END AS first, CASE WHEN d IS NOT NULL THEN dst END AS last FROM od LEFT JOIN r ON s = src AND v = dst",
    "g8_distance_matrix": f"{A}, p AS (SELECT node_id FROM nodes WHERE node_id IN (SELECT src FROM od)), h AS (SELECT node_id FROM nodes WHERE node_id IN (SELECT n_nationkey * 5 + 1 FROM nation)), {sssp_sql('SELECT node_id FROM p')} SELECT a.node_id AS origin, b.node_id AS dest, d AS dist FROM p a CROSS JOIN h b LEFT JOIN r ON s = a.node_id AND v = b.node_id",
    "g9_snapped_distance": f"""{A}, o AS (SELECT src AS u, min({{'v': dst, 'w': weight}}) AS e FROM edges GROUP BY 1),
t AS (SELECT od_id, a.u AS a1, a.e.v AS a2, a.e.w AS aw, b.u AS b1, b.e.v AS b2, b.e.w AS bw FROM od JOIN o a ON a.u = src JOIN o b ON b.u = dst),
f AS (SELECT od_id, a1 AS s, 25e-2 * aw AS x, b1 AS t, 6e-1 * bw AS y FROM t UNION ALL SELECT od_id, a1, 25e-2 * aw, b2, 4e-1 * bw FROM t UNION ALL SELECT od_id, a2, 75e-2 * aw, b1, 6e-1 * bw FROM t UNION ALL SELECT od_id, a2, 75e-2 * aw, b2, 4e-1 * bw FROM t), {sssp_sql('SELECT DISTINCT s FROM f')}
SELECT od_id, round(min(d + x + y), 6) AS dist FROM f JOIN r ON r.s = f.s AND r.v = f.t GROUP BY 1""",
    "g11_blocked_distance": f"{A}, open AS (SELECT * FROM edges WHERE src % 7 <> 0), {sssp_sql('SELECT DISTINCT src FROM od', 'open')} SELECT od_id, d AS dist FROM od LEFT JOIN r ON s = src AND v = dst",
    "g16_alt_bound": f"{A}, {sssp_sql('SELECT 0::BIGINT UNION ALL SELECT 60::BIGINT')} SELECT od_id, coalesce(max(abs(a.d - b.d)), 0) AS bound FROM od LEFT JOIN (r a JOIN r b ON a.s = b.s) ON a.v = src AND b.v = dst GROUP BY 1",
    "r13_shortest_path_edges": f"{G}, {sssp_sql('SELECT 0::BIGINT')} SELECT s AS source, edge_id FROM edges JOIN r a ON a.v = src JOIN (SELECT v, d AS e FROM r) b ON b.v = dst WHERE abs(d + weight - e) < 1e-6 * greatest(1, d, e)",
    "p7_reduced_graph": f"""{A}, c(region_idx, central) AS (VALUES (0, 55::BIGINT), (1, 68), (2, 80), (3, 90)), e AS ({BORDER}), x AS (SELECT * FROM e WHERE ra <> rb), b AS (SELECT src AS node_id, ra AS region_idx FROM x UNION SELECT dst, rb FROM x), {sssp_sql('SELECT central FROM c')},
k AS (SELECT central, node_id, d FROM b JOIN c USING (region_idx) JOIN r ON s = central AND v = node_id WHERE central <> node_id)
SELECT src, dst, min(weight) AS weight FROM (SELECT central AS src, node_id AS dst, d AS weight FROM k UNION ALL SELECT node_id, central, d FROM k UNION ALL SELECT src, dst, weight FROM x) GROUP BY 1, 2""",
    "p10_centrals_by_degree": f"{A}, g AS (SELECT node_id, count(src) AS n FROM nodes LEFT JOIN edges ON src = node_id GROUP BY 1) SELECT CAST(region_idx AS BIGINT) AS region_idx, arg_max(node_id, (n, -node_id)) AS central FROM assignment JOIN g USING (node_id) WHERE region_idx IS NOT NULL GROUP BY 1",
    "p9_components": f"""{G}, e AS (SELECT src, dst FROM edges WHERE src % 3 > 0 AND dst % 3 > 0), c(v, k) USING KEY (v) AS (SELECT node_id, node_id FROM nodes UNION SELECT e.dst, min(c.k) FROM c JOIN e ON e.src = c.v JOIN recurring.c q ON q.v = e.dst WHERE c.k < q.k GROUP BY 1) SELECT v AS node_id, k AS component FROM c""",
    "p1_bridges": f"{G} SELECT src AS u, dst AS v FROM edges WHERE src < dst AND (dst - src = 1 OR src % 50 = 0 AND dst % 50 = 0)",
    "r12_isolation_score": """WITH x AS (SELECT o_custkey % 5 AS run, o_orderkey % 8 AS b, CASE WHEN o_orderkey % 13 > 0 THEN (o_orderkey % 50 + 1)::DOUBLE END AS f, CASE WHEN o_orderkey % 4 > 0 AND o_orderkey % 8 <> o_custkey % 5 THEN (o_orderkey % 90 + 10)::DOUBLE END AS k FROM orders),
g AS (SELECT run, count(*) FILTER (k IS NULL) / count(*) AS disc, least(1, (coalesce(avg(least(6, k / greatest(1, f))), 1) - 1) / 5) AS infl, 1 - count(DISTINCT b) FILTER (k IS NOT NULL) / 8 AS gap FROM x WHERE f IS NOT NULL GROUP BY run)
SELECT run, round(disc, 6) AS disconnected_frac, round(gap, 6) AS coverage_gap, round(infl, 6) AS distance_inflation, round(least(1, greatest(0, 0.5::DOUBLE * disc + 0.3::DOUBLE * infl + 0.2::DOUBLE * gap)), 6) AS isolation_risk FROM g""",
    "r19_composite_score": """WITH x AS (SELECT o_custkey % 6 AS run, (o_orderkey % 40 + 1)::DOUBLE AS p, CASE WHEN o_orderkey % (o_custkey % 6 + 2) > 0 THEN (o_orderkey % 40 + 1 + o_custkey % 9)::DOUBLE END AS d FROM orders)
SELECT run, round(0.6::DOUBLE * (1 - count(d) / count(*)) + 0.4::DOUBLE * least(1, (coalesce(avg(d / p), 0) - 1) / 5), 6) AS value, count(d) < count(*) AS any_disconnected FROM x GROUP BY run""",
    "c2_adjacency": f"WITH t AS ({plain(TRADE)}) SELECT src AS i, dst AS j FROM t WHERE src <> dst UNION SELECT dst, src FROM t WHERE src <> dst",
    "c2_laplacian": f"WITH t AS ({plain(TRADE)}), a AS (SELECT src AS i, dst AS j FROM t WHERE src <> dst UNION SELECT dst, src FROM t WHERE src <> dst) SELECT i, j, -1e0 AS value FROM a UNION ALL SELECT i, i, count(*)::DOUBLE FROM a GROUP BY i",
    "m6_midpoints": f"{G} SELECT edge_id, round((x.lat + y.lat) / 2, 6) AS lat, round((x.lon + y.lon) / 2, 6) AS lon FROM edges JOIN nodes x ON x.node_id = src JOIN nodes y ON y.node_id = dst",
}
