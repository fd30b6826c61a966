"""Road-like graphs derived from the star-schema tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.functions.geo import ring as ring_of
from spanweave.graph import RoadGraph

NODES = """SELECT p_partkey AS node_id, 35e0 + 1e-2 * CAST(floor(p_partkey / 50) AS BIGINT) AS lat, -83e0 + 1e-2 * (p_partkey % 50) AS lon,
  CAST(600 + (p_partkey * 37) % 1200 AS DOUBLE) AS elevation FROM {part}"""

EDGES = """SELECT row_number() OVER (ORDER BY src, dst) - 1 AS edge_id, src, dst, weight,
  CASE c WHEN 0 THEN 'motorway' WHEN 1 THEN 'trunk' WHEN 2 THEN 'primary' WHEN 3 THEN 'secondary' WHEN 4 THEN 'tertiary' WHEN 5 THEN 'residential' ELSE 'service' END AS label
FROM (SELECT a AS src, b AS dst, w AS weight, c FROM (
    SELECT p_partkey AS a, p_partkey + 1 AS b, CAST(1 + p_size % 10 AS DOUBLE) AS w, p_partkey % 7 AS c FROM {part} WHERE p_partkey % 50 < 49 AND p_partkey + 1 <= (SELECT max(p_partkey) FROM {part})
    UNION ALL SELECT p_partkey, p_partkey + 50, CAST(1 + p_size % 10 AS DOUBLE), p_partkey % 7 FROM {part} WHERE p_partkey + 50 <= (SELECT max(p_partkey) FROM {part})) u
  UNION ALL SELECT b, a, w, c FROM (
    SELECT p_partkey AS a, p_partkey + 1 AS b, CAST(1 + p_size % 10 AS DOUBLE) AS w, p_partkey % 7 AS c FROM {part} WHERE p_partkey % 50 < 49 AND p_partkey + 1 <= (SELECT max(p_partkey) FROM {part})
    UNION ALL SELECT p_partkey, p_partkey + 50, CAST(1 + p_size % 10 AS DOUBLE), p_partkey % 7 FROM {part} WHERE p_partkey + 50 <= (SELECT max(p_partkey) FROM {part})) u) e"""

#: Every order as a pair of grid nodes.
PAIRS = """SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS od_id, o_custkey % n AS src, o_orderkey % n AS dst
  FROM {orders}, (SELECT count(*) AS n FROM {part}) t WHERE o_custkey % n <> o_orderkey % n"""

#: A trip of every supplier between two grid nodes.
TRIPS = """SELECT od_id, src, dst FROM (SELECT CAST(s_suppkey AS BIGINT) AS od_id, CAST(s_suppkey * 7 % n AS BIGINT) AS src, CAST((s_suppkey * 13 + 5) % n AS BIGINT) AS dst
  FROM {supplier}, (SELECT count(*) AS n FROM {part}) t) x WHERE src <> dst"""

POINTS = "SELECT c_custkey AS point_id, 35e0 + (c_custkey % 397) * 1e-4 AS lat, -83e0 + (c_custkey % 491) * 1e-3 AS lon FROM {customer}"

TRADE = """SELECT row_number() OVER (ORDER BY src, dst) - 1 AS edge_id, src, dst, weight FROM (
  SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, CAST(count(*) AS DOUBLE) AS weight
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey GROUP BY 1, 2) t"""

#: Longitude bounds of the four region strips; the last two columns of the grid stay unassigned.
STRIPS = (-83.005, -82.885, -82.765, -82.645, -82.525)
SOUTH, NORTH = 34.995, 60.0  # strips reach ``NORTH`` at least, and always beyond the last row of the grid
HAZARD = [(35.005, -82.905), (35.005, -82.805), (35.025, -82.805), (35.025, -82.905)]
CENTRE = (35.02, -82.75)


def sql(spark: SparkSession, d: str, text: str) -> DataFrame:
    names = [n for n in ("part", "orders", "customer", "supplier", "lineitem", "nation", "region", "events") if "{" + n + "}" in text]
    return spark.sql(text, **{n: spark.read.parquet(f"{d}/{n}.parquet") for n in names})


def plain(text: str) -> str:
    """The same text for tables under their own names."""
    for n in ("part", "orders", "customer", "supplier", "lineitem", "nation", "region", "events"):
        text = text.replace("{" + n + "}", n)
    return text


def part_grid(spark: SparkSession, d: str) -> RoadGraph:
    return RoadGraph(sql(spark, d, NODES), sql(spark, d, EDGES))


def nation_trade(spark: SparkSession, d: str) -> tuple[RoadGraph, DataFrame]:
    """Trade between nations, and each nation's region as its assignment."""
    nation = spark.read.parquet(f"{d}/nation.parquet")
    ids = nation.select(F.col("n_nationkey").cast("long").alias("node_id"), F.col("n_regionkey").cast("int").alias("region_idx"))
    return RoadGraph(ids.select("node_id"), sql(spark, d, TRADE)), ids


def strip_rings(north: float = NORTH) -> list[list[tuple[float, float]]]:
    return [[(SOUTH, a), (SOUTH, b), (north, b), (north, a)] for a, b in zip(STRIPS, STRIPS[1:])]


def strips(spark: SparkSession, d: str) -> DataFrame:
    """The strips as regions, from below the first row of the grid to above its last one."""
    last = sql(spark, d, NODES).agg(F.max("lat")).first()[0]
    north = max(NORTH, last + 0.005) if last is not None else NORTH
    out = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(i).alias("region_idx"), F.lit(f"3702{i}").alias("region_id"), F.lit(f"Strip {i}").alias("label"), ring_of(r).alias("boundary")) for i, r in enumerate(strip_rings(north))])).alias("r"))
    return out.select("r.*")


#: Strip of a node, in SQL.
STRIP_CASE = "CASE " + " ".join(f"WHEN lon > {a} AND lon < {b} THEN {i}" for i, (a, b) in enumerate(zip(STRIPS, STRIPS[1:]))) + " END"

WITH = f"WITH RECURSIVE nodes AS ({plain(NODES)}), edges AS ({plain(EDGES)}), od AS ({plain(TRIPS)}), points AS ({plain(POINTS)}), trade AS ({plain(TRADE)}), assignment AS (SELECT node_id, CAST({STRIP_CASE} AS INT) AS region_idx FROM nodes)"


def sssp_sql(sources: str, edges: str = "edges", name: str = "r") -> str:
    """Common table of distances (s, v, d) from ``sources`` (a query of one column)."""
    return f"""{name}(s, v, d) USING KEY (s, v) AS (SELECT x, x, 0e0 FROM ({sources}) q(x) UNION
  SELECT {name}.s, e.dst, min({name}.d + e.weight) FROM {name} JOIN {edges} e ON {name}.v = e.src LEFT JOIN recurring.{name} q ON q.s = {name}.s AND q.v = e.dst
  WHERE q.d IS NULL OR {name}.d + e.weight < q.d GROUP BY 1, 2)"""
