"""Connected components by alternating large-star and small-star joins; nothing is gathered on the driver but whether it is over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm.common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected ``edges`` (a, b); the component is its smallest node.

    Nulls and loops are dropped and repeated edges count once.  Every round writes its edges to the shared folder, so lineage
    stays short; hot nodes are reduced by a partial minimum, and the joins back are ones that AQE can split.
    """
    e = materialize(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    while not _is_stars(e):
        both = e.union(e.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = materialize(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct()
        e = materialize(small, "small")
    e = e.distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


def _is_stars(e: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most and none that has one also is one: then components are read off."""
    ends = e.distinct().select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()
