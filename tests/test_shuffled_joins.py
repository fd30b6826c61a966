"""Tables of nodes and edges meet by shuffles: their files are a few MB, but a broadcast of them is collected by the driver."""

import re

import pytest
from pyspark.sql import functions as F

from spanweave.operators import regions, sampling, topology
from spanweave.sources.loaders import grid_graph


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def grid(spark):
    g = grid_graph(spark, 12, 9)
    return g, g.nodes.select("node_id", (F.col("node_id") % 3).cast("int").alias("region_idx"))


def test_drawn_pairs(grid):
    out = sampling.od_pairs(grid[0], 30)
    assert "Broadcast" not in plan(out) and 0 < out.count() <= 30


def test_regions_of_edges(grid):
    out = regions.with_regions(*grid)
    assert "Broadcast" not in plan(out)
    assert {(r.ra, r.rb) for r in out.collect()} == {(r.src % 3, r.dst % 3) for r in grid[0].edges.collect()}


def test_pieces(grid, monkeypatch):
    monkeypatch.setattr(topology, "ONE_TASK", 0)
    out = topology.bridges(grid[0])
    assert "Broadcast" not in plan(out) and out.count() == 0


def test_searched_edges_meet_screened_ones(spark, grid):
    """They have a row an edge of each pair, however few the pairs are."""
    from spanweave.operators import fragility, paths

    g = grid[0]
    od = spark.range(20).select(F.col("id").alias("od_id"), F.col("id").alias("src"), (107 - F.col("id")).alias("dst"))
    out = fragility.filtered_route_fragility(g, od, topology.node_levels(g), paths.landmarks(g, 2))
    assert re.search(r"SortMergeJoin \[od_id#\d+L?, pos#\d+\], .*LeftOuter", plan(out)) and out.count() > 100
