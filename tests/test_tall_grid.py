"""Grids taller than those of the test tables."""

import pytest
from pyspark.sql import functions as F

from spanweave.plans import queries

ROWS = 2600  # of 50 nodes each: latitudes up to 61


@pytest.fixture(scope="module")
def tall(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tall"))
    spark.range(ROWS * 50).select(F.col("id").alias("p_partkey"), (F.col("id") % 50 + 1).cast("int").alias("p_size")).write.parquet(f"{d}/part.parquet")
    return d


def test_strips_reach_the_last_row(spark, tall):
    want = {None: 2 * ROWS, **{i: 12 * ROWS for i in range(4)}}
    assert {r.region_idx: r.node_count for r in queries.QUERIES["a3_region_counts"](spark, tall).collect()} == want
    t = queries.QUERIES["a1_border_totals"](spark, tall).first()
    assert (t.connected_pairs, t.border_edges, t.unassigned_edges) == (3, 6 * ROWS, 2 * ROWS)
    assert queries.QUERIES["j5_border_nodes"](spark, tall).count() == 6 * ROWS
    assert queries.QUERIES["j2_boundary_nodes"](spark, tall).count() == 6 * ROWS + 3 * ROWS
    assert {r.node_count for r in queries.QUERIES["a2_coarsen"](spark, tall).collect()} == {12 * ROWS}
    assert queries.QUERIES["f22_region_accessors"](spark, tall).where("region_id is null").count() == 2 * ROWS
