"""The driver contract: names, SQL, and that the corpus operators can be left out."""

import pathlib
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from spanweave.plans import oracle, queries

D = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def test_names():
    assert set(oracle.ORACLE_SQL) <= set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_corpus_operators(tmp_path):
    root = pathlib.Path(entry.__file__).parent
    shutil.copytree(root / "spanweave", tmp_path / "spanweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'a1_border_edges' in e.queries() and not any(k.startswith('op1_') for k in e.queries()) and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, timeout=120)


@pytest.mark.parametrize("name", ["a1_border_edges", "a5_level_stats", "f16_closure_risk", "g2_distances", "g3_paths", "g8_distance_matrix", "g9_snapped_distance", "g11_blocked_distance", "g16_alt_bound", "j1_assign_regions", "j6_nearest_node", "p7_reduced_graph"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    want = con.execute(oracle.ORACLE_SQL[name])
    cols = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, D)
    assert sorted(cols) == sorted(got.columns)
    key = lambda r: tuple((v is not None, v) for v in r)
    a = sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in want.fetchall()), key=key)
    b = sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in got.select(*cols).collect()), key=key)
    assert a == b


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
