"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from keelson.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
registry.load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return float(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs_twice_alike(spark, name):
    """Queries that SQL can't express: the same rows whatever the partitioning."""
    first = rows(registry.QUERIES[name](spark, SF).columns, [tuple(r) for r in registry.QUERIES[name](spark, SF).collect()])
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = registry.QUERIES[name](spark, SF)
        assert rows(again.columns, [tuple(r) for r in again.collect()]) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_entry_without_optional_parts(tmp_path):
    """The driver's module works without the training-data package."""
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{here}/keelson", tmp_path / "keelson", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert 'join_mutual_candidates' in q and not any(k.startswith('op') for k in q); assert set(o) <= set(q)"], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
