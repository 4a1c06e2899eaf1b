"""Every catalog query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from archlens.plans import catalog, graph_catalog, source_catalog, telemetry_catalog  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    plain = lambda x: str([plain(y) for y in x]) if isinstance(x, (list, tuple, np.ndarray)) else "" if pd.isna(x) else str(round(x, 6) if isinstance(x, float) else x)
    return sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(catalog.ORACLES[name]).df()
    assert set(got.columns) == set(want.columns) and len(want) > 0
    normal = lambda df: rows(df.astype({c: "float" for c in df.columns if df[c].dtype.kind in "iuf"}))
    assert normal(got) == normal(want)


def test_stream_equals_batch(spark):
    key = lambda df: sorted(map(tuple, df.select("component", "mount_count", "unmount_count", "render_count", "average_render", "last_mounted", "last_unmounted").collect()))
    assert key(catalog.QUERIES["runtime_stream"](spark, SF)) == key(catalog.QUERIES["runtime_agg"](spark, SF))


def test_pushdown_reaches_the_scan(spark):
    plan = catalog.QUERIES["unresolved_refs"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(p_size), LessThanOrEqual(p_size,25)" in plan and "l_extendedprice" not in plan.split("Physical Plan")[1]


def test_entry_contract(spark):
    import __spark_entry__

    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and {"manifest_json", "pass_ledger", "runtime_stream"} <= set(queries)
    assert __spark_entry__.entry(spark).count() > 0
    assert catalog.QUERIES["manifest_json"](spark, SF).first()["json"].startswith("{")
    assert {r.step for r in catalog.QUERIES["pass_ledger"](spark, SF).collect()} == {"orders", "customers", "routes"}
    assert source_catalog.src_edges(spark, SF).count() > 0


def test_shared_pairs_counts_lines_of_any_quantity(spark):
    cells = {(r.s_nationkey, r.p_brand) for r in spark.read.parquet(f"{SF}/lineitem.parquet").join(spark.read.parquet(f"{SF}/part.parquet"), F.col("l_partkey") == F.col("p_partkey")).join(spark.read.parquet(f"{SF}/supplier.parquet"), F.col("l_suppkey") == F.col("s_suppkey")).select("s_nationkey", "p_brand").distinct().collect()}
    want = sum(a < b and x == y for a, x in cells for b, y in cells)
    assert sum(r.shared for r in catalog.QUERIES["shared_pairs_all"](spark, SF).collect()) == want
