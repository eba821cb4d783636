"""Openings far from every wall get the nearest wall of their plan, as the SQL gives it."""

import duckdb
import pytest

from planlake.plans.queries import QUERIES, SQL
from tests.test_oracle import rows

SCHEMA = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double"


@pytest.fixture
def far(spark, tmp_path):
    """A plan with an opening 12 m from its two walls and one beside them, and a plan without walls."""
    items = [(8, 2, 3, 1, 10.0, 1.0), (8, 5, 4, 2, 20.0, 2.0), (9, 4, 6, 5, 400.0, 3.0), (9, 7, 1, 6, 390.0, 4.0), (10, 2, 3, 5, 10.0, 5.0), (80, 4, 6, 5, 400.0, 6.0)]
    spark.createDataFrame(items, SCHEMA).repartition(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def test_far_openings_have_a_wall(spark, far):
    df = QUERIES["c28_fallback_wall"](spark, far)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{far}/lineitem.parquet/*.parquet')")
    want = duck.sql(SQL["c28_fallback_wall"])
    got = df.collect()
    assert rows(df.columns, got) == rows(list(want.columns), want.fetchall())
    assert sorted((r["plan_id"], r["method"] or "") for r in got) == [(1, "fallback_first"), (1, "fallback_first"), (1, "primary"), (10, "")]
