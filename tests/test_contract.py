"""Every registered query with SQL gives the same rows as DuckDB on the small tables."""

import os
import sys

import duckdb
import numpy as np
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check_queries  # noqa: E402

from lapforge import catalog  # noqa: E402
from lapforge.catalog import models  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.QUERIES, catalog.ORACLES
FACTS = models.FACTS


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in check_queries.TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def test_contract_holds_every_query():
    assert set(QUERIES) <= set(check_queries.contract.queries()) and set(SQL) <= set(check_queries.contract.oracle_sql())


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 100
    assert set(SQL) | set(FACTS) == set(QUERIES) and not set(SQL) & set(FACTS)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    verdict = check_queries.compare(QUERIES[name](spark, SF), con, SQL[name])
    assert verdict.startswith("ok") and "TYPES" not in verdict, verdict


@pytest.mark.parametrize("name", sorted(FACTS))
def test_trained_models_have_the_right_rows(spark, con, name):
    """What doesn't depend on the trainer equals the SQL; numbers that do are there, and in their range."""
    df = QUERIES[name](spark, SF).persist()
    columns = [r[0] for r in con.sql(f"DESCRIBE {FACTS[name]}").fetchall()]
    verdict = check_queries.compare(df.select(*columns), con, FACTS[name])
    assert verdict.startswith("ok") and "TYPES" not in verdict, verdict
    numbers = df.drop(*columns).toPandas()
    assert len(numbers.columns) > 0 and np.isfinite(numbers.drop(columns=[c for c in numbers if c.startswith("r2")]).astype(float)).all(axis=None)
    for c in numbers:
        if c.startswith(("rmse", "mae")):
            assert (numbers[c] >= 0).all() and (numbers.empty or (numbers[c] > 0).any())


def test_entry(spark):
    df = check_queries.contract.entry(spark)
    assert df.count() > 0 and "avg_residual_last_3_races" in df.columns
