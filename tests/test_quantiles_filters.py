import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lapforge.operators import filters
from lapforge.operators.aggregates import describe
from lapforge.operators.quantiles import approximate_quantiles, group_quantiles
from helpers import sorted_rows

PROBS = {"a": 0.01, "b": 0.25, "c": 0.5, "d": 0.75, "e": 0.99}


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(3)
    parts = {"one": [5.0], "two": [1.0, -2.0], "same": [3.0] * 9, "wide": rng.normal(0, 1e6, 501), "tight": 80 + rng.random(1000) / 50,
             "ties": rng.integers(0, 5, 400).astype(float), "zero": [0.0, -0.0, 1e-12, -1e-12]}
    return pd.DataFrame([(k, float(v)) for k, vs in parts.items() for v in vs], columns=["k", "v"])


@pytest.mark.parametrize("rows", [4_000_000, 10, 0])
def test_exact_quantiles_match_numpy(spark, values, rows):
    df = spark.createDataFrame(values).unionByName(spark.createDataFrame([("one", None)], "k string, v double"))
    out = sorted_rows(group_quantiles(df, ["k"], "v", PROBS, rows=rows), "k").set_index("k")
    assert set(out.index) == set(values["k"])
    for k, group in values.groupby("k"):
        np.testing.assert_allclose(out.loc[k, list(PROBS)].astype(float), np.quantile(group["v"], list(PROBS.values())), rtol=1e-12, atol=1e-15)


@pytest.mark.parametrize("special", [[float("nan")], [float("inf")], [float("-inf"), float("inf")], [float("nan"), float("-inf"), None]])
def test_both_paths_agree_to_the_last_bit(spark, special):
    rng = np.random.default_rng(5)
    rows = [("a", v) for v in [*special, *(rng.normal(size=300) * 1e-5).tolist(), 0.0, -0.0]] + [("b", v) for v in special]
    df = spark.createDataFrame(rows, "k string, v double")
    small, spread = (sorted_rows(group_quantiles(df, ["k"], "v", PROBS, rows=n), "k") for n in (4_000_000, 0))
    pd.testing.assert_frame_equal(small, spread, check_exact=True)


def test_values_near_zero_fall_into_many_bins(spark):
    from lapforge.operators.quantiles import _bin

    df = spark.range(1, 100_001).select((F.col("id") * 1e-10).alias("v"))
    assert df.select(_bin(F.col("v")).alias("b")).distinct().count() > 10_000


def test_approximate_quantiles_stay_close(spark, values):
    tight = spark.createDataFrame(values[values.k == "tight"])
    row = approximate_quantiles(tight, ["k"], "v", {"m": 0.5}).first()
    assert abs(row["m"] - values[values.k == "tight"]["v"].median()) < 1e-3


def test_iqr_filter_per_session(spark):
    rows = [(2024, "A", "R", 80.0 + i / 100) for i in range(50)] + [(2024, "A", "R", 160.0), (2024, "B", "R", 160.0), (2024, "B", "R", 161.0)]
    df = spark.createDataFrame(rows, "year int, gp string, session_code string, LapTime double")
    kept = filters.iqr_filter(df)
    assert kept.where("gp = 'A'").count() == 50 and kept.where("gp = 'B'").count() == 2
    assert filters.iqr_filter(df, approximate=True).where("gp = 'A'").count() == 50


def test_basic_filter_skips_absent_columns_and_keeps_unknown_event(spark):
    df = spark.createDataFrame([("A", 80.0, None), (None, 81.0, False), ("Pre-Season Testing", 82.0, False), ("A", None, False), ("A", 83.0, True)],
                               "gp string, LapTime double, Deleted boolean")
    assert sorted(r.LapTime for r in filters.basic_filter(df).collect()) == [80.0, 81.0]
    assert filters.basic_filter(df.drop("Deleted")).count() == 3


def test_retention_counts_every_stage_in_one_pass(spark):
    df = spark.range(10).withColumn("x", F.col("id").cast("double"))
    out = filters.retention(df, {"low": F.col("x") >= 2, "high": F.col("x") < 5}).orderBy("stage_no").collect()
    assert [(r.rows_in, r.rows_out) for r in out] == [(10, 8), (8, 3)] and out[0].pct == 80.0


def test_residual_filter_is_inclusive(spark):
    df = spark.createDataFrame([(3.0,), (-3.0,), (3.1,), (None,)], "LapTimeResidual double")
    assert filters.residual_filter(df, 3.0).count() == 2


def test_groups_with_rows(spark):
    df = spark.range(10).select((F.col("id") < 7).alias("k"))
    assert filters.groups_with_rows(df, ["k"], 4).count() == 7


def test_describe(spark):
    row = describe(spark.range(1, 6).select(F.col("id").cast("double").alias("x")), "x").first()
    assert (row.n, row.mean, row.min, row.p50, row.max) == (5, 3.0, 1.0, 3.0, 5.0)
