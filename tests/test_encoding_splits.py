import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lapforge.operators import encoding, quality, splits
from helpers import season


def table(df):
    return {r[0]: r.enc for r in df.collect()}


def test_rare_categories_move_to_the_mean(spark):
    df = spark.createDataFrame([("A", -1.0)] * 100 + [("B", -5.0)] * 2, "Driver string, target double")
    enc = table(encoding.fit_target_encoding(df, "target", "Driver"))
    assert enc["A"] == pytest.approx(-1.0131, abs=1e-4) and enc["B"] == pytest.approx(-1.4349, abs=1e-4)
    assert enc[None] == pytest.approx(-110 / 102)


def test_unseen_and_missing_get_the_mean(spark):
    train = spark.createDataFrame([("A", 1.0), ("A", 2.0), ("B", 3.0), ("B", 4.0)], "cat string, y double")
    fitted = encoding.TargetEncoding(["cat"], smoothing=1.0).fit(train, "y")
    out = {r.cat: r.cat_te for r in fitted.transform(spark.createDataFrame([("A",), ("B",), ("C",), (None,)], "cat string")).collect()}
    assert out["A"] == pytest.approx(11 / 6) and out["B"] == pytest.approx(19 / 6) and out["C"] == out[None] == 2.5
    assert fitted.feature_names == ["cat_te"]


def test_encoder_survives_a_round_trip(spark, tmp_path):
    train = spark.createDataFrame([("A", 1.0), ("B", 4.0)], "cat string, y double")
    encoding.TargetEncoding(["cat"], 5.0).fit(train, "y").save(str(tmp_path / "enc"))
    loaded = encoding.TargetEncoding.load(spark, str(tmp_path / "enc"), ["cat"], 5.0)
    assert loaded.transform(train).where("cat_te is null").count() == 0


def test_test_target_does_not_move_the_encoding(spark):
    rng = np.random.default_rng(0)
    p = pd.DataFrame({"i": range(200), "Driver": rng.choice(list("ABCD"), 200), "target": rng.normal(0, 1, 200)})
    df = spark.createDataFrame(p)
    out = quality.encoding_moves(
        df, F.col("i") >= 150, lambda train, _: encoding.TargetEncoding(["Driver"], 10.0).fit(train, "target"),
        lambda e, d: e.transform(d), target="target", key=["i"], encoded="Driver_te").first()
    assert (out.n_rows, out.changed) == (50, 0)
    leaky = quality.encoding_moves(
        df, F.col("i") >= 150, lambda _, everything: encoding.TargetEncoding(["Driver"], 10.0).fit(everything, "target"),
        lambda e, d: e.transform(d), target="target", key=["i"], encoded="Driver_te").first()
    assert (leaky.n_rows, leaky.changed) == (50, 50)


def test_leave_fold_out_equals_fold_by_fold_fit(spark):
    rng = np.random.default_rng(1)
    p = pd.DataFrame({"i": range(300), "cat": rng.choice(list("ABCDE"), 300), "fold": rng.integers(0, 4, 300), "y": rng.normal(0, 1, 300)})
    p.loc[0, ["cat", "fold"]] = ["ONLY", 2]
    df = spark.createDataFrame(p)
    got = {r.i: r.cat_te for r in encoding.leave_fold_out_encoding(df, "y", "cat", "fold").collect()}
    for fold in range(4):
        enc = encoding.TargetEncoding(["cat"]).fit(df.where(F.col("fold") != fold), "y")
        for r in enc.transform(df.where(F.col("fold") == fold)).collect():
            assert got[r.i] == pytest.approx(r.cat_te, abs=1e-12)


def test_codes_follow_sorted_order(spark):
    names = ["Zeta", "alpha", "Alpha", "Ábc", "A", "AB", "zeta", "1"]
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "Team string")
    got = {r.Team: r.code for r in encoding.ordinal_encode(df, "Team", "code").collect()}
    want = {n: i for i, n in enumerate(sorted(names, key=lambda s: s.encode()))}
    assert got == {**want, None: -1}


def test_one_hot_refuses_large_dictionaries(spark):
    df = spark.range(5).select(F.col("id").cast("string").alias("c"))
    assert len(encoding.one_hot(df, ["c"], most=5).columns) == 6
    with pytest.raises(ValueError, match="one_hot_long"):
        encoding.one_hot(df, ["c"], most=4)


def test_one_hot_marks_missing(spark):
    out = encoding.one_hot(spark.createDataFrame([("a",), (None,), ("b",)], "c string"), ["c"])
    assert out.columns == ["c_a", "c_b", "c_nan"]
    assert out.agg(F.sum("c_a"), F.sum("c_b"), F.sum("c_nan")).first()[:] == (1, 1, 1)
    many = spark.range(1500).select("id", F.col("id").cast("string").alias("c"))
    assert len(encoding.one_hot(many, ["c"]).columns) == 1502
    long = encoding.one_hot_long(many.unionByName(spark.sql("SELECT -1L AS id, CAST(NULL AS STRING) AS c")), ["id"], ["c"])
    assert {(r.id, r.feature) for r in long.collect()} == {(i, f"c_{i}") for i in range(1500)} | {(-1, "c_nan")}


def test_codes_of_names_with_one_beginning(spark):
    df = spark.range(10_000).select(F.format_string("Customer#%09d", (F.col("id") * 7919) % 10_000).alias("name"))
    got = encoding.category_codes(df, "name").collect()
    assert all(int(r.name.split("#")[1]) == r.code for r in got) and len(got) == 10_000


@pytest.mark.parametrize("groups", [3, 12_000])
def test_greedy_folds_at_every_size(spark, groups):
    df = spark.range(groups).select(F.col("id").cast("string").alias("gp")).unionByName(spark.sql("SELECT CAST(NULL AS STRING) AS gp"))
    out = splits.group_kfold(df, "gp", 3)
    assert out.count() == groups and out.where("gp IS NULL").count() == 0
    assert [r["count"] for r in out.groupBy("fold").count().orderBy("fold").collect()] == [groups // 3] * 3
    assert splits.group_kfold(df, "gp", 3, method="hash").count() == groups


def test_group_kfold_keeps_groups_whole_and_balances(spark):
    sizes = {"a": 50, "b": 30, "c": 20, "d": 20, "e": 10, "f": 5}
    df = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "gp string")
    out = splits.group_kfold(df, "gp", 3)
    assert out.count() == sum(sizes.values())
    assert out.groupBy("gp").agg(F.count_distinct("fold").alias("k")).where("k <> 1").count() == 0
    loads = sorted(r["count"] for r in out.groupBy("fold").count().collect())
    assert loads == [40, 45, 50]


def test_rows_do_not_move_for_their_fold(spark):
    df = spark.range(1_500_000).select((F.col("id") % 7).cast("string").alias("gp"), "id")
    out = splits.group_kfold(df, "gp", 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert out.count() == 1_500_000 and out.select("gp", "fold").distinct().count() == 7


def test_leave_one_group_out_and_walk_forward(spark):
    df = spark.createDataFrame(season(2, ("B", "A", "C"), (2022, 2023, 2024, 2025), 3))
    folds = {r.gp: r.fold for r in splits.leave_one_group_out(df).select("gp", "fold").distinct().collect()}
    assert folds == {"A": 1, "B": 2, "C": 3}
    parts = {(r.year, r.part) for r in splits.walk_forward(df).select("year", "part").distinct().collect()}
    assert parts == {(2022, "train"), (2023, "train"), (2024, "test")}


def test_random_split_ignores_partitioning(spark):
    df = spark.range(2000)
    a = {r.id for r in splits.random_split(df, ["id"]).where("part = 'test'").collect()}
    b = {r.id for r in splits.random_split(df.repartition(13), ["id"]).where("part = 'test'").collect()}
    assert a == b and 300 < len(a) < 500
