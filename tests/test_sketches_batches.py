import numpy as np
import pytest
from pyspark.sql import functions as F

from lapforge import constants as K
from lapforge.functions import scalars as S
from lapforge.operators import sketches
from lapforge.plans import ingest
from lapforge.sources import batches
from helpers import season

PROBS = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}


def values():
    draw = np.random.default_rng(8)
    parts = {"wide": draw.normal(0, 1e6, 700), "tight": 80 + draw.random(900) / 50, "tiny": draw.normal(0, 1e-9, 50), "ties": draw.integers(-3, 4, 300).astype(float),
             "far": np.array([1e-300, -1e300, 0.0, 5e-324, 1.5e308])}
    return [(k, float(v)) for k, vs in parts.items() for v in vs], parts


@pytest.mark.parametrize("error", [0.0005, 0.05])
def test_quantiles_are_within_the_error_and_do_not_depend_on_batches(spark, tmp_path, error):
    rows, parts = values()
    df = spark.createDataFrame([*rows, ("wide", None), ("tight", float("nan")), ("tight", float("inf")), ("none", None)], "k string, v double")
    whole = sketches.sketch(df, ["k"], "v", error)
    batch = F.pmod(F.xxhash64("v"), F.lit(3))
    for i in (2, 0, 1, 0):
        sketches.store(sketches.sketch(df.where(batch == i), ["k"], "v", error), str(tmp_path), str(i))
    merged = sketches.merged(spark, str(tmp_path), ["k"])
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))
    got = {r.k: r for r in sketches.sketched_quantiles(merged, ["k"], PROBS, error).collect()}
    assert set(got) == set(parts)
    for k, vs in parts.items():
        for name, p in PROBS.items():
            exact = np.sort(vs)[int(np.floor(p * (len(vs) - 1)))]
            assert abs(got[k][name] - exact) <= error * abs(exact) * (1 + 1e-6) + 5e-324, (k, name)


class Crash(Exception):
    pass


def test_crashes_and_repeats_leave_every_row_once(spark, tmp_path):
    path = str(tmp_path / "laps")
    laps = spark.createDataFrame(season(2, ("A", "B"), (2024,), 5)).select("year", "gp", "session_code", "DriverNumber", "LapNumber")
    plan = spark.createDataFrame([(2024, g, "R") for g in ("A", "B", "C")], "year long, gp string, session_code string").withColumn("key", S.session_key())
    asked = []

    def load(todo):
        asked.append(sorted(r.key for r in todo.collect()))
        return laps.join(todo.select(*K.SESSION), K.SESSION, "left_semi")

    def crash():
        raise Crash

    def stored():
        rows = batches.committed_rows(spark, path, laps.schema)
        return rows.count(), rows.distinct().count()

    assert stored() == (0, 0) and batches.committed_outcomes(spark, path).count() == 0
    with pytest.raises(Crash):
        ingest.run_batch(spark, path, "one", plan.where("gp = 'A'"), load, crash)
    assert stored() == (0, 0)  # the crashed run's data are there, but nobody reads them
    for _ in range(2):
        ingest.run_batch(spark, path, "one", plan.where("gp = 'A'"), load)
        assert stored() == (10, 10)
    with pytest.raises(Crash):
        ingest.run_batch(spark, path, "one", plan.where("gp = 'A'"), load, crash)
    assert stored() == (10, 10)  # a crash while replacing a batch keeps the earlier version
    ingest.run_batch(spark, path, "two", plan, load)
    assert stored() == (20, 20) and asked[-1] == ["2024|B|R", "2024|C|R"]
    assert {(r.key, r.status, r.n_rows) for r in batches.committed_outcomes(spark, path).collect()} == {
        ("2024|A|R", "completed", 10), ("2024|B|R", "completed", 10), ("2024|C|R", "failed", 0)}
    assert batches.manifests(spark, path).where("batch = 'one'").first().version == 2
