import datetime

import pytest
from pyspark.sql import functions as F

from lapforge.functions import scalars as S


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("r")).first().r


@pytest.mark.parametrize("text, code", [("SOFT", 0.0), ("medium", 1.0), ("Wet", 4.0), ("TEST", -1.0), (None, -1.0), (" SOFT", -1.0)])
def test_compound_code(spark, text, code):
    assert one(spark, S.compound_code("c"), c=text) == code


@pytest.mark.parametrize("text, code", [(" s ", 0), ("H", 2), ("i", 3), ("x", -1), (None, -1)])
def test_compound_alias(spark, text, code):
    assert one(spark, S.compound_alias_code("c"), c=text) == code


@pytest.mark.parametrize("p, label", [(0.0, None), (0.2, "Início (0-20%)"), (0.21, "20-40%"), (1.0, "Fim (80-100%)"), (1.02, None), (None, None)])
def test_race_phase_is_right_closed(spark, p, label):
    assert one(spark, S.race_phase("p"), p=p) == label


def test_defaults_and_coercion(spark):
    assert one(spark, S.integer_or("x"), x="abc") == -1
    assert one(spark, S.integer_or("x"), x="7") == 7
    assert one(spark, S.numeric("x"), x="1.5s") is None
    assert one(spark, S.numeric("x"), x=float("inf")) is None
    assert one(spark, S.numeric("x"), x=float("nan")) is None
    assert one(spark, S.flag_or("x"), x=None) is False


def test_durations(spark):
    lap = datetime.timedelta(minutes=1, seconds=23, milliseconds=456)
    df = spark.createDataFrame([(lap,), (None,)], "d interval day to second")
    got = [r.s for r in df.select(S.seconds("d").alias("s")).collect()]
    assert got == [pytest.approx(83.456), None]
    assert df.select(S.milliseconds("d").alias("m")).first().m == pytest.approx(83456.0)


def test_slug_key_era_weight(spark):
    assert one(spark, S.slug("n"), n="São Paulo-Grand/Prix") == "são_paulo_grand_prix"
    assert one(spark, S.session_key("y", "g", "s"), y=2022, g="Bahrain Grand Prix", s="R") == "2022|Bahrain Grand Prix|R"
    assert one(spark, S.regulation_era("y"), y=2023) == 1.0 and one(spark, S.regulation_era("y"), y=2026) == -1.0
    assert one(spark, S.year_weight("y"), y=2023) == 2.0 and one(spark, S.year_weight("y"), y=2024) == 1.0


def test_quali_time_skips_zero(spark):
    assert one(spark, S.best_quali_time("q3", "q2", "q1"), q3=0.0, q2=71.5, q1=72.0) == 71.5


def test_pit_label_and_winner(spark):
    assert one(spark, S.pit_label("t"), t=21.0) == 1 and one(spark, S.pit_label("t"), t=20.0) == 0 and one(spark, S.pit_label("t"), t=None) == 0
    assert one(spark, S.winner("a", "b"), a=1.0, b=1.0) == "global_optuna"
    assert one(spark, S.winner("a", "b", higher_is_better=True), a=2.0, b=1.0) == "local_optuna"


def test_prompt_has_all_fields(spark):
    text = one(spark, S.pit_prompt("a", "b", "c", "d", "e", "f", "g"), a=12, b=21, c=81.5, d=0.3, e=True, f=20, g=82.0)
    for part in ("Volta : 12", "Vida do pneu: 21", "81.5", "0.3", "true", "20", "82.0"):
        assert part in text


def test_scoring_defaults_follow_from_each_other(spark):
    df = spark.createDataFrame([(30.0,)], "TyreLife double")
    row = df.select(*S.scoring_inputs(["Position", "stint_progress", "aggression_score", "unknown"], df.columns)).first()
    assert (row.Position, row.stint_progress, row.unknown) == (1.0, 1.0, 0.0)
    assert row.aggression_score == pytest.approx(40.0)
