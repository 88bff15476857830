"""Reports: local against global models, diagnosis of predictions, feature coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapforge.constants import COVERAGE_COLUMNS
from lapforge.functions import scalars as S
from lapforge.operators import aggregates


def compare_models(global_results: DataFrame, local_results: DataFrame) -> DataFrame:
    """Per track: both models' metrics, who wins each and by how much, largest RMSE gain first."""
    renamed = global_results.select(
        F.col("test_gp").alias("gp"), F.col("rmse").alias("rmse_global"),
        F.col("mae").alias("mae_global"), F.col("r2").alias("r2_global"))
    joined = renamed.join(local_results, "gp")
    return joined.withColumns({
        "rmse_winner": S.winner("rmse_local_optuna", "rmse_global"),
        "mae_winner": S.winner("mae_local_optuna", "mae_global"),
        "r2_winner": S.winner("r2_local_optuna", "r2_global", higher_is_better=True),
        "rmse_gain": F.col("rmse_global") - F.col("rmse_local_optuna"),
        "mae_gain": F.col("mae_global") - F.col("mae_local_optuna"),
        "r2_gain": F.col("r2_local_optuna") - F.col("r2_global"),
    }).orderBy(F.col("rmse_gain").desc(), "gp")


def diagnose(scored: DataFrame, *, truth: str = "y", prediction: str = "pred", easiest_and_hardest: int = 5) -> dict[str, DataFrame]:
    """Baseline check, errors by track, driver (k hardest and easiest) and race phase; one aggregate each."""
    by_driver = aggregates.errors_by(scored, "Driver", truth=truth, prediction=prediction).select("Driver", "mae", "n")
    phase = S.race_phase().alias("race_phase")
    return {
        "baseline": aggregates.trivial_baseline(scored, truth=truth, prediction=prediction),
        "by_gp": aggregates.errors_by(scored, "gp", truth=truth, prediction=prediction)
        .orderBy(F.col("rmse").desc(), "gp"),
        "hardest_drivers": by_driver.orderBy(F.col("mae").desc(), "Driver").limit(easiest_and_hardest),
        "easiest_drivers": by_driver.orderBy("mae", F.col("Driver").desc()).limit(easiest_and_hardest),
        "by_phase": aggregates.errors_by(scored, phase, truth=truth, prediction=prediction)
        .where(F.col("race_phase").isNotNull()).select("race_phase", "rmse", "n"),
    }


def diagnosis(scored: DataFrame, *, truth: str = "y", prediction: str = "pred") -> DataFrame:
    """Errors of all rows and by track, driver and race phase, from one pass: ``part, name, rmse, mae, spread, n``."""
    parts = {"all": [], "gp": ["gp"], "driver": ["Driver"], "phase": ["race_phase"]}
    columns = ["gp", "Driver", "race_phase"]
    level = {p: sum(1 << (2 - i) for i, c in enumerate(columns) if c not in by) for p, by in parts.items()}
    e = F.col(truth) - F.col(prediction)
    grouped = scored.withColumn("race_phase", S.race_phase()).groupingSets([[F.col(c) for c in by] for by in parts.values()], *columns).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.stddev_samp(truth).alias("spread"),
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_level"))
    part = F.coalesce(*[F.when(F.col("_level") == v, p) for p, v in level.items()])
    return grouped.select(part.alias("part"), F.coalesce(*columns).alias("name"), "rmse", "mae", "spread", "n")


def feature_coverage(features: DataFrame) -> DataFrame:
    return aggregates.coverage(features, COVERAGE_COLUMNS)
