"""Grouped aggregates. Every one is partial + final, so a hot group is reduced before it moves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapforge import constants as K
from lapforge.functions import scalars as S
from lapforge.operators.quantiles import SMALL_GROUP, group_quantiles
from lapforge.operators.segments import SEGMENT_ROWS, open_segments


def _share(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def sample_aggregates(drs_from: float = 10, open_ended: bool = True) -> list[Column]:
    """Nine lap aggregates of car samples. ``open_ended``: DRS counts from ``drs_from``, else strictly above it."""
    drs = F.col("DRS") >= drs_from if open_ended else F.col("DRS") > drs_from
    return [
        F.avg("Speed").alias("speed_mean"), F.max("Speed").alias("speed_max"),
        F.stddev_samp("Speed").alias("speed_std"),
        F.avg("Throttle").alias("throttle_mean"), F.stddev_samp("Throttle").alias("throttle_std"),
        _share(F.col("Brake") > 0).alias("brake_ratio"),
        F.avg("RPM").alias("rpm_mean"), F.avg("nGear").alias("gear_mean"), _share(drs).alias("drs_ratio"),
    ]


def lap_telemetry(samples: DataFrame, keys: Sequence[str], *, min_samples: int = K.MIN_SAMPLES) -> DataFrame:
    """Samples -> one row per lap; laps with fewer than ``min_samples`` samples are left out."""
    out = samples.groupBy(*keys).agg(*sample_aggregates(), F.count(F.lit(1)).alias("_n"))
    return out.where(F.col("_n") >= min_samples).drop("_n")


def lap_telemetry_simple(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The older variant: any open DRS counts, no minimum number of samples."""
    return samples.groupBy(*keys).agg(*sample_aggregates(0, open_ended=False))


def live_aggregates() -> list[Column]:
    return [
        *sample_aggregates(0, open_ended=False), F.avg("Brake").alias("brake_mean"),
        F.avg("LapTime").alias("lap_time_mean_3"),
    ]


def live_features(
    samples: DataFrame, keys: Sequence[str], *, order: Sequence[str] = ("ts",), rows: int = SEGMENT_ROWS
) -> DataFrame:
    """What a live model sees: aggregates over everything received so far.

    ``lap_time_mean_3`` is the mean of all lap times; ``lap_time_delta`` the mean change between adjacent samples,
    where a missing value on either side leaves the pair out.
    """
    s = open_segments(samples.withColumn("_at", F.unix_micros(order[0])), keys, ["_at", *order[1:]], depth=1, rows=rows)
    change = F.col("LapTime") - F.lag("LapTime", 1).over(s.ordered())
    return s.close(s.frame.withColumn("_change", change)).groupBy(*keys).agg(
        *live_aggregates(), F.avg("_change").alias("lap_time_delta")
    )


_LIVE_MEANS = {"speed_mean": "Speed", "throttle_mean": "Throttle", "rpm_mean": "RPM", "gear_mean": "nGear", "brake_mean": "Brake",
               "lap_time_mean_3": "LapTime", "lap_time_delta": "_change"}
_LIVE_SPREADS = {"speed_std": "Speed", "throttle_std": "Throttle"}


def _live_part_columns(means: Mapping[str, str]) -> list[Column]:
    sums = [f for name, c in means.items() for f in (F.sum(c).alias(f"s_{name}"), F.count(c).alias(f"n_{name}"))]
    spreads = [f for name, c in _LIVE_SPREADS.items() for f in (
        F.count(c).alias(f"n_{name}"), F.avg(c).alias(f"m_{name}"), (F.var_pop(c) * F.count(c)).alias(f"q_{name}"))]
    shares = [F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in (("c_brake", F.col("Brake") > 0), ("c_drs", F.col("DRS") > 0))]
    return [*sums, *spreads, *shares, F.max("Speed").alias("speed_max"), F.count(F.lit(1)).alias("n_all")]


def live_pane_parts(order: Sequence[str]) -> list[Column]:
    """What the live aggregates of a short stretch of one key add up from, and its first and last lap time in ``order``."""
    laps = F.transform(F.sort_array(F.collect_list(F.struct(*order, "LapTime"))), lambda x: x["LapTime"])
    pairs = F.zip_with(F.slice(laps, 1, F.size(laps) - 1), F.slice(laps, 2, F.size(laps) - 1), lambda a, b: b - a)
    changes = F.filter(pairs, lambda c: c.isNotNull())
    means = {n: c for n, c in _LIVE_MEANS.items() if n != "lap_time_delta"}
    return [
        *_live_part_columns(means), F.aggregate(changes, F.lit(0.0), lambda a, c: a + c).alias("s_lap_time_delta"),
        F.size(changes).cast("bigint").alias("n_lap_time_delta"), F.element_at(laps, 1).alias("first_lap"), F.element_at(laps, -1).alias("last_lap"),
    ]


def join_live_panes(panes: DataFrame, keys: Sequence[str], pane: str, *, rows: int = SEGMENT_ROWS) -> DataFrame:
    """The live aggregates of all panes of a key, with the change from each pane to the next."""
    s = open_segments(panes.withColumn("_at", F.unix_micros(pane)), keys, ["_at"], depth=1, rows=rows)
    between = F.col("first_lap") - F.lag("last_lap", 1).over(s.ordered())
    joined = s.close(s.frame.withColumn("_between", between))
    return merge_live_parts(joined.withColumns({
        "s_lap_time_delta": F.col("s_lap_time_delta") + F.coalesce(F.col("_between"), F.lit(0.0)),
        "n_lap_time_delta": F.col("n_lap_time_delta") + F.col("_between").isNotNull().cast("bigint")}), keys)


def merge_live_parts(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The live aggregates of all samples, from the parts of each key."""
    means = [F.try_divide(F.sum(f"s_{n}"), F.sum(f"n_{n}")).alias(n) for n in _LIVE_MEANS]

    def spread(n: str) -> Column:
        count = F.sum(f"n_{n}")
        mean = F.try_divide(F.sum(F.col(f"n_{n}") * F.col(f"m_{n}")), count)
        squares = F.sum(F.col(f"q_{n}") + F.col(f"n_{n}") * F.col(f"m_{n}") * F.col(f"m_{n}")) - count * mean * mean
        return F.when(count > 1, F.sqrt(F.greatest(squares, F.lit(0.0)) / (count - 1))).alias(n)

    shares = [F.try_divide(F.sum(c), F.sum("n_all")).alias(n) for n, c in (("brake_ratio", "c_brake"), ("drs_ratio", "c_drs"))]
    return parts.groupBy(*keys).agg(*means, *[spread(n) for n in _LIVE_SPREADS], *shares, F.max("speed_max").alias("speed_max"))


def live_speed(samples: DataFrame, keys: Sequence[str], *, order: Sequence[str] = ("ts",)) -> DataFrame:
    """The smaller live set: lap columns stand for mean speed and the change from first to last speed."""
    at = F.struct(*order)
    return samples.groupBy(*keys).agg(
        F.avg("Speed").alias("speed_mean"), F.avg("Brake").alias("brake_mean"),
        F.avg("Throttle").alias("throttle_mean"), F.avg("Speed").alias("lap_time_mean_3"),
        (F.max_by("Speed", at) - F.min_by("Speed", at)).alias("lap_time_delta"),
    )


# --- race level ------------------------------------------------------------------------------------------------
def race_residuals(df: DataFrame, *, driver: str = "Driver", value: str = "LapTimeResidual") -> DataFrame:
    keys = [driver, "year", "gp"]
    return df.where(S.all_present(keys)).groupBy(*keys).agg(F.avg(value).alias("mean_residual"))


def recent_form(
    races: DataFrame, *, driver: str = "Driver", order: str = "gp", value: str = "mean_residual", races_back: int = 3
) -> DataFrame:
    """Mean residual over the previous races of the season. The group is a season of one driver, a few dozen rows."""
    w = Window.partitionBy(driver, "year").orderBy(order).rowsBetween(-races_back, -1)
    return races.withColumn(f"avg_residual_last_{races_back}_races", F.avg(value).over(w))


def gp_order(df: DataFrame, order: str = "gp") -> DataFrame:
    """Running number of the events of a year, alphabetical unless ``order`` names the calendar round."""
    events = df.select("year", "gp", *([order] if order != "gp" else [])).distinct()
    w = Window.partitionBy("year").orderBy(order)
    return events.select("year", "gp", F.dense_rank().over(w).cast("bigint").alias("gp_order"))


def race_totals(df: DataFrame, keys: Sequence[str], *, value: str = "LapTime", pit: str = "pit") -> DataFrame:
    """Race time with pit losses, mean lap and number of stops of a lap log."""
    stops = F.coalesce(F.sum(pit), F.lit(0))
    total = F.sum(value) + F.lit(K.PIT_LOSS_SECONDS) * stops
    return df.groupBy(*keys).agg(
        total.alias("total_time"), F.try_divide(total, F.count(F.lit(1))).alias("mean_lap"), stops.alias("pit_stops")
    )


# --- profile -----------------------------------------------------------------------------------------------------
def row_counts(df: DataFrame, year: str = "year", session: str = "session_code") -> DataFrame:
    """Rows per year (session NULL) and per (year, session), both from one rollup."""
    return (
        df.rollup(year, session).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
        .where(F.col("level") < 3)
    )


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-missing count and share per column, in one pass."""
    present = [c for c in columns if c in df.columns]
    counts = df.agg(F.count(F.lit(1)).alias("_all"), *[F.count(c).alias(c) for c in present])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("non_null")) for c in present])
    return counts.select(F.inline(cells), F.col("_all").alias("n_rows")).withColumn(
        "pct", F.try_divide(F.lit(100.0) * F.col("non_null"), F.col("n_rows"))
    )


def describe(df: DataFrame, value: str, probs: Mapping[str, float] | None = None, *, rows: int = SMALL_GROUP) -> DataFrame:
    """One row: count, mean, sample std, min, percentiles, max."""
    probs = dict(probs or {"p01": 0.01, "p50": 0.5, "p99": 0.99})
    base = df.agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    ).withColumn("_one", F.lit(1))
    keyed = df.select(F.lit(1).alias("_one"), value)
    return base.join(group_quantiles(keyed, ["_one"], value, probs, rows=rows), "_one", "left").drop("_one")


def group_count(df: DataFrame, column: str = "gp") -> DataFrame:
    return df.agg(F.count_distinct(column).alias("n_groups"))


def distinct_years(df: DataFrame, column: str = "year") -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def head(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


# --- model quality -------------------------------------------------------------------------------------------------
def _errors(truth: str, prediction: str) -> dict[str, Column]:
    e = F.col(truth) - F.col(prediction)
    spread = F.nullif(F.var_pop(truth) * F.count(truth), F.lit(0.0))
    return {
        "rmse": F.sqrt(F.avg(e * e)), "mae": F.avg(F.abs(e)), "r2": 1 - F.try_divide(F.sum(e * e), spread),
        "baseline_trivial_rmse": F.stddev_samp(truth),
        "improvement_over_trivial": 1 - F.try_divide(F.sqrt(F.avg(e * e)), F.stddev_samp(truth)),
    }


def error_metrics(df: DataFrame, keys: Sequence[str] = (), *, truth: str = "y", prediction: str = "pred") -> DataFrame:
    """RMSE, MAE and R2; R2 is NULL where the truth does not vary."""
    m = _errors(truth, prediction)
    return df.groupBy(*keys).agg(*[m[n].alias(n) for n in ("rmse", "mae", "r2")], F.count(truth).alias("n"))


def trivial_baseline(
    df: DataFrame, *, truth: str = "y", prediction: str = "pred", more: Sequence[Column] = (), with_r2: bool = False,
) -> DataFrame:
    """Metrics next to the spread of the truth and the improvement over it, in one aggregate."""
    m = _errors(truth, prediction)
    names = ["rmse", "mae", *(["r2"] if with_r2 else []), "baseline_trivial_rmse", "improvement_over_trivial"]
    return df.agg(*[m[n].alias(n) for n in names], *more)


def fold_summary(folds: DataFrame, metrics: Sequence[str] = ("rmse", "mae", "r2")) -> DataFrame:
    """Mean and population deviation of each metric over the folds."""
    return folds.agg(*[
        f for m in metrics for f in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))
    ])


def best_fold(folds: DataFrame, *, metric: str = "rmse", fold: str = "fold", label: str = "test_gp") -> DataFrame:
    """The fold with the smallest metric, the first one on a tie."""
    return folds.agg(F.min(F.struct(metric, fold, label)).alias("b")).select(
        F.col(f"b.{label}").alias("best_group"), F.col(f"b.{metric}").alias("best_rmse")
    )


def fold_rows(df: DataFrame, fold: str = "fold") -> DataFrame:
    """Training and test rows of every fold, from one count per fold."""
    per_fold = df.groupBy(fold).agg(F.count(F.lit(1)).alias("test_rows"))
    everything = per_fold.agg(F.sum("test_rows")).scalar()
    return per_fold.select(fold, (everything - F.col("test_rows")).alias("train_rows"), "test_rows")


def errors_by(df: DataFrame, key: str | Column, *, truth: str = "y", prediction: str = "pred") -> DataFrame:
    e = F.col(truth) - F.col(prediction)
    return df.groupBy(key).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.count(F.lit(1)).alias("n")
    )


def importance_share(importance: DataFrame, *, value: str = "importance", name: str = "feature") -> DataFrame:
    """Share of the three and ten strongest features; one row per model feature goes in, so it is small."""
    w = Window.orderBy(F.col(value).desc(), F.col(name))
    ranked = importance.withColumn("_rn", F.row_number().over(w))

    def share(k: int) -> Column:
        return F.sum(F.when(F.col("_rn") <= k, F.col(value))) * 100

    return ranked.agg(share(3).alias("top3_pct"), share(10).alias("top10_pct")).withColumn(
        "concentrated", F.col("top3_pct") > K.CONCENTRATION_WARNING
    )
