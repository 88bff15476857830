"""Column expressions. Nothing here touches a DataFrame; all of it stays inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lapforge import constants as K

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(key: ColumnOrName, table: Mapping, default=None) -> Column:
    """Value of ``key`` in a literal table; ``default`` where it has none."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    found = F.element_at(F.create_map(*pairs), _col(key))
    return found if default is None else F.coalesce(found, F.lit(default))


# --- durations, casts, defaults --------------------------------------------------------------------------------
def seconds(interval: ColumnOrName) -> Column:
    """Day-time interval -> seconds as double; missing stays missing."""
    c = _col(interval)
    whole = F.extract(F.lit("DAY"), c) * 86400 + F.extract(F.lit("HOUR"), c) * 3600 + F.extract(F.lit("MINUTE"), c) * 60
    return (whole + F.extract(F.lit("SECOND"), c)).cast("double")


def milliseconds(interval: ColumnOrName) -> Column:
    return seconds(interval) * 1000


def integer_or(c: ColumnOrName, default: int = -1) -> Column:
    return F.coalesce(_col(c).try_cast("int"), F.lit(default))


def flag_or(c: ColumnOrName, default: bool = False) -> Column:
    return F.coalesce(_col(c).try_cast("boolean"), F.lit(default))


def numeric(c: ColumnOrName) -> Column:
    """Number or NULL: text that is no number, NaN and infinities become NULL."""
    return finite(_col(c).try_cast("double"))


def finite(c: ColumnOrName) -> Column:
    c = _col(c)
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


# --- codes -----------------------------------------------------------------------------------------------------
def compound_code(c: ColumnOrName = "Compound") -> Column:
    codes = {k: float(v) for k, v in K.COMPOUND_CODES.items()}
    return lookup(F.upper(_col(c)), codes, -1.0)


def compound_alias_code(c: ColumnOrName = "Compound") -> Column:
    return lookup(F.upper(F.trim(_col(c))), K.COMPOUND_ALIASES, -1)


def compound_name(code: ColumnOrName) -> Column:
    return lookup(_col(code).cast("int"), K.COMPOUND_NAMES, "UNKNOWN")


def regulation_era(year: ColumnOrName = "year", eras: Mapping[int, int] = K.REGULATION_ERAS) -> Column:
    return lookup(_col(year).cast("int"), {k: float(v) for k, v in eras.items()}, -1.0)


def year_weight(year: ColumnOrName = "year", weights: Mapping[int, float] = K.YEAR_WEIGHTS) -> Column:
    return lookup(_col(year).cast("int"), dict(weights), 1.0)


def session_key(year: ColumnOrName = "year", gp: ColumnOrName = "gp", code: ColumnOrName = "session_code") -> Column:
    return F.concat_ws("|", _col(year).cast("string"), _col(gp), _col(code))


def slug(name: ColumnOrName) -> Column:
    return F.translate(F.lower(_col(name)), " -/", "___")


# --- lap state -------------------------------------------------------------------------------------------------
def is_raining(rainfall: ColumnOrName = "Rainfall") -> Column:
    return (F.coalesce(numeric(rainfall), F.lit(0.0)) > 0).cast("int")


def is_neutralized(sc: ColumnOrName = "is_sc", vsc: ColumnOrName = "is_vsc") -> Column:
    return F.coalesce((_col(sc) == 1) | (_col(vsc) == 1), F.lit(False)).cast("int")


def pit_label(tyre_life: ColumnOrName = "TyreLife", limit: float = K.PIT_TYRE_LIFE) -> Column:
    return F.coalesce((_col(tyre_life) > limit).cast("int"), F.lit(0))


def race_phase(progress: ColumnOrName = "LapNumber_pct") -> Column:
    """Label of the right-closed bin; NULL outside all bins, zero included."""
    p = _col(progress)
    bins = zip(K.PHASE_EDGES, K.PHASE_EDGES[1:], K.PHASE_LABELS)
    return F.coalesce(*[F.when((p > low) & (p <= high), F.lit(label)) for low, high, label in bins])


# --- scores over the previous lap ----------------------------------------------------------------------------------
def degradation_score() -> Column:
    def part(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0))

    return part("lap_time_delta_prev") - part("speed_mean_delta_prev") + part("brake_ratio_prev")


def aggression_score() -> Column:
    return F.col("throttle_mean_prev") * (1 - F.col("brake_ratio_prev"))


def efficiency_score() -> Column:
    return F.try_divide(F.col("speed_mean_prev"), F.col("rpm_mean_prev") + 1)


def drs_intensity() -> Column:
    return F.col("drs_ratio_prev") * F.col("speed_max_prev")


# --- race-control messages -------------------------------------------------------------------------------------------
def neutralization_change(category: ColumnOrName, status: ColumnOrName, message: ColumnOrName) -> dict[str, Column]:
    """``sc`` / ``vsc``: 1 where a message sets the state, 0 where it clears it, NULL where it leaves it alone."""
    text = F.upper(F.coalesce(_col(message), F.lit("")))
    state = F.coalesce(_col(status), F.lit(""))
    start = state.contains("DEPLOYED") | text.contains("DEPLOYED")
    stop = state.contains("ENDING") | text.contains("IN THIS LAP")
    change = F.when(_col(category) == "SafetyCar", F.when(start, 1).when(stop, 0))
    virtual = text.contains("VIRTUAL")
    return {"sc": F.when(~virtual, change), "vsc": F.when(virtual, change)}


def is_yellow(message: ColumnOrName) -> Column:
    text = F.upper(F.coalesce(_col(message), F.lit("")))
    return (text.contains("YELLOW") & ~text.contains("CLEAR")).cast("int")


# --- qualifying --------------------------------------------------------------------------------------------------
def best_quali_time(*rounds: ColumnOrName) -> Column:
    """First usable time, last round first; zero counts as missing."""
    return F.coalesce(*[F.nullif(_col(r), F.lit(0.0)) for r in rounds])


# --- model comparison ---------------------------------------------------------------------------------------------
def winner(local: ColumnOrName, other: ColumnOrName, *, higher_is_better: bool = False,
           names: tuple[str, str] = ("local_optuna", "global_optuna")) -> Column:
    a, b = _col(local), _col(other)
    better = a > b if higher_is_better else a < b
    return F.when(better, names[0]).otherwise(names[1])


# --- scoring ----------------------------------------------------------------------------------------------------
def scoring_inputs(features: Sequence[str], present: Sequence[str], tyre_life: ColumnOrName = "TyreLife") -> list[Column]:
    """Every model feature: the given column, else its documented default, else what follows from the defaults."""
    life = F.coalesce(_col(tyre_life), F.lit(0.0))

    def value(name: str) -> Column:
        default = F.lit(K.SCORING_DEFAULTS.get(name, 0.0))
        return F.coalesce(F.col(name).cast("double"), default) if name in present else default

    derived = {
        "tyre_ratio": life / F.lit(K.TYRE_LIFE_SCALE),
        "stint_progress": F.least(life / F.lit(K.STINT_LENGTH_SCALE), F.lit(1.0)),
        "degradation_score": value("lap_time_delta") - value("speed_delta") + value("brake_ratio"),
        "aggression_score": value("throttle_mean") * (F.lit(1.0) - value("brake_ratio")),
        "efficiency_score": value("speed_mean") / (value("rpm_mean") + F.lit(1.0)),
        "drs_usage_intensity": value("drs_ratio") * value("speed_max"),
    }
    return [
        (F.coalesce(F.col(f).cast("double"), derived[f]) if f in present else derived[f]).alias(f)
        if f in derived else value(f).alias(f)
        for f in features
    ]


def pit_prompt(lap: ColumnOrName, tyre_life: ColumnOrName, mean_3: ColumnOrName, delta: ColumnOrName,
               needed: ColumnOrName, pit_time: ColumnOrName, lap_time: ColumnOrName) -> Column:
    fields = [lap, tyre_life, mean_3, delta, needed, pit_time, lap_time]
    return F.format_string(K.PIT_PROMPT, *[_col(f).cast("string") for f in fields])


def all_present(columns: Sequence[str]) -> Column:
    return reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])
