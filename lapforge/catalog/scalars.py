"""Projections and scalar functions over the lap view."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapforge import constants as K
from lapforge.catalog.registry import ERAS, KEY, TRACKS, WEIGHTS, laps_sql, messages_sql, quali_sql, register
from lapforge.functions import scalars as S
from lapforge.operators import encoding, filters
from lapforge.plans import training
from lapforge.sources import testdata as data

KEYS = [*K.LAP_GROUP, K.LAP_ORDER]
TRACK_LIST = ", ".join(f"'{t}'" for t in TRACKS)
COMPOUND_SQL = """CASE upper(Compound) WHEN 'SOFT' THEN 0.0 WHEN 'MEDIUM' THEN 1.0 WHEN 'HARD' THEN 2.0
    WHEN 'INTERMEDIATE' THEN 3.0 WHEN 'WET' THEN 4.0 ELSE -1.0 END"""


@register("laps_view", laps_sql("SELECT * FROM laps"))
def laps_view(spark, sf_dir):
    return data.laps(spark, sf_dir)


@register("scalar_durations", f"""
WITH d AS (SELECT event_id, ts - date_trunc('hour', ts) AS lap_interval, epoch_us(ts) - epoch_us(date_trunc('hour', ts)) AS us,
  event_id % 7 AS m FROM events)
SELECT event_id, CASE WHEN m <> 0 THEN us / 1000000 END AS lap_seconds, CASE WHEN m <> 0 THEN us / 1000000 * 1000 END AS lap_ms
FROM d""")
def scalar_durations(spark, sf_dir):
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    lap = data.table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_id") % 7 != 0, F.col("ts") - hour).alias("lap"))
    return lap.select("event_id", S.seconds("lap").alias("lap_seconds"), S.milliseconds("lap").alias("lap_ms"))


@register("scalar_null_defaults", laps_sql(f"""
SELECT {KEY}, coalesce(Stint, -1) AS stint_or_unknown, coalesce(Deleted, false) AS deleted_or_not,
  coalesce(CAST(speed_mean AS INTEGER), -1) AS speed_or_unknown FROM laps"""))
def scalar_null_defaults(spark, sf_dir):
    return data.laps(spark, sf_dir).select(
        *KEYS, S.integer_or("Stint").alias("stint_or_unknown"), S.flag_or("Deleted").alias("deleted_or_not"),
        S.integer_or("speed_mean").alias("speed_or_unknown"))


@register("scalar_numeric_coerce", """
SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE CAST(o_custkey AS VARCHAR) END AS DOUBLE)
  AS number FROM orders""")
def scalar_numeric_coerce(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(F.col("o_custkey").cast("string"))
    return data.table(spark, sf_dir, "orders").select("o_orderkey", S.numeric(text).alias("number"))


@register("scalar_compound_code", laps_sql(f"SELECT {KEY}, Compound, CAST({COMPOUND_SQL} AS DOUBLE) AS CompoundEncoded FROM laps"))
def scalar_compound_code(spark, sf_dir):
    return data.laps(spark, sf_dir).select(*KEYS, "Compound", S.compound_code().alias("CompoundEncoded"))


@register("scalar_compound_alias", laps_sql(f"""
SELECT {KEY}, raw, CAST(CASE upper(trim(raw)) WHEN 'SOFT' THEN 0 WHEN 'S' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'M' THEN 1
  WHEN 'HARD' THEN 2 WHEN 'H' THEN 2 WHEN 'INTERMEDIATE' THEN 3 WHEN 'I' THEN 3 WHEN 'WET' THEN 4 WHEN 'W' THEN 4
  ELSE -1 END AS INTEGER) AS code
FROM (SELECT *, CASE WHEN LapNumber % 2 = 0 THEN ' ' || substr(Compound, 1, 1) || ' ' ELSE Compound END AS raw FROM laps) l"""))
def scalar_compound_alias(spark, sf_dir):
    short = F.concat(F.lit(" "), F.substring("Compound", 1, 1), F.lit(" "))
    raw = F.when(F.col("LapNumber") % 2 == 0, short).otherwise(F.col("Compound"))
    return data.laps(spark, sf_dir).select(*KEYS, raw.alias("raw"), S.compound_alias_code(raw).alias("code"))


@register("scalar_compound_name", laps_sql(f"""
SELECT {KEY}, CASE Stint % 5 WHEN 0 THEN 'SOFT' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HARD' ELSE 'UNKNOWN' END AS compound_name
FROM laps"""))
def scalar_compound_name(spark, sf_dir):
    return data.laps(spark, sf_dir).select(*KEYS, S.compound_name(F.col("Stint") % 5).alias("compound_name"))


@register("scalar_regulation_era", laps_sql(f"""
SELECT {KEY}, CAST(CASE year WHEN 1999 THEN 0 WHEN 2000 THEN 1 WHEN 2001 THEN 2 ELSE -1 END AS DOUBLE) AS regulation_era
FROM laps"""))
def scalar_regulation_era(spark, sf_dir):
    return data.laps(spark, sf_dir).select(*KEYS, S.regulation_era("year", ERAS).alias("regulation_era"))


@register("scalar_label_codes", laps_sql(f"""
SELECT {KEY}, CAST(coalesce(s.code, -1) AS INTEGER) AS session_code_encoded, CAST(coalesce(c.code, -1) AS INTEGER) AS compound_encoded
FROM laps LEFT JOIN (SELECT session_code, dense_rank() OVER (ORDER BY session_code) - 1 AS code FROM (SELECT DISTINCT session_code FROM laps) d) s
  USING (session_code)
LEFT JOIN (SELECT Compound, dense_rank() OVER (ORDER BY Compound) - 1 AS code FROM (SELECT DISTINCT Compound FROM laps WHERE Compound IS NOT NULL) d) c
  USING (Compound)"""))
def scalar_label_codes(spark, sf_dir):
    laps = data.laps(spark, sf_dir).select(*KEYS, "Compound")
    coded = encoding.ordinal_encode(laps, "session_code", "session_code_encoded")
    return encoding.ordinal_encode(coded, "Compound", "compound_encoded").drop("Compound")


@register("scalar_one_hot", laps_sql(f"""
SELECT {KEY}, TyreLife, CAST(coalesce(Compound = 'HARD', false) AS INTEGER) AS Compound_HARD,
  CAST(coalesce(Compound = 'INTERMEDIATE', false) AS INTEGER) AS Compound_INTERMEDIATE,
  CAST(coalesce(Compound = 'SOFT', false) AS INTEGER) AS Compound_SOFT, CAST(coalesce(Compound = 'TEST', false) AS INTEGER) AS Compound_TEST,
  CAST(coalesce(Compound = 'WET', false) AS INTEGER) AS Compound_WET, CAST(coalesce(Compound = 'medium', false) AS INTEGER) AS Compound_medium,
  CAST(Compound IS NULL AS INTEGER) AS Compound_nan FROM laps"""))
def scalar_one_hot(spark, sf_dir):
    return encoding.one_hot(data.laps(spark, sf_dir).select(*KEYS, "TyreLife", "Compound"), ["Compound"])


@register("scalar_one_hot_per_track", laps_sql(f"""
SELECT {KEY}, unnest(['Compound_' || coalesce(Compound, 'nan'), 'Team_' || Team]) AS feature FROM laps WHERE gp IN ({TRACK_LIST})"""))
def scalar_one_hot_per_track(spark, sf_dir):
    """The ones of each listed track's own matrix; what a track doesn't have gives it no column."""
    laps = filters.in_tracks(data.laps(spark, sf_dir), TRACKS).select(*KEYS, "Compound", "Team")
    return encoding.one_hot_long(laps, KEYS, ["Compound", "Team"])


@register("scalar_is_raining", laps_sql(f"""
SELECT {KEY}, CAST(coalesce(TRY_CAST(CASE WHEN LapNumber % 4 = 0 THEN 'dry' ELSE CAST(Rainfall AS VARCHAR) END AS DOUBLE), 0) > 0 AS INTEGER)
  AS is_raining FROM laps"""))
def scalar_is_raining(spark, sf_dir):
    text = F.when(F.col("LapNumber") % 4 == 0, "dry").otherwise(F.col("Rainfall").cast("string"))
    return data.laps(spark, sf_dir).select(*KEYS, S.is_raining(text).alias("is_raining"))


@register("scalar_is_neutralized", laps_sql(f"SELECT {KEY}, CAST(is_sc = 1 OR is_vsc = 1 AS INTEGER) AS is_neutralized FROM laps"))
def scalar_is_neutralized(spark, sf_dir):
    return data.laps(spark, sf_dir).select(*KEYS, S.is_neutralized().alias("is_neutralized"))


@register("scalar_temp_delta", laps_sql(f"SELECT {KEY}, TrackTemp - AirTemp AS temp_delta FROM laps"))
def scalar_temp_delta(spark, sf_dir):
    return data.laps(spark, sf_dir).select(*KEYS, (F.col("TrackTemp") - F.col("AirTemp")).alias("temp_delta"))


@register("scalar_clean_infinite", laps_sql(f"""
SELECT {KEY}, CASE WHEN TyreLife % 4 <> 0 THEN LapTime / (TyreLife % 4) END AS ratio,
  coalesce(CASE WHEN TyreLife % 4 <> 0 THEN LapTime / (TyreLife % 4) END, 0) AS filled FROM laps"""))
def scalar_clean_infinite(spark, sf_dir):
    part = F.col("TyreLife") % 4
    raw = F.when(part == 0, float("inf")).otherwise(F.try_divide(F.col("LapTime"), part))
    ratio = S.finite(raw)
    return data.laps(spark, sf_dir).select(*KEYS, ratio.alias("ratio"), F.coalesce(ratio, F.lit(0.0)).alias("filled"))


@register("scalar_session_key", laps_sql(f"SELECT {KEY}, year || '|' || gp || '|' || session_code AS key FROM laps"))
def scalar_session_key(spark, sf_dir):
    return data.laps(spark, sf_dir).select(*KEYS, S.session_key().alias("key"))


@register("scalar_slug", laps_sql(f"SELECT {KEY}, lower(gp) || '_grand_prix_' || lower(Team) AS slug FROM laps"))
def scalar_slug(spark, sf_dir):
    title = F.concat(F.col("gp"), F.lit(" Grand-Prix/"), F.col("Team"))
    return data.laps(spark, sf_dir).select(*KEYS, S.slug(title).alias("slug"))


@register("scalar_default_columns", laps_sql(f"""
SELECT {KEY}, LapTime, Team, CAST({COMPOUND_SQL} AS INTEGER) AS CompoundEncoded, CAST(0 AS INTEGER) AS is_raining,
  CAST(DriverNumber // 2 AS INTEGER) AS team_encoded,
  CAST(CASE session_code WHEN 'Q' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS INTEGER) AS session_code_encoded,
  Compound, LapTime - 85 AS LapTimeResidual
FROM laps WHERE LapTime IS NOT NULL"""))
def scalar_default_columns(spark, sf_dir):
    laps = data.laps(spark, sf_dir).select(*KEYS, "LapTime", "Team", "Compound", (F.col("LapTime") - 85).alias("LapTimeResidual"))
    out = training.prepare_leave_one_out(laps)
    return out.withColumns({c: F.col(c).cast("int") for c in (
        "CompoundEncoded", "is_raining", "team_encoded", "session_code_encoded")})


@register("scalar_feature_select", laps_sql(f"""
SELECT year, gp, session_code, DriverNumber, LapNumber, Stint, TyreLife, Position, is_sc, is_vsc, is_yellow, AirTemp, TrackTemp,
  Humidity, Pressure, Rainfall, WindSpeed FROM laps"""))
def scalar_feature_select(spark, sf_dir):
    laps = data.laps(spark, sf_dir)
    return laps.select(*K.LAP_GROUP, *training.available(laps, K.GLOBAL_CANDIDATES))


@register("scalar_feature_exclude", laps_sql("""
SELECT * EXCLUDE (LapTime, gp, Driver, Team) FROM laps"""))
def scalar_feature_exclude(spark, sf_dir):
    laps = data.laps(spark, sf_dir)
    return laps.select(*training.all_except(laps))


@register("scalar_sample_weight", laps_sql(f"""
SELECT {KEY}, CAST(CASE year WHEN 1999 THEN 1 WHEN 2000 THEN 2 ELSE 1 END AS DOUBLE) AS weight FROM laps"""))
def scalar_sample_weight(spark, sf_dir):
    return data.laps(spark, sf_dir).select(*KEYS, S.year_weight("year", WEIGHTS).alias("weight"))


@register("scalar_pit_label", laps_sql(f"""
SELECT {KEY}, CAST(coalesce(Stint + TyreLife > 20, false) AS INTEGER) AS pit_label FROM laps"""))
def scalar_pit_label(spark, sf_dir):
    return data.laps(spark, sf_dir).select(*KEYS, S.pit_label(F.col("Stint") + F.col("TyreLife")).alias("pit_label"))


@register("scalar_race_phase", laps_sql(f"""
SELECT {KEY}, p, CASE WHEN p > 0 AND p <= CAST(0.2 AS DOUBLE) THEN 'Início (0-20%)' WHEN p > CAST(0.2 AS DOUBLE) AND p <= CAST(0.4 AS DOUBLE) THEN '20-40%'
  WHEN p > CAST(0.4 AS DOUBLE) AND p <= CAST(0.6 AS DOUBLE) THEN '40-60%' WHEN p > CAST(0.6 AS DOUBLE) AND p <= CAST(0.8 AS DOUBLE) THEN '60-80%'
  WHEN p > CAST(0.8 AS DOUBLE) AND p <= CAST(1.01 AS DOUBLE) THEN 'Fim (80-100%)' END AS race_phase
FROM (SELECT *, (LapNumber % 12) / 10 AS p FROM laps) l"""))
def scalar_race_phase(spark, sf_dir):
    p = (F.col("LapNumber") % 12) / 10
    return data.laps(spark, sf_dir).select(*KEYS, p.alias("p"), S.race_phase(p).alias("race_phase"))


@register("scalar_message_flags", messages_sql("""
SELECT session, seq, CASE WHEN NOT virt THEN change END AS sc, CASE WHEN virt THEN change END AS vsc, yellow FROM (
  SELECT session, seq, contains(upper(Message), 'VIRTUAL') AS virt,
    CAST(contains(upper(Message), 'YELLOW') AND NOT contains(upper(Message), 'CLEAR') AS INTEGER) AS yellow,
    CAST(CASE WHEN Category = 'SafetyCar' THEN CASE WHEN Status = 'DEPLOYED' OR contains(upper(Message), 'DEPLOYED') THEN 1
      WHEN Status = 'ENDING' OR contains(upper(Message), 'IN THIS LAP') THEN 0 END END AS INTEGER) AS change
  FROM (SELECT session, seq, Category, Status, coalesce(Message, '') AS Message FROM messages) m) x"""))
def scalar_message_flags(spark, sf_dir):
    change = S.neutralization_change("Category", "Status", "Message")
    return data.race_control(spark, sf_dir).select(
        "session", "seq", change["sc"].alias("sc"), change["vsc"].alias("vsc"), S.is_yellow("Message").alias("yellow"))


@register("scalar_best_quali_time", quali_sql("""
SELECT year, gp, Driver, coalesce(nullif(Q3, 0), nullif(Q2, 0), nullif(Q1, 0)) AS best FROM quali"""))
def scalar_best_quali_time(spark, sf_dir):
    return data.quali(spark, sf_dir).select("year", "gp", "Driver", S.best_quali_time("Q3", "Q2", "Q1").alias("best"))


@register("scalar_pit_prompt", laps_sql(f"""
SELECT {KEY}, md5(chr(10) || '    Voce é um engenheiro de corrida de F1 e precisa explicar a decisão de pit stop para a equipe.' || chr(10)
  || '    Dados atuais:' || chr(10) || '    - Volta : ' || LapNumber || chr(10)
  || '    - Vida do pneu: ' || CAST(TyreLife AS INTEGER) || chr(10)
  || '    - Tempo médio das ultimas 3 voltas: ' || CAST(80 AS INTEGER) || chr(10)
  || '    - Delta do tempo da ultima volta: ' || CAST(TyreLife - 4 AS INTEGER) || chr(10)
  || '    - Pit stop necessário: ' || CAST(TyreLife > 6 AS VARCHAR) || chr(10)
  || '    - Tempo previsto para o pit stop: ' || 20 || chr(10)
  || '    - Tempo previsto para a volta: ' || CAST(floor(coalesce(LapTime, 80)) AS INTEGER) || chr(10)
  || '    Explique de forma profissional e clara para a equipe. Focando que nosso piloto ganhe a corrida.print' || chr(10) || '    ') AS prompt_md5
FROM laps"""))
def scalar_pit_prompt(spark, sf_dir):
    life = F.col("TyreLife").cast("int")
    prompt = S.pit_prompt(
        "LapNumber", life, F.lit(80), life - 4, life > 6, F.lit(20), F.floor(F.coalesce("LapTime", F.lit(80.0))).cast("int"))
    return data.laps(spark, sf_dir).select(*KEYS, F.md5(prompt).alias("prompt_md5"))


@register("scalar_inference_defaults", laps_sql(f"""
SELECT {KEY}, TyreLife, CAST(80 AS DOUBLE) AS lap_time_mean_3, CAST(0 AS DOUBLE) AS lap_time_delta, Position,
  coalesce(speed_mean, 180) AS speed_mean, CAST(300 AS DOUBLE) AS speed_max, brake_ratio, CAST(9000 AS DOUBLE) AS rpm_mean,
  CAST(0.3 AS DOUBLE) AS drs_ratio, TyreLife / 50 AS tyre_ratio, least(TyreLife / 20, 1) AS stint_progress,
  brake_ratio AS degradation_score, CAST(50 AS DOUBLE) * (1 - brake_ratio) AS aggression_score,
  coalesce(speed_mean, 180) / 9001 AS efficiency_score, CAST(0.3 AS DOUBLE) * 300 AS drs_usage_intensity,
  CAST(0 AS DOUBLE) AS consistency_score FROM laps"""))
def scalar_inference_defaults(spark, sf_dir):
    laps = data.laps(spark, sf_dir).select(*KEYS, "TyreLife", "Position", "speed_mean", "brake_ratio")
    features = ["TyreLife", "lap_time_mean_3", "lap_time_delta", "Position", "speed_mean", "speed_max", "brake_ratio",
                "rpm_mean", "drs_ratio", "tyre_ratio", "stint_progress", "degradation_score", "aggression_score",
                "efficiency_score", "drs_usage_intensity", "consistency_score"]
    return laps.select(*KEYS, *S.scoring_inputs(features, laps.columns))
