"""Explicit read schemas; nothing is inferred."""

from __future__ import annotations

LAPS = """
    year int, gp string, session_code string, Driver string, DriverNumber int, Team string, LapNumber int,
    Stint double, Compound string, TyreLife double, Position double, TrackStatus string, LapTime double,
    PitOutTime double, PitInTime double, Deleted boolean,
    speed_mean double, speed_max double, speed_std double, throttle_mean double, throttle_std double,
    brake_ratio double, rpm_mean double, gear_mean double, drs_ratio double,
    AirTemp double, TrackTemp double, Humidity double, Pressure double, Rainfall double, WindSpeed double,
    WindDirection double, is_sc int, is_vsc int, is_yellow int,
    quali_position int, grid_position int, gap_to_pole_ms double
"""

CHECKPOINT = "completed array<string>, failed array<string>"
OUTCOMES = "key string, status string, n_rows bigint, seq bigint"
FEATURE_LIST = "numeric_features array<string>, categorical_features array<string>, all_features_in_order array<string>"
RUNS = "run_id string, kind string, key string, value string"
LOCAL_RESULTS = "gp string, rmse_local_optuna double, mae_local_optuna double, r2_local_optuna double, rows bigint"
IMPORTANCE = "feature string, importance double"
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
