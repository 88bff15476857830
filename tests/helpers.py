"""Small frames shared by the tests."""

import numpy as np
import pandas as pd

TELEMETRY = {
    "speed_mean": (200, 5), "speed_max": (320, 3), "speed_std": (40, 1), "throttle_mean": (65, 2), "throttle_std": (30, 1),
    "brake_ratio": (0.18, 0.01), "rpm_mean": (11000, 100), "gear_mean": (5.5, 0.1), "drs_ratio": (0.25, 0.02),
}


def stint(n=30, seed=0, driver=1, gp="TestGP", year=2024, session="R"):
    """One driver, one stint, seeded noise."""
    rng = np.random.default_rng(seed)
    laps = np.arange(1, n + 1)
    frame = {
        "year": year, "gp": gp, "session_code": session, "DriverNumber": driver, "Driver": f"D{driver}", "Team": f"T{driver // 2}",
        "LapNumber": laps, "Stint": 1, "Compound": "MEDIUM", "TyreLife": laps.astype(float),
        "LapTime": 80 + 0.1 * rng.normal(0, 0.5, n).cumsum(),
    }
    frame |= {name: rng.normal(mean, spread, n) for name, (mean, spread) in TELEMETRY.items()}
    return pd.DataFrame(frame)


def season(drivers=4, gps=("A", "B", "C"), years=(2022, 2023, 2024), n=20, session="R"):
    parts = [
        stint(n, seed=d * 100 + i * 10 + j, driver=d, gp=g, year=y, session=session)
        for d in range(1, drivers + 1) for i, g in enumerate(gps) for j, y in enumerate(years)
    ]
    return pd.concat(parts, ignore_index=True)


def sorted_rows(df, *by):
    return df.toPandas().sort_values(list(by)).reset_index(drop=True)
