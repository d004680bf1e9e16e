"""Small fixtures and brute-force restatements shared by the tests."""

from __future__ import annotations

import numpy as np
import pandas as pd

POLLUTANTS = ["pm25", "pm10", "no2", "so2", "nh3", "co", "o3"]
KNOTS_Y = [0, 50, 100, 200, 300, 400, 500]


def readings(hours: int, stations=(0,), seed: int = 7, gaps: float = 0.0) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    top = {"pm25": 300, "pm10": 450, "no2": 250, "so2": 400, "nh3": 900, "co": 12, "o3": 200}
    rows = []
    for s in stations:
        for h in range(hours):
            if rng.random() < gaps and 0 < h < hours - 1:
                continue
            cell = {p: float(rng.uniform(0, top[p])) if rng.random() > gaps else None for p in POLLUTANTS}
            rows.append({"entity": s, "hour_no": 1000 + h, **cell})
    return pd.DataFrame(rows)


def frame(spark, pdf: pd.DataFrame, schema: str):
    """DataFrame with NaN read as NULL."""
    clean = pdf.astype(object).where(pdf.notna(), None)
    return spark.createDataFrame([tuple(r) for r in clean.itertuples(index=False)], schema)


READING_SCHEMA = "entity long, hour_no long, pm25 double, pm10 double, no2 double, so2 double, nh3 double, co double, o3 double"


def brute_index(pdf: pd.DataFrame) -> pd.DataFrame:
    """Index by pandas on the full hourly grid."""
    from hourglass.functions.piecewise import CONCENTRATION_KNOTS

    out = []
    for e, g in pdf.groupby("entity"):
        s = g.set_index("hour_no")[POLLUTANTS].astype(float).sort_index()
        s = s.reindex(range(s.index.min(), s.index.max() + 1))
        sub = {}
        for p in POLLUTANTS:
            x = s[p].rolling(8, min_periods=6).mean() if p in ("co", "o3") else s[p]
            y = np.interp(x.to_numpy(), CONCENTRATION_KNOTS[p], KNOTS_Y)
            y[np.isnan(x.to_numpy())] = np.nan
            sub[p] = y
        sub = pd.DataFrame(sub, index=s.index)
        valid = (sub.notna().sum(axis=1) >= 3) & sub[["pm25", "pm10"]].notna().any(axis=1)
        hourly = sub.max(axis=1).where(valid)
        out.append(pd.DataFrame({"entity": e, "hour_no": s.index, "hourly_index": hourly.to_numpy(), "index_value": hourly.rolling(24, min_periods=16).mean().to_numpy()}))
    return pd.concat(out, ignore_index=True)
