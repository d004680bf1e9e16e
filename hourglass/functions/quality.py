"""Cell-level quality rules as Column expressions.

Each rule set yields, per measure, a reason (NULL when the cell is clean) and the cleaned value; the reasons of a
row are folded into one map so the row is never dropped.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

# Instrument codes, physical bounds of archive columns, plausibility ceilings of live columns.
SENTINELS = (-9999, 9999, -999)
ARCHIVE_BOUNDS = {
    "rh_pct": (0, 100),
    "wd_deg": (0, 360),
    "pm25": (0, None),
    "pm10": (0, None),
    "no_ugm3": (0, None),
    "no2_ugm3": (0, None),
    "nox_ppb": (0, None),
    "nh3_ugm3": (0, None),
    "so2_ugm3": (0, None),
    "co_mgm3": (0, None),
    "ozone_ugm3": (0, None),
    "benzene_ugm3": (0, None),
    "toluene_ugm3": (0, None),
    "xylene_ugm3": (0, None),
    "o_xylene_ugm3": (0, None),
    "eth_benzene_ugm3": (0, None),
    "mp_xylene_ugm3": (0, None),
    "rf_mm": (0, None),
    "tot_rf_mm": (0, None),
    "ws_ms": (0, None),
    "sr_wm2": (0, None),
    "bp_mmhg": (400, 998.9),
}
LIVE_BOUNDS = {
    "pm25": (0, None),
    "pm10": (0, None),
    "no2": (0, None),
    "nox": (0, None),
    "nh3": (0, None),
    "so2": (0, None),
    "co": (0, None),
    "o3": (0, None),
    "humidity": (0, 100),
    "wind_speed": (0, None),
    "solar_radiation": (0, None),
}
LIVE_CEILING = {
    "pm25": 1500.0,
    "pm10": 2000.0,
    "no2": 1000.0,
    "nox": 1000.0,
    "nh3": 1000.0,
    "so2": 1000.0,
    "co": 50.0,
    "o3": 1000.0,
    "temperature": 55.0,
    "humidity": 100.0,
    "wind_speed": 60.0,
    "solar_radiation": 1500.0,
}
LIVE_FLOOR = {"temperature": -5.0}
WEATHER = ("temperature", "humidity", "wind_speed", "solar_radiation")
FILLED = "filled:"


@dataclass(frozen=True)
class Limits:
    """Per-column limits; a column absent from a mapping has no such limit."""

    bounds: Mapping[str, tuple[float | None, float | None]] = field(default_factory=dict)
    floor: Mapping[str, float] = field(default_factory=dict)
    ceiling: Mapping[str, float] = field(default_factory=dict)
    sentinels: Sequence[float] = SENTINELS


ARCHIVE = Limits(bounds=ARCHIVE_BOUNDS)
LIVE = Limits(bounds=LIVE_BOUNDS, floor=LIVE_FLOOR, ceiling=LIVE_CEILING)


def _value(name: str) -> Column:
    """The column as double with NaN read as missing."""
    c = F.col(name).cast("double")
    return F.when(F.isnan(c), None).otherwise(c)


def verbose_reason(name: str, limits: Limits = ARCHIVE) -> Column:
    """Reason text carrying the limit and the rejected value: sentinel first, then the bounds."""
    x = _value(name)
    text = x.cast("string")
    low, high = limits.bounds.get(name, (None, None))
    expr = F.when(x.isin(*[float(s) for s in limits.sentinels]), F.concat(F.lit("SENTINEL_"), text))
    if low is not None:
        expr = expr.when(x < low, F.concat(F.lit(f"OOB_BELOW_{low}(was_"), text, F.lit(")")))
    if high is not None:
        expr = expr.when(x > high, F.concat(F.lit(f"OOB_ABOVE_{high}(was_"), text, F.lit(")")))
    return expr


def short_reason(name: str, limits: Limits = LIVE) -> Column:
    """One of sentinel / bounds / implausible; the first rule that matches names the cell."""
    x = _value(name)
    low, high = limits.bounds.get(name, (None, None))
    expr = F.when(x.isin(*[float(s) for s in limits.sentinels]), "sentinel")
    if low is not None:
        expr = expr.when(x < low, "bounds")
    if high is not None:
        expr = expr.when(x > high, "bounds")
    if name in limits.floor:
        expr = expr.when(x < limits.floor[name], "implausible")
    if name in limits.ceiling:
        expr = expr.when(x > limits.ceiling[name], "implausible")
    return expr


def reason_map(reasons: Mapping[str, Column]) -> Column:
    """Map of column to reason holding only the flagged cells; NULL for a clean row."""
    pairs = [c for name, reason in reasons.items() for c in (F.lit(name), reason)]
    flagged = F.map_filter(F.create_map(*pairs), lambda _, reason: reason.isNotNull())
    return F.when(F.size(flagged) > 0, flagged)


def merge_flags(base: Column, extra: Column) -> Column:
    """Union of two flag maps where the base reason wins."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    left, right = F.coalesce(base, empty), F.coalesce(extra, empty)
    merged = F.map_concat(left, F.map_filter(right, lambda k, _: ~F.map_contains_key(left, k)))
    return F.when(F.size(merged) > 0, merged)
