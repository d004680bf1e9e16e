"""Index from concentrations: hourly maximum of sub-indices, trailing means, rule-based forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.piecewise import EIGHT_HOUR_POLLUTANTS, POLLUTANTS, nowcast_weight, sub_index, valid_index
from .grid import HOUR, fill_grid
from .ordered import BLOCK_HOURS, Frames, with_frames

INDEX_HOURS, INDEX_MIN = 24, 16
GAS_HOURS, GAS_MIN = 8, 6


def _ensure(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [F.lit(None).cast("double").alias(n) for n in names if n not in df.columns]
    return df.select("*", *missing) if missing else df


def _sub_indices(smoothed: dict[str, str]) -> dict[str, Column]:
    return {p: sub_index(p, smoothed.get(p, p)) for p in POLLUTANTS}


def hourly_index(
    readings: DataFrame, by: Sequence[str], *, min_pollutants: int = 3, out: str = "hourly_index", block: int | None = BLOCK_HOURS
) -> DataFrame:
    """Maximum sub-index per hour of the gap-free grid; two gases enter through their trailing 8-hour mean (>= 6 hours)."""
    grid = _ensure(fill_grid(readings, by), POLLUTANTS)
    gases = {p: f"__{p}_mean" for p in EIGHT_HOUR_POLLUTANTS}
    framed = with_frames(
        grid, by, HOUR, lambda f: {c: f.mean(p, GAS_HOURS, GAS_MIN) for p, c in gases.items()}, behind=GAS_HOURS, block=block
    )
    subs = _sub_indices(gases)
    present = {p: gases.get(p, p) for p in POLLUTANTS}
    value = F.when(valid_index(present, min_pollutants), F.greatest(*subs.values()))
    return framed.withColumn(out, value).drop(*gases.values())


def trailing_index(
    hourly: DataFrame,
    by: Sequence[str],
    *,
    value: str = "hourly_index",
    out: str = "index_value",
    hours: int = INDEX_HOURS,
    min_valid: int = INDEX_MIN,
    block: int | None = BLOCK_HOURS,
) -> DataFrame:
    """Trailing mean of the hourly index; needs the gap-free grid because it also has a value on gap hours."""
    return with_frames(hourly, by, HOUR, lambda f: {out: f.mean(value, hours, min_valid)}, behind=hours, block=block)


def index_of_means(
    readings: DataFrame, by: Sequence[str], *, min_pollutants: int = 3, out: str = "index_value", block: int | None = BLOCK_HOURS
) -> DataFrame:
    """Alternative convention: trailing mean of each concentration first (24 h, gases 8 h), then the maximum sub-index."""
    grid = _ensure(fill_grid(readings, by), POLLUTANTS)
    names = {p: f"__{p}_mean" for p in POLLUTANTS}

    def means(f: Frames) -> dict[str, Column]:
        spans = {p: (GAS_HOURS, GAS_MIN) if p in EIGHT_HOUR_POLLUTANTS else (INDEX_HOURS, INDEX_MIN) for p in POLLUTANTS}
        return {names[p]: f.mean(p, *spans[p]) for p in POLLUTANTS}

    framed = with_frames(grid, by, HOUR, means, behind=INDEX_HOURS, block=block)
    subs = _sub_indices(names)
    return framed.withColumn(out, F.when(valid_index(names, min_pollutants), F.greatest(*subs.values()))).drop(*names.values())


def nowcast(grid: DataFrame, by: Sequence[str], value: str, out: str, *, hours: int = 12, block: int | None = BLOCK_HOURS) -> DataFrame:
    """Weighted mean of the last 12 hours, weight (min/max, at least 0.5) to the power of age; 2 of the last 3 needed."""

    def build(f: Frames) -> dict[str, Column]:
        window = f.trailing(hours)
        cells = {f"__ago{i}": f.at(value, -i) for i in range(hours)}
        return {"__lo": F.min(value).over(window), "__hi": F.max(value).over(window), **cells}

    framed = with_frames(grid, by, HOUR, build, behind=hours, block=block)
    weight = nowcast_weight(F.col("__lo"), F.col("__hi"))
    cells = [F.col(f"__ago{i}") for i in range(hours)]
    weights = [F.when(c.isNotNull(), F.pow(weight, F.lit(float(i)))).otherwise(0.0) for i, c in enumerate(cells)]
    top = sum((F.coalesce(w * c, F.lit(0.0)) for w, c in zip(weights, cells, strict=True)), F.lit(0.0))
    recent = sum((c.isNotNull().cast("int") for c in cells[:3]), F.lit(0))
    result = F.when(recent >= 2, top / sum(weights, F.lit(0.0)))
    return framed.withColumn(out, result).drop("__lo", "__hi", *[f"__ago{i}" for i in range(hours)])


def window_update_columns(f: Frames, value: str, horizons: Sequence[int], *, hours: int, min_valid: int) -> dict[str, Column]:
    """Frame expressions of the rule forecast: keep the known hours that stay in the window, hold the current hour."""
    out = {}
    current = F.col(value)
    for h in horizons:
        keep = hours - h
        known, n = F.lit(0.0), F.lit(0)
        if keep > 0:
            frame = f.trailing(keep)
            known, n = F.coalesce(F.sum(value).over(frame), F.lit(0.0)), F.count(value).over(frame)
        count = n + h
        out[f"window_update_{h}h"] = F.when(current.isNotNull() & (count >= min_valid), (known + F.lit(h) * current) / count)
    return out


def window_update(
    hourly: DataFrame,
    by: Sequence[str],
    horizons: Sequence[int] = (1, 6, 24),
    *,
    value: str = "hourly_index",
    hours: int = INDEX_HOURS,
    min_valid: int = INDEX_MIN,
    block: int | None = BLOCK_HOURS,
) -> DataFrame:
    """Rule forecast of the trailing index at each horizon."""
    build = lambda f: window_update_columns(f, value, horizons, hours=hours, min_valid=min_valid)
    return with_frames(hourly, by, HOUR, build, behind=hours, block=block)


def window_update_references(
    hourly: DataFrame, stored: DataFrame, by: Sequence[str], *, tolerance: float = 0.01, horizons: Sequence[int] = (1, 6, 24)
) -> DataFrame:
    """Rule forecasts per issue hour with the reason when they are unusable.

    The hourly series must rebuild the stored index within ``tolerance``; ``stored`` holds (by, hour_no, stored_index).
    """
    rebuilt = trailing_index(window_update(hourly, by, horizons), by, out="rebuilt")
    joined = stored.join(rebuilt, [*by, HOUR], "left")
    first = F.col(f"window_update_{horizons[0]}h")
    off = F.col("rebuilt").isNull() | (F.abs(F.col("rebuilt") - F.col("stored_index")) > tolerance)
    reason = F.when(first.isNull(), "no valid current hourly index or too few valid hours").when(
        off, "rebuilt index disagrees with the stored index"
    )
    values = [F.when(reason.isNull(), F.col(f"window_update_{h}h")).alias(f"window_update_{h}h") for h in horizons]
    return joined.select(*by, HOUR, "stored_index", *values, reason.alias("reason"))
