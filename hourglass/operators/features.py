"""Leakage-safe feature matrix: lags, trailing statistics, calendar fields, cross-entity signals and lead targets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.calendar import calendar_columns, local_time
from .grid import HOUR, with_label
from .ordered import BLOCK_HOURS, BLOCK_ROWS, Frames, row_index, with_frames

# Lags, window widths and horizons of the feature set.
INDEX_LAGS = (1, 2, 3, 6, 12, 24, 48, 72, 168)
MEASURE_LAGS = (1, 6, 12, 24)
WEATHER_LAGS = (1, 6, 24)
STAT_WINDOWS = (3, 6, 12, 24)
WEATHER_WINDOWS = (6, 24)
HORIZONS = (1, 6, 24)
MEASURES = ("pm25", "pm10", "no2", "nox", "so2", "co", "o3")
WEATHER_NAMES = {
    "temp": "temperature",
    "humidity": "humidity",
    "wind_speed": "wind_speed",
    "solar_rad": "solar_radiation",
}


def statistic_columns(f: Frames, source: str, prefix: str, widths: Sequence[int]) -> dict[str, Column]:
    """Trailing mean, standard deviation, minimum and maximum; at least half of the window must be present."""
    out: dict[str, Column] = {}
    for w in widths:
        need = max(1, w // 2)
        out[f"{prefix}_roll_mean_{w}h"] = f.mean(source, w, need)
        out[f"{prefix}_roll_std_{w}h"] = f.std(source, w, max(2, need))
        out[f"{prefix}_roll_min_{w}h"] = f.min(source, w, need)
        out[f"{prefix}_roll_max_{w}h"] = f.max(source, w, need)
    return out


def entity_features(
    grid: DataFrame,
    by: Sequence[str],
    *,
    index: str = "index_value",
    measures: Sequence[str] = MEASURES,
    weather: Mapping[str, str] = WEATHER_NAMES,
    horizons: Sequence[int] = HORIZONS,
    window: tuple[int, int] | None = None,
    block: int | None = BLOCK_HOURS,
) -> DataFrame:
    """Per-entity features and targets in one window pass (one sort: every frame shares partitioning and order).

    Frames are clock-hour ranges, so the rows need not be densified. ``window`` keeps issue hours in [first, last]
    after the frames, and the current index is required.
    """
    present = {c for c in (*measures, *weather.values()) if c in grid.columns}
    base = grid.select(*by, HOUR, index, *sorted(present))
    nothing = F.lit(None).cast("double")

    def points(source: str, prefix: str, lags: Sequence[int]) -> dict[str, tuple[str, int]]:
        return {f"{prefix}_lag_{k}h": (source, -k) for k in lags}

    # values at single hours: one frame for each distance gives all columns there at once
    spots = {**points(index, "aqi", INDEX_LAGS), **{f"target_aqi_{h}h": (index, h) for h in horizons}}
    for m in (m for m in measures if m in present):
        spots.update(points(m, m, MEASURE_LAGS))
    for short, c in weather.items():
        spots.update(points(c, short, WEATHER_LAGS) if c in present else {})
    if "pm25" in present:
        spots.update({f"target_pm25_{h}h": ("pm25", h) for h in horizons})
    distances = sorted({k for _, k in spots.values()})
    spot = lambda k: f"__back_{-k}" if k < 0 else f"__ahead_{k}"

    def build(f: Frames) -> dict[str, Column]:
        out = {"aqi_curr": F.col(index), **{f"{m}_now": F.col(m) for m in measures if m in present}}
        for k in distances:
            out[spot(k)] = f.at(F.struct(*sorted({c for c, d in spots.values() if d == k})), k)
        out.update(statistic_columns(f, index, "aqi", STAT_WINDOWS))
        if "pm25" in present:
            out.update(statistic_columns(f, "pm25", "pm25", STAT_WINDOWS))
        for short, c in ((s, c) for s, c in weather.items() if c in present):
            out[f"{short}_now"] = F.col(c)
            out.update({f"{short}_roll_mean_{w}h": f.mean(c, w, 1) for w in WEATHER_WINDOWS})
        return out

    names = ["aqi_curr", *[f"aqi_lag_{k}h" for k in INDEX_LAGS]]
    for m in measures:
        names += [f"{m}_curr", *[f"{m}_lag_{k}h" for k in MEASURE_LAGS]]
    names += [f"{p}_roll_{s}_{w}h" for p in ("aqi", "pm25") for w in STAT_WINDOWS for s in ("mean", "std", "min", "max")]
    for short in weather:
        names += [f"{short}_curr", *[f"{short}_lag_{k}h" for k in WEATHER_LAGS], *[f"{short}_roll_mean_{w}h" for w in WEATHER_WINDOWS]]
    names += [f"target_{p}_{h}h" for p in ("aqi", "pm25") for h in horizons]
    keep = F.col(index).isNotNull()
    if window is not None:
        keep = keep & F.col(HOUR).between(*window)
    framed = with_frames(base, by, HOUR, build, behind=max(INDEX_LAGS), ahead=max(horizons), block=block, keep=keep, spread=True)
    made = set(framed.columns)

    def cell(name: str) -> Column:
        if name in spots:
            source, k = spots[name]
            return F.col(spot(k))[source].alias(name)
        inner = name.removesuffix("_curr") + "_now" if name != "aqi_curr" and name.endswith("_curr") else name
        return (F.col(inner) if inner in made else nothing).alias(name)

    return framed.select(*by, HOUR, *[cell(n) for n in names])


def leave_one_out(
    df: DataFrame, on: Sequence[str], values: Mapping[str, str], *, null_when_alone: bool = False
) -> DataFrame:
    """Mean of the other entities' values at the same time (``values``: source -> output).

    The per-time totals are pre-aggregated and joined back, so an hour shared by millions of entities is summed
    map-side first. Alone at its hour an entity gets 0, or NULL with ``null_when_alone``.
    """
    totals = df.groupBy(*on).agg(
        *[F.sum(c).alias(f"__{c}_sum") for c in values], *[F.count(c).alias(f"__{c}_n") for c in values]
    )
    joined = df.join(totals, list(on))
    return joined.select(*df.columns, *[others_mean(c, null_when_alone=null_when_alone).alias(n) for c, n in values.items()])


def others_mean(source: str, *, null_when_alone: bool = False) -> Column:
    """(total - own) / (count - own present) from the columns ``__<source>_sum`` and ``__<source>_n``."""
    own = F.col(source)
    others = F.coalesce(F.col(f"__{source}_n"), F.lit(0)) - own.isNotNull().cast("int")
    mean = (F.col(f"__{source}_sum") - F.coalesce(own, F.lit(0.0))) / others
    return F.when(others > 0, mean) if null_when_alone else F.when(others > 0, mean).otherwise(F.lit(0.0))


def neighbour_values(
    df: DataFrame, entity: str, ts: str, neighbours: Mapping[object, object] | DataFrame, values: Mapping[str, str],
    *, lookup: DataFrame | None = None
) -> DataFrame:
    """Values of a fixed neighbour entity at the same time; ``neighbours`` is a small mapping or an (entity, neighbour) table.

    The values come from ``lookup`` when given, else from ``df`` itself."""
    if isinstance(neighbours, DataFrame):
        paired = df.join(neighbours.withColumnRenamed("neighbour", "__near"), entity, "left")
    else:
        chain = F.lit(None).cast(df.schema[entity].dataType)
        for left, right in neighbours.items():
            chain = F.when(F.col(entity) == F.lit(left), F.lit(right)).otherwise(chain)
        paired = df.withColumn("__near", chain)
    near = (df if lookup is None else lookup).select(F.col(entity).alias("__near"), ts, *[F.col(c).alias(n) for c, n in values.items()])
    return paired.join(near, ["__near", ts], "left").drop("__near")


def network_features(
    matrix: DataFrame, grid: DataFrame, entity: str, neighbours: Mapping[object, object] | DataFrame, *, index: str = "index_value"
) -> DataFrame:
    """Cross-entity signals from the values of the hour before.

    They are read from the grid shifted by one hour, not from the framed matrix, so the wide frames are computed once.
    """
    values = {index: "aqi_lag_1h", "pm25": "pm25_lag_1h"}
    before = grid.select(entity, (F.col(HOUR) + 1).alias(HOUR), *[F.col(s).alias(n) for s, n in values.items()])
    totals = before.groupBy(HOUR).agg(
        *[F.sum(n).alias(f"__{n}_sum") for n in values.values()],
        *[F.count(n).alias(f"__{n}_n") for n in values.values()],
        F.max("aqi_lag_1h").alias("network_max_aqi_lag_1h"),
        F.min("aqi_lag_1h").alias("network_min_aqi_lag_1h"),
    )
    near = {"aqi_lag_1h": "top_neighbor_aqi_lag_1h", "pm25_lag_1h": "top_neighbor_pm25_lag_1h"}
    joined = neighbour_values(matrix.join(totals, HOUR, "left"), entity, HOUR, neighbours, near, lookup=before)
    means = [others_mean(n).alias(f"network_mean_{n}") for n in values.values()]
    return joined.select("*", *means).drop(*[f"__{n}_{k}" for n in values.values() for k in ("sum", "n")])


def feature_matrix(
    grid: DataFrame,
    entity: str,
    neighbours: Mapping[object, object] | DataFrame,
    *,
    index: str = "index_value",
    window: tuple[int, int] | None = None,
    zone: str | None = None,
    block: int | None = BLOCK_HOURS,
) -> DataFrame:
    """The full matrix: one call for training and for serving, so the two cannot drift apart.
    """
    own = entity_features(grid, [entity], index=index, window=window, block=block)
    base = network_features(own, grid, entity, neighbours, index=index)
    labelled = with_label(base)
    return labelled.select("*", *[c.alias(n) for n, c in calendar_columns(local_time("ts", zone)).items()])


# Row-based lags and windows of the long-horizon set.
ROW_LAGS = {"aqi_lag_96h": ("aqi_curr", 96), "aqi_lag_120h": ("aqi_curr", 120), "aqi_lag_144h": ("aqi_curr", 144),
            "pm25_lag_48h": ("pm25_curr", 48), "pm25_lag_72h": ("pm25_curr", 72), "pm25_lag_168h": ("pm25_curr", 168)}
ROW_MEANS = {"aqi": (48, 72, 168), "pm25": (72, 168)}
ROW_STDS = {"aqi": (72, 168)}


def long_horizon_features(matrix: DataFrame, by: Sequence[str], *, block: int = BLOCK_ROWS) -> DataFrame:
    """Lags and windows counted in *rows that have an index*, not in clock hours, plus deltas and the network lag.

    Rows are numbered per entity first; the frames then run over blocks of row numbers with a halo of 168 rows.
    """
    numbered = row_index(matrix, by, HOUR, "__row")

    def build(f: Frames) -> dict[str, Column]:
        out = {name: f.at(source, -k) for name, (source, k) in ROW_LAGS.items()}
        for prefix, widths in ROW_MEANS.items():
            out.update({f"{prefix}_roll_mean_{w}h": f.mean(f"{prefix}_curr", w, w // 4) for w in widths})
        for prefix, widths in ROW_STDS.items():
            out.update({f"{prefix}_roll_std_{w}h": f.std(f"{prefix}_curr", w, w // 4) for w in widths})
        for name in ("aqi", "pm25"):
            if f"network_mean_{name}_lag_1h" in matrix.columns:
                out[f"network_mean_{name}_lag_24h"] = f.at(f"network_mean_{name}_lag_1h", -23)
        return out

    framed = with_frames(numbered, by, "__row", build, behind=168, block=block, spread=True)
    deltas = {
        "aqi_delta_24h": F.col("aqi_curr") - F.col("aqi_lag_24h"),
        "aqi_delta_48h": F.col("aqi_curr") - F.col("aqi_lag_48h"),
        "aqi_delta_72h": F.col("aqi_curr") - F.col("aqi_lag_72h"),
        "pm25_delta_24h": F.col("pm25_curr") - F.col("pm25_lag_24h"),
    }
    return framed.select("*", *[c.alias(n) for n, c in deltas.items()]).drop("__row")


def seasonal_baselines(matrix: DataFrame, by: Sequence[str], *, block: int = BLOCK_ROWS) -> DataFrame:
    """Seasonal persistence per horizon by row shifts (23, 18, 0) on rows that have an index."""
    numbered = row_index(matrix, by, HOUR, "__row")
    build = lambda f: {"pred_seasonal_1h": f.at("aqi_curr", -23), "pred_seasonal_6h": f.at("aqi_curr", -18)}
    framed = with_frames(numbered, by, "__row", build, behind=23, block=block)
    return framed.withColumn("pred_seasonal_24h", F.col("aqi_curr")).drop("__row")


def _long(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Unpivot features to (feature, v), exploding inside the row so nothing is shuffled."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])
    return df.select(*keep, F.inline(cells))


def manifest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Group letter, present count and missing share per feature."""
    counts = _long(df, columns).groupBy("feature").agg(
        F.count("v").alias("non_null"), (100.0 * (F.count(F.lit(1)) - F.count("v")) / F.count(F.lit(1))).alias("missing_pct")
    )
    name = F.col("feature")
    group = (
        F.when(name.rlike("^(network_|top_neighbor_)"), "G")
        .when(name.rlike("^(temp|humidity|wind_speed|solar_rad)_"), "F")
        .when(name.rlike("^is_(winter|summer|monsoon|post_monsoon)$"), "E")
        .when(name.rlike("^(hour|day_of_|month|is_weekend|sin_|cos_)"), "D")
        .when(name.contains("_roll_"), "C")
        .when(name.startswith("aqi_"), "A")
        .otherwise("B")
    )
    return counts.select("feature", group.alias("feature_group"), "non_null", "missing_pct")


def correlation_ranking(
    df: DataFrame, columns: Sequence[str], targets: Mapping[int, str], *, min_pairs: int = 100, top: int | None = None
) -> DataFrame:
    """Pearson correlation of each feature with each target over complete pairs, ranked by absolute value.

    The ranking runs over one row per (horizon, feature), a count fixed by the feature list.
    """
    pairs = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(c).cast("double").alias("y")) for h, c in targets.items()])
    long = _long(df.select("*", pairs.alias("__targets")), columns, ["__targets"]).where("v IS NOT NULL")
    both = long.select("feature", "v", F.inline("__targets")).where("y IS NOT NULL")
    stats = both.groupBy("horizon", "feature").agg(F.count(F.lit(1)).alias("pairs"), F.corr("v", "y").alias("r"))
    stats = stats.where(F.col("pairs") > min_pairs).withColumn("abs_r", F.abs("r"))
    from pyspark.sql import Window

    w = Window.partitionBy("horizon").orderBy(F.round("abs_r", 9).desc(), "feature")
    ranked = stats.withColumn("position", F.row_number().over(w))
    return ranked if top is None else ranked.where(F.col("position") <= top)


def target_availability(df: DataFrame, entity: str, ts: str, targets: Mapping[str, str]) -> DataFrame:
    """Present targets by (entity, month), entity, month and in total, in one pass over grouping sets."""
    flat = df.select(entity, F.month(ts).alias("month"), *targets.values())
    sets = [[F.col(entity), F.col("month")], [F.col(entity)], [F.col("month")], []]
    aggs = [F.count(F.lit(1)).alias("n"), *[F.count(c).alias(n) for n, c in targets.items()]]
    return flat.groupingSets(sets, F.col(entity), F.col("month")).agg(*aggs).select(entity, "month", "n", *targets)
