"""Feature matrix, baselines, fills and exogenous joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import exogenous as ex, features as ft, ordered as od
from ..operators.grid import HOUR, with_label
from . import bindings as b
from .catalog import Tables, query

_W = "OVER (PARTITION BY entity ORDER BY ts{frame})"


def _over(rows: int | None = None) -> str:
    frame = "" if rows is None else f" ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW"
    return _W.format(frame=frame)


def _lag(x: str, k: int) -> str:
    return f"lag({x}, {k}) {_over()}"


def _stat(fn: str, x: str, w: int, need: int) -> str:
    return f"CASE WHEN count({x}) {_over(w)} >= {need} THEN {fn}({x}) {_over(w)} END"


def _feature_sql() -> tuple[str, list[str]]:
    cols: dict[str, str] = {"aqi_curr": "index_value"}
    cols.update({f"aqi_lag_{k}h": _lag("index_value", k) for k in ft.INDEX_LAGS})
    for m in ft.MEASURES:
        known = m in b.MEASURED
        cols[f"{m}_curr"] = m if known else "NULL::DOUBLE"
        cols.update({f"{m}_lag_{k}h": _lag(m, k) if known else "NULL::DOUBLE" for k in ft.MEASURE_LAGS})
    for prefix, x in (("aqi", "index_value"), ("pm25", "pm25")):
        for w in ft.STAT_WINDOWS:
            need = max(1, w // 2)
            for fn, name in (("avg", "mean"), ("stddev_samp", "std"), ("min", "min"), ("max", "max")):
                cols[f"{prefix}_roll_{name}_{w}h"] = _stat(fn, x, w, max(2, need) if name == "std" else need)
    for short in ft.WEATHER_NAMES:
        cols[f"{short}_curr"] = "NULL::DOUBLE"
        cols.update({f"{short}_lag_{k}h": "NULL::DOUBLE" for k in ft.WEATHER_LAGS})
        cols.update({f"{short}_roll_mean_{w}h": "NULL::DOUBLE" for w in ft.WEATHER_WINDOWS})
    for prefix, x in (("aqi", "index_value"), ("pm25", "pm25")):
        cols.update({f"target_{prefix}_{h}h": f"lead({x}, {h}) {_over()}" for h in ft.HORIZONS})
    body = ", ".join(f"{sql} AS {name}" for name, sql in cols.items())
    return body, list(cols)


FRAME_SQL, FRAME_COLS = _feature_sql()
_NET = [
    "network_mean_aqi_lag_1h", "network_mean_pm25_lag_1h", "network_min_aqi_lag_1h", "network_max_aqi_lag_1h",
    "top_neighbor_aqi_lag_1h", "top_neighbor_pm25_lag_1h",
]
# the next station is the fixed neighbour, the last one's is the first
_NEAR_SQL = "nb AS (SELECT DISTINCT user_id // 50 AS entity, (user_id // 50 + 1) % ((SELECT max(user_id) FROM events) // 50 + 1) AS near FROM events)"


def neighbours(t: Tables):
    """(entity, neighbour), one row per station."""
    known = b.station_events(t).select("entity").distinct()
    top = b.station_events(t).agg(F.max("entity") + 1).scalar()
    return known.withColumn("neighbour", F.pmod(F.col("entity") + 1, top))


_NET_SQL = f"""net AS (SELECT ts + INTERVAL 1 HOUR AS ts, sum(index_value) AS sa, count(index_value) AS na, sum(pm25) AS sp, count(pm25) AS np,
      min(index_value) AS lo, max(index_value) AS hi FROM idx GROUP BY ts),
  {_NEAR_SQL}, near AS (SELECT nb.entity, ts + INTERVAL 1 HOUR AS ts, index_value AS top_neighbor_aqi_lag_1h,
      pm25 AS top_neighbor_pm25_lag_1h FROM idx JOIN nb ON nb.near = idx.entity)"""
_LOO = """CASE WHEN coalesce(na, 0) - (f.aqi_lag_1h IS NOT NULL)::INT > 0 THEN (sa - coalesce(f.aqi_lag_1h, 0)) / (na - (f.aqi_lag_1h IS NOT NULL)::INT) ELSE 0 END AS network_mean_aqi_lag_1h,
    CASE WHEN coalesce(np, 0) - (f.pm25_lag_1h IS NOT NULL)::INT > 0 THEN (sp - coalesce(f.pm25_lag_1h, 0)) / (np - (f.pm25_lag_1h IS NOT NULL)::INT) ELSE 0 END AS network_mean_pm25_lag_1h"""
_CAL = """(isodow(ts) - 1)::INT AS day_of_week, hour(ts)::INT AS hour, month(ts)::INT AS month, dayofyear(ts)::INT AS day_of_year, (isodow(ts) >= 6)::INT AS is_weekend,
      sin(2 * pi() * hour(ts) / 24) AS sin_hour, cos(2 * pi() * hour(ts) / 24) AS cos_hour,
      sin(2 * pi() * (isodow(ts) - 1) / 7) AS sin_dow, cos(2 * pi() * (isodow(ts) - 1) / 7) AS cos_dow,
      sin(2 * pi() * (month(ts) - 1) / 12) AS sin_month, cos(2 * pi() * (month(ts) - 1) / 12) AS cos_month,
      sin(2 * pi() * (dayofyear(ts) - 1) / 365.25) AS sin_doy, cos(2 * pi() * (dayofyear(ts) - 1) / 365.25) AS cos_doy,
      (month(ts) IN (12, 1, 2))::INT AS is_winter, (month(ts) IN (3, 4, 5))::INT AS is_summer,
      (month(ts) IN (6, 7, 8, 9))::INT AS is_monsoon, (month(ts) IN (10, 11))::INT AS is_post_monsoon"""
_WAVES = "sin_hour cos_hour sin_dow cos_dow sin_month cos_month sin_doy cos_doy"
MATRIX_CTE = f"""{b.INDEX_CTE}, framed AS (SELECT entity, ts, {FRAME_SQL} FROM idx), {_NET_SQL},
  matrix AS (SELECT f.*, lo AS network_min_aqi_lag_1h, hi AS network_max_aqi_lag_1h, top_neighbor_aqi_lag_1h, top_neighbor_pm25_lag_1h, {_LOO}
    FROM framed f LEFT JOIN net USING (ts) LEFT JOIN near USING (entity, ts) WHERE f.aqi_curr IS NOT NULL)"""


def matrix(t: Tables):
    return ft.feature_matrix(b.index(t), "entity", neighbours(t))


@query("feature_matrix", f"WITH {MATRIX_CTE} SELECT *, {_CAL} FROM matrix", " ".join(FRAME_COLS + _NET) + " " + _WAVES, digits=5)
def feature_matrix(t: Tables):
    """All features and targets per station and hour with an index."""
    return matrix(t).drop(HOUR)


_RN = "OVER (PARTITION BY entity ORDER BY ts{f})"


def _row_sql() -> dict[str, str]:
    over = _RN.format(f="")
    rows = lambda w: _RN.format(f=f" ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW")
    out = {n: f"lag({s}, {k}) {over}" for n, (s, k) in ft.ROW_LAGS.items()}
    for fn, tag, table in (("avg", "mean", ft.ROW_MEANS), ("stddev_samp", "std", ft.ROW_STDS)):
        for p, widths in table.items():
            for w in widths:
                out[f"{p}_roll_{tag}_{w}h"] = f"CASE WHEN count({p}_curr) {rows(w)} >= {w // 4} THEN {fn}({p}_curr) {rows(w)} END"
    out["network_mean_aqi_lag_24h"] = f"lag(network_mean_aqi_lag_1h, 23) {over}"
    out["network_mean_pm25_lag_24h"] = f"lag(network_mean_pm25_lag_1h, 23) {over}"
    for h in (24, 48, 72):
        out[f"aqi_delta_{h}h"] = f"aqi_curr - aqi_lag_{h}h"
    out["pm25_delta_24h"] = "pm25_curr - pm25_lag_24h"
    return out


_ROWS = _row_sql()


@query(
    "long_horizon_features",
    f"WITH {MATRIX_CTE} SELECT entity, ts, {', '.join(f'{s} AS {n}' for n, s in _ROWS.items())} FROM matrix",
    " ".join(_ROWS),
    digits=5,
)
def long_horizon_features(t: Tables):
    """Row-based multi-day lags, windows and deltas."""
    return ft.long_horizon_features(matrix(t), b.BY).select("entity", "ts", *_ROWS)


@query(
    "seasonal_baselines",
    f"""WITH {b.INDEX_CTE}, o AS (SELECT entity, ts, index_value FROM idx WHERE index_value IS NOT NULL)
    SELECT entity, ts, lag(index_value, 23) OVER w AS pred_seasonal_1h, lag(index_value, 18) OVER w AS pred_seasonal_6h, index_value AS pred_seasonal_24h
    FROM o WINDOW w AS (PARTITION BY entity ORDER BY ts)""",
    "pred_seasonal_1h pred_seasonal_6h pred_seasonal_24h",
)
def seasonal_baselines(t: Tables):
    """Seasonal persistence by row shifts."""
    rows = b.index(t).where("index_value IS NOT NULL").select("entity", HOUR, F.col("index_value").alias("aqi_curr"))
    return with_label(ft.seasonal_baselines(rows, b.BY)).select("entity", "ts", "pred_seasonal_1h", "pred_seasonal_6h", "pred_seasonal_24h")


@query(
    "label_fill",
    f"""WITH {b.READINGS_CTE}, s AS (SELECT entity, ts, CASE WHEN hour(ts) % 6 = 2 THEN CASE WHEN day(ts) % 2 = 0 THEN 'official' ELSE 'recomputed' END END AS label FROM readings)
    SELECT entity, ts, coalesce(last_value(label IGNORE NULLS) OVER (PARTITION BY entity ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(label IGNORE NULLS) OVER (PARTITION BY entity ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM s""",
)
def label_fill(t: Tables):
    """Forward, then backward fill of a sparse label."""
    label = F.when(F.hour("ts") % 6 == 2, F.when(F.dayofmonth("ts") % 2 == 0, "official").otherwise("recomputed"))
    return od.fill_from_neighbours(b.readings_ts(t).withColumn("label", label), b.BY, HOUR, "label", "filled").select("entity", "ts", "filled")


@query(
    "leave_one_out",
    f"""WITH {b.READINGS_CTE}, n AS (SELECT ts, sum(pm25) AS s, count(pm25) AS n FROM readings GROUP BY ts)
    SELECT entity, ts, CASE WHEN n > 1 THEN (s - pm25) / (n - 1) ELSE 0 END AS others_pm25 FROM readings JOIN n USING (ts)""",
    "others_pm25",
)
def leave_one_out(t: Tables):
    """Mean of the other stations at the same hour; 0 when alone."""
    return with_label(ft.leave_one_out(b.readings(t), [HOUR], {"pm25": "others_pm25"})).select("entity", "ts", "others_pm25")


@query(
    "neighbour_values",
    f"""WITH {b.READINGS_CTE}, {_NEAR_SQL} SELECT a.entity, a.ts, n.pm25 AS near_pm25 FROM readings a JOIN nb ON nb.entity = a.entity LEFT JOIN readings n
      ON n.ts = a.ts AND n.entity = nb.near""",
    "near_pm25",
)
def neighbour_values(t: Tables):
    """Values of a fixed neighbour at the same hour."""
    r = b.readings(t)
    return with_label(ft.neighbour_values(r, "entity", HOUR, neighbours(t), {"pm25": "near_pm25"})).select("entity", "ts", "near_pm25")


_FIRES = """d AS (SELECT ts::DATE AS day, count(*) AS fires FROM events WHERE event_type = 'error' AND value > 100 GROUP BY 1),
  spn AS (SELECT unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY))::DATE AS day FROM events),
  f AS (SELECT day, coalesce(fires, 0) AS fires FROM spn LEFT JOIN d USING (day)),
  fl AS (SELECT day, fires, lag(fires, 1) OVER w AS fires_lag1, lag(fires, 2) OVER w AS fires_lag2, lag(fires, 3) OVER w AS fires_lag3 FROM f WINDOW w AS (ORDER BY day))"""


def fires(t: Tables):
    points = t.events.where("event_type = 'error' AND value > 100").select(F.to_date("ts").alias("day"))
    span = t.events.agg(F.to_date(F.min("ts")).alias("first"), F.to_date(F.max("ts")).alias("last"))
    return ex.daily_counts(points, "day", span, out="fires", lags=(1, 2, 3))


@query("daily_point_counts", f"WITH {_FIRES} SELECT * FROM fl")
def daily_point_counts(t: Tables):
    """Point events as zero-filled daily counts with lags of one to three days."""
    return fires(t)


@query("daily_bucket_join", f"WITH {b.READINGS_CTE}, {_FIRES} SELECT entity, ts, fires, fires_lag1 FROM readings LEFT JOIN fl ON fl.day = ts::DATE")
def daily_bucket_join(t: Tables):
    """Daily table joined to hourly rows by local date."""
    return ex.attach_daily(b.readings_ts(t), fires(t), "ts", "day").select("entity", "ts", "fires", "fires_lag1")


@query(
    "weather_attachment",
    f"""WITH {b.READINGS_CTE}, {b.index_ctes()}, w AS (SELECT entity, ts, CASE WHEN count(no2) OVER p >= 6 THEN avg(no2) OVER p END AS no2_mean24, lead(no2, 24) OVER o AS no2_plus24
        FROM grid WINDOW p AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), o AS (PARTITION BY entity ORDER BY ts))
    SELECT entity, ts, no2_mean24, no2_plus24 FROM readings JOIN w USING (entity, ts)""",
    "no2_mean24 no2_plus24",
)
def weather_attachment(t: Tables):
    """Hourly driver with its 24 h mean (at least 6 hours) and the value 24 h ahead."""
    r = b.readings(t)
    out = ex.attach_hourly(r.select("entity", HOUR), r.select("entity", HOUR, "no2"), b.BY, ["no2"])
    return with_label(out).select("entity", "ts", "no2_mean24", "no2_plus24")


@query(
    "wind_vectors",
    """SELECT event_type, avg(-value / 10 * sin(radians(user_id % 360))) AS u, avg(-value / 10 * cos(radians(user_id % 360))) AS v FROM events GROUP BY 1""",
    "u v",
)
def wind_vectors(t: Tables):
    """Wind speed and direction as eastward and northward components."""
    e = t.events.select("event_type", (F.col("value") / 10).alias("speed"), (F.col("user_id") % 360).alias("direction"))
    return ex.wind_vectors(e, "speed", "direction").groupBy("event_type").agg(F.avg("wind_u").alias("u"), F.avg("wind_v").alias("v"))


@query(
    "smoothed_series",
    f"""WITH {b.READINGS_CTE}, d AS (SELECT entity, ts::DATE AS day, avg(pm25) AS m FROM readings GROUP BY ALL)
    SELECT entity, day, m AS mean_pm25, avg(m) OVER (PARTITION BY entity ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS rolling_7d FROM d""",
    "mean_pm25 rolling_7d",
)
def smoothed_series(t: Tables):
    """Daily means with a trailing mean over the last seven daily rows."""
    from ..operators.profiles import daily_means, rolling_rows

    daily = daily_means(b.readings_ts(t), b.BY, "ts", {"pm25": "mean_pm25"})
    return rolling_rows(daily, b.BY, "day", "mean_pm25", 7, "rolling_7d")


@query(
    "centred_mean",
    f"""WITH {b.INDEX_CTE} SELECT entity, ts, CASE WHEN count(pm25) OVER w >= 24 THEN avg(pm25) OVER w END AS centred
    FROM grid WINDOW w AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN 84 PRECEDING AND 83 FOLLOWING)""",
    "centred",
)
def centred_mean(t: Tables):
    """Mean over a 168-hour window centred on the hour (84 before, 83 after), at least 24 hours present."""
    from ..operators.grid import fill_grid
    from ..operators.profiles import centred_mean as centred

    return with_label(centred(fill_grid(b.readings(t), b.BY), b.BY, "pm25", 168, 24, "centred")).select("entity", "ts", "centred")


@query(
    "feature_manifest",
    f"""WITH {MATRIX_CTE}, l AS (UNPIVOT (SELECT {', '.join(f'{c}::DOUBLE AS {c}' for c in FRAME_COLS if not c.startswith('target'))} FROM matrix) ON COLUMNS(*) INTO NAME feature VALUE v),
      c AS (SELECT feature, count(v) AS non_null FROM l GROUP BY 1), n AS (SELECT count(*) AS n FROM matrix),
      f AS (SELECT unnest([{', '.join(f"'{c}'" for c in FRAME_COLS if not c.startswith('target'))}]) AS feature)
    SELECT feature, CASE WHEN regexp_matches(feature, '^(temp|humidity|wind_speed|solar_rad)_') THEN 'F' WHEN feature LIKE '%_roll_%' THEN 'C' WHEN feature LIKE 'aqi_%' THEN 'A' ELSE 'B' END AS feature_group,
      coalesce(non_null, 0) AS non_null, 100.0 * (n - coalesce(non_null, 0)) / n AS missing_pct FROM f LEFT JOIN c USING (feature), n""",
    "missing_pct",
)
def feature_manifest(t: Tables):
    """Group, present count and missing share per feature."""
    own = ft.entity_features(b.index(t), b.BY)
    return ft.manifest(own, [c for c in FRAME_COLS if not c.startswith("target")])


@query(
    "feature_ranking",
    f"""WITH {MATRIX_CTE}, base AS (SELECT {', '.join(c for c in FRAME_COLS if not c.startswith('target') and c not in ('nox_curr', 'so2_curr'))}, target_aqi_1h AS y1, target_aqi_6h AS y6, target_aqi_24h AS y24 FROM matrix),
      l AS (UNPIVOT base ON COLUMNS(lambda c: c NOT IN ('y1', 'y6', 'y24')) INTO NAME feature VALUE v),
      h AS (SELECT feature, v, 1 AS horizon, y1 AS y FROM l UNION ALL SELECT feature, v, 6, y6 FROM l UNION ALL SELECT feature, v, 24, y24 FROM l),
      c AS (SELECT horizon, feature, count(*) AS pairs, corr(v, y) AS r FROM h WHERE v IS NOT NULL AND y IS NOT NULL GROUP BY ALL HAVING count(*) > 100)
    SELECT horizon, feature, pairs, r, abs(r) AS abs_r, rank() OVER (PARTITION BY horizon ORDER BY round(abs(r), 9) DESC, feature)::INT AS position FROM c QUALIFY position <= 10""",
    "r abs_r",
)
def feature_ranking(t: Tables):
    """Ten features most correlated with each target."""
    own = ft.entity_features(b.index(t), b.BY)
    names = [c for c in FRAME_COLS if not c.startswith("target")]
    return ft.correlation_ranking(own, names, {1: "target_aqi_1h", 6: "target_aqi_6h", 24: "target_aqi_24h"}, top=10)


@query(
    "target_availability",
    f"""WITH {MATRIX_CTE} SELECT entity, month(ts)::INT AS month, count(*) AS n, count(target_aqi_1h) AS target_1h, count(target_aqi_6h) AS target_6h, count(target_aqi_24h) AS target_24h
    FROM matrix GROUP BY GROUPING SETS ((entity, month(ts)), (entity), (month(ts)), ())""",
)
def target_availability(t: Tables):
    """Rows with each target by station and month, by either, and in total."""
    own = with_label(ft.entity_features(b.index(t), b.BY))
    return ft.target_availability(own, "entity", "ts", {f"target_{h}h": f"target_aqi_{h}h" for h in (1, 6, 24)})


@query("kept_columns", f"WITH {b.READINGS_CTE} SELECT entity, ts, pm25, no2 FROM readings", "pm25 no2")
def kept_columns(t: Tables):
    """Readings without the columns that never vary: a constant one and an empty one go."""
    from ..operators.cleaning import prune_columns

    r = b.readings_ts(t).withColumns({"flat": F.lit(1.0), "empty": F.lit(None).cast("double")})
    return r.select("entity", "ts", *prune_columns(r, ["pm25", "no2", "flat", "empty"]))


@query(
    "low_variety_columns",
    f"""WITH {b.READINGS_CTE}, l AS (SELECT 'pm25' AS feature, pm25 AS v FROM readings UNION ALL SELECT 'always', 1.0 FROM readings UNION ALL SELECT 'missing', NULL FROM readings)
    SELECT feature, count(DISTINCT v) < 2 AS dropped FROM l GROUP BY 1""",
)
def low_variety_columns(t: Tables):
    """Features with fewer than two distinct values."""
    from ..operators.cleaning import low_variety_columns as low

    r = b.readings(t).select("pm25", F.lit(1.0).alias("always"), F.lit(None).cast("double").alias("missing"))
    return low(r, ["pm25", "always", "missing"])

