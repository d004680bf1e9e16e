"""Statistical reports over readings and index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.hours import hour_label
from ..operators import correlation as co, episodes as ep, profiles as pr
from ..operators.grid import HOUR, with_label
from . import bindings as b
from .catalog import Tables, query

_M = b.MEASURED


def _season_sql(ts: str) -> str:
    return f"CASE WHEN month({ts}) IN (12, 1, 2) THEN 'Winter' WHEN month({ts}) IN (3, 4, 5) THEN 'Summer' WHEN month({ts}) IN (6, 7, 8, 9) THEN 'Monsoon' ELSE 'Post-Monsoon' END"


_PROFILE_SQL = """count(*) AS obs_count, avg(pm25) AS pm25_mean, quantile_cont(pm25, 0.5) AS pm25_median, quantile_cont(pm25, 0.9) AS pm25_p90, avg(pm10) AS pm10_mean,
  quantile_cont(pm10, 0.5) AS pm10_median, avg(no2) AS no2_mean, avg(o3) AS o3_mean, avg(co) AS co_mean, avg(index_value) AS aqi_mean, quantile_cont(index_value, 0.5) AS aqi_median,
  quantile_cont(index_value, 0.9) AS aqi_p90, quantile_cont(index_value, 0.95) AS aqi_p95, max(index_value) AS aqi_max, stddev_samp(index_value) AS aqi_std"""
_PROFILE = "pm25_mean pm25_median pm25_p90 pm10_mean pm10_median no2_mean o3_mean co_mean aqi_mean aqi_median aqi_p90 aqi_p95 aqi_max aqi_std"


def _profile(df, by, bounded=True):
    return pr.grouped_profile(
        df,
        by,
        means={**{f"{m}_mean": m for m in _M}, "aqi_mean": "index_value"},
        shares={
            "pm25_median": ("pm25", 0.5), "pm25_p90": ("pm25", 0.9), "pm10_median": ("pm10", 0.5),
            "aqi_median": ("index_value", 0.5), "aqi_p90": ("index_value", 0.9), "aqi_p95": ("index_value", 0.95),
        },
        maxima={"aqi_max": "index_value"},
        stds={"aqi_std": "index_value"},
        bounded=bounded,
    )


@query("hour_of_day_profile", f"WITH {b.JOINED_CTE} SELECT entity, hour(ts)::INT AS hour_of_day, {_PROFILE_SQL} FROM joined GROUP BY ALL", _PROFILE)
def hour_of_day_profile(t: Tables):
    """Daily cycle per station."""
    return _profile(b.joined_readings(t).withColumn("hour_of_day", F.hour("ts")), ["entity", "hour_of_day"])


@query("weekday_profile", f"WITH {b.JOINED_CTE} SELECT entity, isodow(ts)::INT AS iso_day, dayname(ts) AS day_name, {_PROFILE_SQL} FROM joined GROUP BY ALL", _PROFILE)
def weekday_profile(t: Tables):
    """ISO weekday cycle per station."""
    j = b.joined_readings(t).withColumn("iso_day", F.weekday("ts") + 1).withColumn("day_name", F.date_format("ts", "EEEE"))
    return _profile(j, ["entity", "iso_day", "day_name"])


@query("monthly_profile", f"WITH {b.JOINED_CTE} SELECT entity, year(ts)::INT AS year, month(ts)::INT AS month, {_PROFILE_SQL} FROM joined GROUP BY ALL", _PROFILE)
def monthly_profile(t: Tables):
    """Station by year and month."""
    return _profile(b.joined_readings(t).withColumn("year", F.year("ts")).withColumn("month", F.month("ts")), ["entity", "year", "month"])


_SEASON_ORDER = "CASE season WHEN 'Winter' THEN 1 WHEN 'Summer' THEN 2 WHEN 'Monsoon' THEN 3 ELSE 4 END"


@query(
    "seasonal_profile",
    f"WITH {b.JOINED_CTE}, p AS (SELECT entity, {_season_sql('ts')} AS season, {_PROFILE_SQL} FROM joined GROUP BY ALL) SELECT *, {_SEASON_ORDER} AS season_order FROM p ORDER BY entity, season_order",
    _PROFILE,
)
def seasonal_profile(t: Tables):
    """Station by season in season order."""
    p = _profile(b.joined_readings(t).withColumn("season", cal.season("ts")), ["entity", "season"])
    return p.withColumn("season_order", cal.season_order("season")).orderBy("entity", "season_order")


@query("station_summary", f"WITH {b.JOINED_CTE} SELECT entity, {_PROFILE_SQL} FROM joined GROUP BY ALL ORDER BY aqi_mean DESC", _PROFILE)
def station_summary(t: Tables):
    """Overall comparison of stations."""
    return _profile(b.joined_readings(t), ["entity"]).orderBy(F.col("aqi_mean").desc())


@query("network_profile", f"WITH {b.JOINED_CTE} SELECT hour(ts)::INT AS hour_of_day, {_PROFILE_SQL} FROM joined GROUP BY ALL", _PROFILE)
def network_profile(t: Tables):
    """Daily cycle pooled over all stations: groups grow with the network, so percentiles use bucketed counts."""
    return _profile(b.joined_readings(t).withColumn("hour_of_day", F.hour("ts")), ["hour_of_day"], bounded=False)


@query(
    "seasonal_ranking",
    f"""WITH {b.JOINED_CTE}, p AS (SELECT entity, CASE WHEN day(ts) <= 15 THEN 'first' ELSE 'second' END AS season, round(avg(index_value), 6) AS aqi_mean, round(avg(pm25), 6) AS pm25_mean FROM joined GROUP BY ALL)
    SELECT *, rank() OVER (PARTITION BY season ORDER BY aqi_mean DESC)::INT AS aqi_rank, rank() OVER (PARTITION BY season ORDER BY pm25_mean DESC)::INT AS pm25_rank FROM p""",
    "aqi_mean pm25_mean",
)
def seasonal_ranking(t: Tables):
    """Stations ranked within each half month (the data span one season)."""
    half = F.when(F.dayofmonth("ts") <= 15, "first").otherwise("second")
    p = b.joined_readings(t).groupBy("entity", half.alias("season")).agg(F.round(F.avg("index_value"), 6).alias("aqi_mean"), F.round(F.avg("pm25"), 6).alias("pm25_mean"))
    return pr.rank_within(p, ["season"], {"aqi_rank": "aqi_mean", "pm25_rank": "pm25_mean"})


@query(
    "distribution_summary",
    f"""WITH {b.JOINED_CTE}, l AS ({' UNION ALL '.join(f"SELECT '{m}' AS measure, {m} AS v, pm25 AS p, index_value AS a FROM joined" for m in (*_M, 'index_value'))})
    SELECT measure, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS minimum, max(v) AS maximum, skewness(v) AS skewness, kurtosis(v) AS kurtosis, corr(v, p) AS pm25_corr, corr(v, a) AS aqi_corr,
      quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.9) AS p90, quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.99) AS p99 FROM l WHERE v IS NOT NULL GROUP BY 1""",
    "mean std minimum maximum skewness kurtosis pm25_corr aqi_corr p25 median p75 p90 p95 p99",
)
def distribution_summary(t: Tables):
    """Distribution of every measure."""
    return co.distribution_summary(b.joined_readings(t), [*_M, "index_value"], against={"pm25_corr": "pm25", "aqi_corr": "index_value"})


def _pairs_sql(pairs) -> str:
    return " UNION ALL ".join(f"""SELECT '{x}' AS "left", '{y}' AS "right", {x} AS x, {y} AS y FROM joined WHERE {x} IS NOT NULL AND {y} IS NOT NULL""" for x, y in pairs)


_RANKED = """rk AS (SELECT *, rank() OVER (PARTITION BY "left", "right" ORDER BY x) + (count(*) OVER (PARTITION BY "left", "right", x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY "left", "right" ORDER BY y) + (count(*) OVER (PARTITION BY "left", "right", y) - 1) / 2.0 AS ry FROM prs)"""
_PAIRS = [(x, y) for i, x in enumerate((*_M, "index_value")) for y in (*_M, "index_value")[i + 1 :]]


@query(
    "measure_correlation",
    f"""WITH {b.JOINED_CTE}, prs AS ({_pairs_sql(_PAIRS)}), {_RANKED} SELECT "left", "right", count(*) AS n, corr(x, y) AS pearson, corr(rx, ry) AS spearman FROM rk GROUP BY ALL""",
    "pearson spearman",
)
def measure_correlation(t: Tables):
    """Pearson and Spearman coefficients of every pair of measures."""
    return co.correlation_table(b.joined_readings(t), _PAIRS)


@query(
    "station_correlation",
    f"""WITH {b.READINGS_CTE} SELECT x.entity AS "left", y.entity AS "right", count(*) AS hours, corr(x.pm25, y.pm25) AS r FROM readings x JOIN readings y ON x.ts = y.ts AND x.entity < y.entity
    WHERE x.pm25 IS NOT NULL AND y.pm25 IS NOT NULL GROUP BY ALL""",
    "r",
)
def station_correlation(t: Tables):
    """Correlation of every two stations over their common hours."""
    return co.station_correlation(b.readings_ts(t), "entity", "ts", "pm25")


@query(
    "weather_usability",
    f"""WITH {b.JOINED_CTE}, prs AS ({_pairs_sql([(w, r) for w in ('no2', 'co', 'o3') for r in ('pm25', 'index_value')])}), {_RANKED},
      c AS (SELECT "left" AS measure, "right" AS ref, corr(x, y) AS pe, corr(rx, ry) AS sp FROM rk GROUP BY ALL),
      a AS ({' UNION ALL '.join(f"SELECT '{w}' AS measure, count({w}) AS available, 100.0 * count({w}) / count(*) AS available_pct FROM joined" for w in ('no2', 'co', 'o3'))})
    SELECT a.*, p.pe AS pm25_pearson, p.sp AS pm25_spearman, i.pe AS index_pearson, i.sp AS index_spearman, CASE WHEN available > 500 AND measure <> 'o3' THEN 'High' WHEN measure = 'co' THEN 'Moderate' ELSE 'Low/Sparse' END AS usability
    FROM a LEFT JOIN c p ON p.measure = a.measure AND p.ref = 'pm25' LEFT JOIN c i ON i.measure = a.measure AND i.ref = 'index_value'""".replace("SELECT a.*, p.pe", "SELECT a.measure, a.available, a.available_pct, p.pe").replace("available > 500 AND measure", "available > 500 AND a.measure").replace("WHEN measure = 'co'", "WHEN a.measure = 'co'"),
    "available_pct pm25_pearson pm25_spearman index_pearson index_spearman",
)
def weather_usability(t: Tables):
    """Availability and correlations of the weather stand-ins."""
    return co.usability(b.joined_readings(t), ["no2", "co", "o3"], pm25="pm25", index="index_value", high=500, never_high=("o3",), moderate=("co",))


_LAGS = (1, 6, 12, 24, 48, 168)


@query(
    "autocorrelation",
    f"""WITH {b.INDEX_CTE}, o AS (SELECT entity, ts, index_value AS v FROM idx WHERE index_value IS NOT NULL),
      l AS ({' UNION ALL '.join(f"SELECT entity, {k} AS lag, v, lag(v, {k}) OVER (PARTITION BY entity ORDER BY ts) AS past FROM o" for k in _LAGS)})
    SELECT entity, lag, count(*) AS pairs, corr(v, past) AS autocorrelation FROM l WHERE past IS NOT NULL GROUP BY ALL""",
    "autocorrelation",
)
def autocorrelation(t: Tables):
    """Autocorrelation of the index on observed rows."""
    return co.autocorrelation(b.index(t), b.BY, "index_value", _LAGS)


@query(
    "pm25_autocorrelation",
    f"""WITH {b.READINGS_CTE}, o AS (SELECT entity, ts, pm25 AS v FROM readings WHERE pm25 IS NOT NULL),
      l AS ({' UNION ALL '.join(f"SELECT entity, {k} AS lag, v, lag(v, {k}) OVER (PARTITION BY entity ORDER BY ts) AS past FROM o" for k in _LAGS)})
    SELECT entity, lag, count(*) AS pairs, corr(v, past) AS autocorrelation FROM l WHERE past IS NOT NULL GROUP BY ALL""",
    "autocorrelation",
)
def pm25_autocorrelation(t: Tables):
    """Autocorrelation of the measured concentration on observed rows."""
    return co.autocorrelation(b.readings(t), b.BY, "pm25", _LAGS)


_HOURS_OBS = f"""{b.INDEX_CTE}, o AS (SELECT entity, ts, hourly_index AS v, row_number() OVER (PARTITION BY entity ORDER BY ts) AS rn FROM hourly WHERE hourly_index IS NOT NULL)"""


@query(
    "high_runs",
    f"""WITH {_HOURS_OBS}, h AS (SELECT *, rn - row_number() OVER (PARTITION BY entity ORDER BY ts) AS g FROM o WHERE v >= 200)
    SELECT entity, min(ts) AS start_time, max(ts) AS end_time, count(*) AS duration_rows, max(v) AS max_value, avg(v) AS mean_value FROM h GROUP BY entity, g HAVING count(*) >= 6""",
    "max_value mean_value",
)
def high_runs(t: Tables):
    """Runs of at least six observed hours at or above a threshold."""
    return ep.runs_above(b.hourly(t), b.BY, "hourly_index", 200.0, min_rows=6)


_EPISODES = """h AS (SELECT *, CASE WHEN rn - lag(rn) OVER (PARTITION BY entity ORDER BY ts) <= 4 THEN 0 ELSE 1 END AS s FROM o WHERE v >= 320),
  g AS (SELECT *, sum(s) OVER (PARTITION BY entity ORDER BY ts) AS g FROM h),
  eps AS (SELECT entity, min(ts) AS start_time, max(ts) AS end_time, max(v) AS peak, date_diff('hour', min(ts), max(ts)) + 1 AS duration_hours FROM g GROUP BY entity, g)"""


@query("bridged_episodes", f"WITH {_HOURS_OBS}, {_EPISODES} SELECT entity, start_time, end_time, peak, duration_hours FROM eps", "peak")
def bridged_episodes(t: Tables):
    """Episodes with gaps of up to three rows bridged."""
    hi = b.hourly(t).where("hourly_index IS NOT NULL")
    e = ep.episodes(hi, b.BY, "hourly_index", 320.0, max_gap=3)

    return e.select("entity", hour_label("start_hour").alias("start_time"), hour_label("end_hour").alias("end_time"), "peak", "duration_hours")


_DETECT = f"""{b.INDEX_CTE}, f AS (SELECT entity, ts, lead(hourly_index, 6) OVER w AS y_true, hourly_index AS persist, avg(hourly_index) OVER (PARTITION BY entity ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS model
    FROM hourly WINDOW w AS (PARTITION BY entity ORDER BY ts)),
  o AS (SELECT entity, ts + INTERVAL 6 HOUR AS ts, y_true AS v, row_number() OVER (PARTITION BY entity ORDER BY ts) AS rn FROM f WHERE y_true IS NOT NULL), {_EPISODES},
  al AS (SELECT entity, ts, 'final' AS model, model AS p FROM f UNION ALL SELECT entity, ts, 'persistence', persist FROM f),
  ms AS (SELECT unnest(['final', 'persistence']) AS model),
  rep AS (SELECT e.*, m.model, count(al.ts) FILTER (WHERE al.ts + INTERVAL 6 HOUR >= e.start_time) AS n_alerts, min(al.ts) FILTER (WHERE al.ts + INTERVAL 6 HOUR >= e.start_time) AS first0, count(al.ts) AS n_alerts_tol12, min(al.ts) AS first12
    FROM eps e CROSS JOIN ms m LEFT JOIN al ON al.entity = e.entity AND al.model = m.model AND al.p >= 320 AND al.ts <= e.start_time AND al.ts + INTERVAL 6 HOUR >= e.start_time - INTERVAL 12 HOUR AND al.ts + INTERVAL 6 HOUR <= e.end_time GROUP BY ALL),
  report AS (SELECT entity, start_time, end_time, peak, duration_hours, model, CASE WHEN n_alerts > 0 THEN 'hit' ELSE 'miss' END AS detection, coalesce(date_diff('hour', first0, start_time), 0)::DOUBLE AS lead_time_hours, n_alerts,
    CASE WHEN n_alerts_tol12 > 0 THEN 'hit' ELSE 'miss' END AS detection_tol12, coalesce(date_diff('hour', first12, start_time), 0)::DOUBLE AS lead_time_hours_tol12, n_alerts_tol12 FROM rep)"""


def _detection(t: Tables):
    from ..operators.ordered import with_frames

    f = with_frames(
        b.hourly(t), b.BY, HOUR,
        lambda w: {"y_true": w.at("hourly_index", 6), "persist": F.col("hourly_index"), "model": w.mean("hourly_index", 3, 1)},
        behind=3, ahead=6,
    )
    return ep.detection_report(f, b.BY, horizon=6, actual="y_true", models={"final": "model", "persistence": "persist"}, threshold=320.0)


@query("episode_detection", f"WITH {_DETECT} SELECT * FROM report", "peak lead_time_hours lead_time_hours_tol12")
def episode_detection(t: Tables):
    """Hit, lead time and alerts per episode for model and persistence."""
    d = with_label(_detection(t).withColumnRenamed("start_hour", HOUR), "start_time").drop(HOUR)
    d = with_label(d.withColumnRenamed("end_hour", HOUR), "end_time").drop(HOUR)
    return d.drop("crossing_hour")


@query("episode_detection_summary", f"WITH {_DETECT} SELECT model, count(*) AS episodes, count(*) FILTER (WHERE detection = 'hit') AS hits, avg(lead_time_hours) AS mean_lead_hours, count(*) FILTER (WHERE detection = 'hit') / count(*) AS hit_rate FROM report GROUP BY 1", "mean_lead_hours hit_rate")
def episode_detection_summary(t: Tables):
    """Hit rate and mean lead per model."""
    return ep.detection_summary(_detection(t))


@query(
    "longest_episodes",
    f"""WITH {_HOURS_OBS}, h AS (SELECT *, rn - row_number() OVER (PARTITION BY entity ORDER BY ts) AS g FROM o WHERE v >= 200),
      r AS (SELECT entity, min(ts) AS start_time, count(*) AS duration_rows FROM h GROUP BY entity, g) SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY entity ORDER BY duration_rows DESC, start_time) <= 3""",
)
def longest_episodes(t: Tables):
    """Three longest runs per station."""
    from ..operators.tables import top_k

    runs = ep.runs_above(b.hourly(t), b.BY, "hourly_index", 200.0, min_rows=1).select("entity", "start_time", "duration_rows")
    return top_k(runs, ["entity"], [F.col("duration_rows").desc(), F.col("start_time")], 3)


@query(
    "event_window_means",
    f"""WITH {b.JOINED_CTE} SELECT ts::DATE AS day, entity, avg(index_value) AS aqi, avg(pm25) AS pm25, avg(no2) AS no2 FROM joined WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20 23:59:59' AND index_value IS NOT NULL GROUP BY ALL""",
    "aqi pm25 no2",
)
def event_window_means(t: Tables):
    """Daily means per station inside an event window."""
    j = b.joined_readings(t).where("ts >= TIMESTAMP_NTZ '2024-01-10 00:00:00' AND ts <= TIMESTAMP_NTZ '2024-01-20 23:59:59' AND index_value IS NOT NULL")
    return pr.daily_means(j, ["entity"], "ts", {"index_value": "aqi", "pm25": "pm25", "no2": "no2"})


@query(
    "event_spikes",
    f"""WITH {b.READINGS_CTE}, n AS (SELECT ts::DATE AS event, ts, avg(pm25) AS pm25, avg(no2) AS no2 FROM readings GROUP BY ALL)
    SELECT event, arg_max(ts, pm25) AS peak_time, max(pm25) FILTER (WHERE hour(ts) = 14) AS pm25_baseline, max(pm25) AS pm25_peak, max(pm25) / max(pm25) FILTER (WHERE hour(ts) = 14) AS pm25_multiplier,
      max(no2) FILTER (WHERE hour(ts) = 14) AS no2_baseline, max(no2) AS no2_peak, max(no2) / max(no2) FILTER (WHERE hour(ts) = 14) AS no2_multiplier FROM n GROUP BY 1""",
    "pm25_baseline pm25_peak pm25_multiplier no2_baseline no2_peak no2_multiplier",
)
def event_spikes(t: Tables):
    """Peak hour, baseline hour and surge multiplier of the network mean, one event per day."""
    n = b.readings_ts(t).groupBy("ts").agg(F.avg("pm25").alias("pm25"), F.avg("no2").alias("no2"))
    return pr.spike_table(n.withColumn("event", F.to_date("ts")), "event", "ts", 14, ["pm25", "no2"])


@query("category_counts", f"""WITH {b.INDEX_CTE} SELECT {'CASE WHEN index_value <= 50 THEN 1 WHEN index_value <= 100 THEN 2 WHEN index_value <= 200 THEN 3 WHEN index_value <= 300 THEN 4 WHEN index_value <= 400 THEN 5 ELSE 6 END'} AS position,
  ['Good', 'Satisfactory', 'Moderate', 'Poor', 'Very Poor', 'Severe'][position] AS category, count(*) AS n FROM idx WHERE index_value IS NOT NULL GROUP BY ALL""")
def category_counts(t: Tables):
    """Rows per category in category order."""
    return pr.category_counts(b.index(t), "index_value")


@query("daily_mean_series", f"WITH {b.INDEX_CTE} SELECT entity, ts::DATE AS day, avg(index_value) AS mean_index FROM idx WHERE index_value IS NOT NULL GROUP BY ALL", "mean_index")
def daily_mean_series(t: Tables):
    """Daily mean index per station."""
    return pr.daily_means(b.index_ts(t).where("index_value IS NOT NULL"), b.BY, "ts", {"index_value": "mean_index"})
