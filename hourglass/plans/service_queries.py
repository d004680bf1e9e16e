"""Source agreement, parity, run verdicts and read-side roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..functions.hours import hour_number
from ..operators import agreement as ag, serving as sv, slots as sl
from ..operators.grid import HOUR, with_label
from . import bindings as b
from .catalog import Tables, query

# the second source: the same readings one hour late, with a bias that depends on the station
_SHADOW = "shadow AS (SELECT entity, ts + INTERVAL 1 HOUR AS ts, pm25 * (1 + entity * 0.06) AS pm25, pm10 + (hour(ts) % 5) * 4 AS pm10 FROM readings)"


def shadow(t: Tables):
    wave = F.pmod(F.col(HOUR), F.lit(24)) % 5
    return b.readings(t).select("entity", (F.col(HOUR) + 1).alias(HOUR), (F.col("pm25") * (1 + F.col("entity") * 0.06)).alias("pm25"), (F.col("pm10") + wave * 4).alias("pm10"))


_PAIRED = f"""{b.READINGS_CTE}, {_SHADOW}, lg AS (SELECT unnest([-1, 0, 1]) AS lag), w AS (SELECT s.entity, s.ts, lag, s.pm25 AS s1, p.pm25 AS p1, s.pm10 AS s2, p.pm10 AS p2 FROM shadow s, lg JOIN readings p ON p.entity = s.entity AND p.ts = s.ts + to_hours(lag)),
  prs AS (SELECT * FROM (SELECT 'pm25' AS measure, lag, entity, ts, s1 AS s, p1 AS p FROM w UNION ALL SELECT 'pm10', lag, entity, ts, s2, p2 FROM w) WHERE s IS NOT NULL AND p IS NOT NULL)"""
_STATS = "count(*) AS pairs, avg(s - p) AS bias, avg(abs(s - p)) AS mae, avg(s - p) / avg(p) AS bias_share, avg(abs(s - p)) / avg(p) AS mae_share, corr(s, p) AS corr"
_STATC = "bias mae bias_share mae_share corr"


@query("source_agreement", f"WITH {_PAIRED} SELECT measure, lag, {_STATS} FROM prs GROUP BY ALL HAVING count(*) >= 12", _STATC)
def source_agreement(t: Tables):
    """Agreement of two sources per measure and lag."""
    return ag.agreement(shadow(t), b.readings(t), "entity", ["pm25", "pm10"])


@query("best_lag", f"WITH {_PAIRED}, a AS (SELECT measure, lag, {_STATS} FROM prs GROUP BY ALL HAVING count(*) >= 12) SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY measure ORDER BY mae_share, lag) = 1", _STATC)
def best_lag(t: Tables):
    """Lag with the smallest relative error."""
    return ag.best_lag(ag.agreement(shadow(t), b.readings(t), "entity", ["pm25", "pm10"]))


_LIMITS = ag.Gate(min_stations=2)
_PASS = "coalesce(pairs >= {n} AND corr >= 0.9 AND abs(bias_share) < 0.1 AND mae_share < 0.2, false)"
_GATE = f"""{_PAIRED}, hs AS (SELECT list_sort(list(DISTINCT ts)) AS h FROM prs), sp AS (SELECT h[len(h) // 2 + 1] AS split FROM hs),
  f1 AS (SELECT measure, lag, round(avg(abs(s - p)) / avg(p), 4) AS share FROM prs, sp WHERE ts < split GROUP BY ALL HAVING count(*) >= 12),
  ch AS (SELECT measure, lag FROM f1 QUALIFY row_number() OVER (PARTITION BY measure ORDER BY share, CASE lag WHEN 0 THEN 1 WHEN -1 THEN 2 ELSE 3 END) = 1),
  sec AS (SELECT prs.* FROM prs JOIN ch USING (measure, lag), sp WHERE ts >= split), st0 AS (SELECT measure, lag, entity, {_STATS} FROM sec GROUP BY ALL), st AS (SELECT *, {_PASS.format(n=24)} AS passes FROM st0),
  po0 AS (SELECT measure, lag, {_STATS} FROM sec SEMI JOIN (SELECT measure, entity FROM st WHERE passes) g USING (measure, entity) GROUP BY ALL), al AS (SELECT measure, lag, {_STATS} FROM sec GROUP BY ALL),
  ev AS (SELECT measure, lag, 'station' AS scope, entity, pairs, bias, mae, bias_share, mae_share, corr, passes FROM st UNION ALL SELECT measure, lag, 'pooled', NULL, pairs, bias, mae, bias_share, mae_share, corr, {_PASS.format(n=150)} FROM po0
    UNION ALL SELECT measure, lag, 'pooled_all', NULL, pairs, bias, mae, bias_share, mae_share, corr, NULL FROM al)"""


def evidence(t: Tables):
    return ag.gate_evidence(shadow(t), b.readings(t), "entity", ["pm25", "pm10"], _LIMITS)


@query("gate_evidence", f"WITH {_GATE} SELECT * FROM ev", _STATC)
def gate_evidence(t: Tables):
    """Offset chosen on the first half of the overlap, agreement judged on the second."""
    return evidence(t)


_VERDICT = f"""{_GATE}, g AS (SELECT measure, max(lag) AS lag, count(*) FILTER (WHERE scope = 'station' AND passes) AS stations_passing, coalesce(max(pairs) FILTER (WHERE scope = 'pooled'), 0) AS pooled_pairs, coalesce(bool_or(passes) FILTER (WHERE scope = 'pooled'), false) AS pooled_ok FROM ev GROUP BY 1),
  ms AS (SELECT unnest(['pm25', 'pm10', 'o3']) AS measure), vd AS (SELECT measure, lag, coalesce(stations_passing, 0) AS stations_passing, coalesce(pooled_pairs, 0) AS pooled_pairs,
    concat_ws('; ', CASE WHEN lag IS NULL THEN 'too few pairs to choose the offset' END, CASE WHEN lag IS NOT NULL AND NOT pooled_ok THEN 'pooled agreement' END, CASE WHEN lag IS NOT NULL AND stations_passing < 2 THEN 'stations passing' END) AS reasons FROM ms LEFT JOIN g USING (measure))"""


@query("gate_verdicts", f"WITH {_VERDICT} SELECT *, reasons = '' AS passed FROM vd")
def gate_verdicts(t: Tables):
    """Verdict and reasons per measure; an absent measure fails."""
    return ag.gate_verdicts(evidence(t), "entity", ["pm25", "pm10", "o3"], _LIMITS)


@query("usable_stations", f"WITH {_VERDICT} SELECT entity FROM st WHERE passes AND measure IN (SELECT measure FROM vd WHERE reasons = '') AND measure IN ('pm25', 'pm10') GROUP BY 1 HAVING count(DISTINCT measure) = 2")
def usable_stations(t: Tables):
    """Stations that pass every measure of a subset."""
    ev = evidence(t)
    return ag.usable_stations(ev, ag.gate_verdicts(ev, "entity", ["pm25", "pm10"], _LIMITS), "entity", ["pm25", "pm10"])


_SLOTS = """slots AS (SELECT user_id // 50 AS entity, time_bucket(INTERVAL 15 MINUTE, ts) AS start, max(event_id) AS arrival, arg_max(value, event_id) AS v FROM events GROUP BY ALL)"""


def slot_events(t: Tables):
    """Quarter-hour slots: an event delivers its slot's value, later deliveries replace earlier ones."""
    minute = F.floor(F.minute("ts") / 15) * 15
    start = F.date_trunc("hour", "ts").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minute.cast("int"), F.lit(0))
    return b.station_events(t).select("entity", start.alias("start"), F.col("event_id").alias("arrival"), F.col("value").alias("v"))


@query(
    "slots_to_hours",
    f"WITH {_SLOTS} SELECT entity, date_trunc('hour', start) AS ts, avg(v) AS hourly FROM slots GROUP BY ALL HAVING count(*) = 4",
    "hourly",
)
def slots_to_hours(t: Tables):
    """Hours with all four quarter-hour slots, each slot keeping its last delivery."""
    return with_label(sl.slots_to_hours(slot_events(t), ["entity"], "start", "v", "hourly", arrival="arrival")).drop(HOUR)


_SCAN = f"""{_SLOTS}, {b.READINGS_CTE}, off AS (SELECT unnest(range(-75, 76, 15)) AS o15), mv AS (SELECT entity, o15 AS offset_min, date_trunc('hour', start - to_minutes(o15)) AS ts, v FROM slots, off),
  hh AS (SELECT entity, offset_min, ts, avg(v) AS o FROM mv GROUP BY ALL HAVING count(*) = 4), jn AS (SELECT h.entity, offset_min, o, r.pm25 / 2.5 AS c FROM hh h JOIN readings r USING (entity, ts)),
  scan AS (SELECT entity, offset_min::INT AS "offset", count(*) AS n, avg(abs(o - c)) AS mae, 100 * avg(abs(o - c)) / greatest(avg(abs(c)), 1e-9) AS mae_pct, avg((abs(o - c) <= 0.005 * greatest(abs(c), 1e-6))::INT) AS exact_share, corr(o, c) AS corr, sum(o * c) / greatest(sum(o * o), 1e-12) AS slope FROM jn GROUP BY ALL HAVING count(*) >= 20)"""


def _scan(t: Tables):
    s = slot_events(t).groupBy("entity", "start").agg(F.max_by("v", "arrival").alias("v"))
    ref = b.readings(t).select("entity", HOUR, (F.col("pm25") / 2.5).alias("ref"))
    return ag.overlap_scan(s, ref, "entity", "start", "v", "ref")


@query("overlap_scan", f"WITH {_SCAN} SELECT * FROM scan", "mae mae_pct exact_share corr slope")
def overlap_scan(t: Tables):
    """Slots against reference hours at eleven offsets per station."""
    return _scan(t)


@query("pooled_overlap_scan", f"""WITH {_SCAN} SELECT "offset", count(*) AS stations, sum(n)::BIGINT AS pairs, sum(mae_pct * n) / sum(n) AS pooled_mae_pct FROM scan GROUP BY 1""", "pooled_mae_pct")
def pooled_overlap_scan(t: Tables):
    """Offset scan pooled over stations, weighted by pairs."""
    return ag.pooled_scan(_scan(t))


@query(
    "window_plausibility",
    f"""WITH {b.READINGS_CTE}, lv AS (SELECT entity, arg_max(pm25, ts) AS live FROM readings WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1), rf AS (SELECT entity, pm25 AS ref FROM readings WHERE ts < TIMESTAMP '2024-01-20' AND pm25 IS NOT NULL)
    SELECT entity, any_value(live) AS live, avg((ref < live)::INT) AS position, quantile_cont(ref, 0.1) AS p10, quantile_cont(ref, 0.5) AS p50, quantile_cont(ref, 0.9) AS p90 FROM rf JOIN lv USING (entity) GROUP BY 1""",
    "live position p10 p50 p90",
)
def window_plausibility(t: Tables):
    """Where the newest value of each station lies in its reference distribution."""
    r = b.readings(t)
    cut = hour_number(F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    live = r.where(F.col(HOUR) >= cut).groupBy("entity").agg(F.max_by("pm25", HOUR).alias("live"))
    return ag.plausibility(live, r.where(F.col(HOUR) < cut).select("entity", F.col("pm25").alias("ref")), ["entity"], "live", "ref")


@query(
    "parity_summary",
    f"""WITH {b.INDEX_CTE}, d AS (SELECT entity, ts, index_value AS l, CASE WHEN hour(ts) <> 3 THEN index_value + CASE WHEN hour(ts) = 9 THEN 0.25 ELSE 0 END END AS r FROM idx WHERE index_value IS NOT NULL)
    SELECT entity, count(DISTINCT ts) AS issue_hours, count(*) AS rows, count(r) AS compared, max(abs(l - r)) AS max_abs_diff, avg(abs(l - r)) AS mean_abs_diff, count(*) FILTER (WHERE abs(l - r) > 1e-6) AS rows_over_tolerance FROM d GROUP BY 1""",
    "max_abs_diff mean_abs_diff",
)
def parity_summary(t: Tables):
    """Rebuilt against stored values, with planted differences and gaps."""
    d = b.index_ts(t).where("index_value IS NOT NULL")
    other = F.when(F.hour("ts") != 3, F.col("index_value") + F.when(F.hour("ts") == 9, 0.25).otherwise(0.0))
    return ag.parity_summary(d.withColumn("stored", other), ["entity"], "ts", "index_value", "stored")


@query(
    "matrix_fidelity",
    f"""WITH {b.READINGS_CTE}, d AS (SELECT pm25 AS a1, CASE WHEN hour(ts) = 5 THEN pm25 + 1 ELSE pm25 END AS b1, no2 AS a2, CASE WHEN hour(ts) <> 7 THEN no2 END AS b2 FROM readings)
    SELECT count(*) AS rows, 2 AS columns, (avg(coalesce(abs(a1 - b1) <= 1e-6 + 1e-6 * abs(b1), a1 IS NULL AND b1 IS NULL)::INT) + avg(coalesce(abs(a2 - b2) <= 1e-6 + 1e-6 * abs(b2), a2 IS NULL AND b2 IS NULL)::INT)) / 2 AS share_of_cells_equal FROM d""",
    "share_of_cells_equal",
)
def matrix_fidelity(t: Tables):
    """Share of equal cells of a rebuilt and a stored matrix."""
    r = b.readings_ts(t).select("entity", HOUR, "ts", "pm25", "no2")
    stored = r.select("entity", HOUR, F.when(F.hour("ts") == 5, F.col("pm25") + 1).otherwise(F.col("pm25")).alias("pm25"), F.when(F.hour("ts") != 7, F.col("no2")).alias("no2"))
    return ag.fidelity(r, stored, ["entity", HOUR], ["pm25", "no2"])


_MASK = "masked AS (SELECT entity, ts, pm25, pm10, NULL::DOUBLE AS no2, co, o3 FROM readings)"


@query(
    "scenario_index_error",
    f"""WITH {b.INDEX_CTE}, {_MASK}, {b.index_ctes('masked', 'm_')}, s AS (SELECT 'baseline' AS scenario, entity, ts, index_value FROM idx UNION ALL SELECT 'no_no2', entity, ts, index_value FROM m_idx)
    SELECT scenario, count(*) AS n, avg(abs(s.index_value - b.index_value)) AS mae, avg(s.index_value - b.index_value) AS bias FROM s JOIN idx b USING (entity, ts) WHERE s.index_value IS NOT NULL AND b.index_value IS NOT NULL GROUP BY 1""",
    "mae bias",
)
def scenario_index_error(t: Tables):
    """Index error of a masked scenario against the baseline."""
    from ..operators.cleaning import mask_scenario
    from ..operators.index import hourly_index, trailing_index

    base = b.index(t).select("entity", HOUR, "index_value")
    masked = mask_scenario(b.readings(t), "entity", {"*": ["no2"]})
    other = trailing_index(hourly_index(masked, b.BY), b.BY).select("entity", HOUR, "index_value")
    both = base.withColumn("scenario", F.lit("baseline")).unionByName(other.withColumn("scenario", F.lit("no_no2")))
    return ag.scenario_error(base, both, ["entity", HOUR], "index_value")


@query(
    "row_set_reconciliation",
    f"""WITH {b.FORECAST_CTE}, s AS (SELECT 'all' AS row_set, * FROM fc UNION ALL SELECT 'strict', * FROM fc WHERE ts + INTERVAL 6 HOUR <= TIMESTAMP '2024-01-20' UNION ALL SELECT 'day', * FROM fc WHERE hour(ts) BETWEEN 6 AND 18)
    SELECT row_set, count(*) AS n, avg(abs(y_pred - y_true)) AS model_mae, avg(abs(y_curr - y_true)) AS persistence_mae, 1 - avg(abs(y_pred - y_true)) / avg(abs(y_curr - y_true)) AS skill_mae FROM s GROUP BY 1""",
    "model_mae persistence_mae skill_mae",
)
def row_set_reconciliation(t: Tables):
    """One model on all rows, on the strict set and on day hours."""
    cut = hour_number(F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    sets = {"all": F.lit(True), "strict": F.col(HOUR) + 6 <= cut, "day": F.hour("ts").between(6, 18)}
    return ag.row_set_reconciliation(b.forecast_frame(t), "y_true", "y_pred", "y_curr", sets)


@query(
    "model_comparison",
    f"""WITH {b.FORECAST_CTE}, l AS (SELECT entity, y_true, 'model' AS model, y_pred AS p FROM fc UNION ALL SELECT entity, y_true, 'persistence', y_curr FROM fc UNION ALL SELECT entity, y_true, 'blend', 0.5 * (y_pred + y_curr) FROM fc)
    SELECT entity, CASE WHEN y_true < 250 THEN 'low' ELSE 'high' END AS bin, model, count(*) AS n, avg(abs(p - y_true)) AS mae FROM l GROUP BY GROUPING SETS ((entity, model), (bin, model))""",
    "mae",
)
def model_comparison(t: Tables):
    """MAE of several models by station and by bin."""
    from ..operators.scoring import stack_models

    f = b.forecast_frame(t).withColumn("blend", 0.5 * (F.col("y_pred") + F.col("y_curr"))).withColumn("bin", F.when(F.col("y_true") < 250, "low").otherwise("high"))
    s = stack_models(f, ["entity", "bin", "y_true"], {"model": "y_pred", "persistence": "y_curr", "blend": "blend"})
    sets = [[F.col("entity"), F.col("model")], [F.col("bin"), F.col("model")]]
    return s.groupingSets(sets, F.col("entity"), F.col("bin"), F.col("model")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("predicted") - F.col("y_true"))).alias("mae"))


# --------------------------------------------------------------------------------------------------------- roll-ups
_NOW = "TIMESTAMP '2024-01-30 12:00:00'"


def now_hour():
    return hour_number(F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))


_UPTO = f"""{b.INDEX_CTE}, stn AS (SELECT DISTINCT user_id // 50 AS entity FROM events), ix AS (SELECT entity, ts, index_value FROM idx WHERE index_value IS NOT NULL AND ts <= {_NOW} - to_hours(entity % 5 * 2)), rd AS (SELECT * FROM readings WHERE ts <= {_NOW}),
  ov AS (SELECT entity, i.v AS index_now, r.p AS pm25_now, i.t AS index_ts, r.t AS reading_ts, coalesce(date_diff('hour', i.t, {_NOW}) - 1 > 3, true) AS stale FROM stn
    LEFT JOIN (SELECT entity, max(ts) AS t, arg_max(index_value, ts) AS v FROM ix GROUP BY 1) i USING (entity) LEFT JOIN (SELECT entity, max(ts) AS t, arg_max(pm25, ts) FILTER (WHERE pm25 IS NOT NULL) AS p FROM rd GROUP BY 1) r USING (entity))"""


def stations(t: Tables):
    return b.station_events(t).select("entity").distinct()


def _current_index(t: Tables):
    return b.index(t).where(F.col("index_value").isNotNull() & (F.col(HOUR) <= now_hour() - F.col("entity") % 5 * 2)).select("entity", HOUR, "index_value")


def _overview(t: Tables):
    return sv.entity_overview(stations(t), _current_index(t), b.readings(t).where(F.col(HOUR) <= now_hour()), "entity", now_hour())


_CATSQL = "CASE WHEN {v} IS NULL THEN NULL WHEN {v} <= 50 THEN 'Good' WHEN {v} <= 100 THEN 'Satisfactory' WHEN {v} <= 200 THEN 'Moderate' WHEN {v} <= 300 THEN 'Poor' WHEN {v} <= 400 THEN 'Very Poor' ELSE 'Severe' END"


@query("entity_overview", f"WITH {_UPTO} SELECT entity, index_now, {_CATSQL.format(v='index_now')} AS category_now, pm25_now, index_ts, reading_ts, stale FROM ov", "index_now pm25_now")
def entity_overview(t: Tables):
    """Latest index, reading and PM2.5 per station with a stale flag."""
    o = _overview(t)
    o = with_label(o.withColumnRenamed("index_hour", HOUR), "index_ts").drop(HOUR)
    return with_label(o.withColumnRenamed("reading_hour", HOUR), "reading_ts").drop(HOUR)


@query(
    "network_overview",
    f"WITH {_UPTO}, m AS (SELECT count(index_now) FILTER (WHERE NOT stale) AS stations_with_data, count(*) AS stations_total, avg(index_now) FILTER (WHERE NOT stale) AS mean_index_now FROM ov) SELECT *, {_CATSQL.format(v='mean_index_now')} AS category_now FROM m",
    "mean_index_now",
)
def network_overview(t: Tables):
    """Fresh stations and the mean index now."""
    return sv.network_overview(_overview(t))


@query(
    "stage_counts",
    f"""WITH {_UPTO}, g AS (SELECT unnest(['I', 'II', 'III', 'IV']) AS stage, unnest(['Poor', 'Very Poor', 'Severe', 'Severe+']) AS label, unnest([201, 301, 401, 451]) AS lowest),
      s AS (SELECT CASE WHEN floor(index_now) >= 451 THEN 'IV' WHEN floor(index_now) >= 401 THEN 'III' WHEN floor(index_now) >= 301 THEN 'II' WHEN floor(index_now) >= 201 THEN 'I' END AS now, CASE WHEN floor(pm25_now) >= 451 THEN 'IV' WHEN floor(pm25_now) >= 401 THEN 'III' WHEN floor(pm25_now) >= 301 THEN 'II' WHEN floor(pm25_now) >= 201 THEN 'I' END AS fc FROM ov)
    SELECT stage, label, lowest, (SELECT count(*) FROM s WHERE now = stage) AS now_count, (SELECT count(*) FROM s WHERE fc = stage) AS forecast_count FROM g""",
)
def stage_counts(t: Tables):
    """Stations per stage now and in a second series."""
    return sv.stage_counts(_overview(t), {"now_count": "index_now", "forecast_count": "pm25_now"})


@query(
    "presence_grid",
    f"WITH {_UPTO}, sl AS (SELECT entity, unnest(generate_series({_NOW} - INTERVAL 24 HOUR, {_NOW} - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS ts FROM stn) SELECT sl.entity, sl.ts, r.ts IS NOT NULL AS present FROM sl LEFT JOIN readings r USING (entity, ts)",
)
def presence_grid(t: Tables):
    """Reported or not in each of the last 24 complete hours."""
    return with_label(sv.presence_grid(stations(t), b.readings(t), "entity", now_hour())).drop(HOUR)


@query(
    "forecast_coverage",
    f"WITH {b.FORECAST_CTE}, stn AS (SELECT DISTINCT user_id // 50 AS entity FROM events), i AS (SELECT count(DISTINCT (ts, entity)) AS issued FROM fc WHERE ts > {_NOW} - INTERVAL 24 HOUR) SELECT issued, least(1.0, issued / (SELECT count(*) * 24 FROM stn)) AS coverage FROM i",
    "coverage",
)
def forecast_coverage(t: Tables):
    """Distinct issued (hour, station) pairs over the possible ones."""
    return sv.forecast_coverage(stations(t), b.forecast_frame(t), "entity", now_hour())


_RUNS = """rn AS (SELECT date_trunc('hour', ts) AS started, user_id % 5 AS station, max(value) AS age FROM events GROUP BY ALL)"""


@query(
    "source_lag_by_day",
    f"""WITH {_RUNS}, r AS (SELECT started, quantile_cont(age, 0.5) AS m, max(age) AS x FROM rn GROUP BY 1) SELECT started::DATE AS day, quantile_cont(m, 0.5) AS median_hours, max(x) AS max_hours, count(*) AS runs FROM r GROUP BY 1""",
    "median_hours max_hours",
)
def source_lag_by_day(t: Tables):
    """Median of run medians and largest age per day, ages read from a JSON map per run."""
    cells = t.events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("started"), (F.col("user_id") % 5).cast("string").alias("station")).agg(F.max("value").alias("age"))
    # five stations per run, so the map of a run is bounded
    runs = cells.groupBy("started").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("station", "age")))).alias("details"))
    parsed = runs.withColumn("ages", F.from_json("details", "map<string,double>"))
    return sv.source_lag(parsed, "started", "ages")


@query("history_series", f"WITH {b.INDEX_CTE} SELECT ts, index_value FROM idx WHERE entity = 0 AND ts > {_NOW} - INTERVAL 72 HOUR AND index_value IS NOT NULL ORDER BY ts", "index_value")
def history_series(t: Tables):
    """Last 72 hours of one station."""
    return with_label(sv.history_series(b.index(t), "entity", 0, "index_value", now_hour())).select("ts", "index_value")


@query(
    "latest_measures",
    f"WITH {b.READINGS_CTE}, n AS (SELECT * FROM readings QUALIFY row_number() OVER (PARTITION BY entity ORDER BY ts DESC) = 1), l AS ({' UNION ALL '.join(f'''SELECT entity, '{m}' AS measure, {m} AS value FROM n''' for m in b.MEASURED)}) SELECT * FROM l WHERE value IS NOT NULL",
    "value",
)
def latest_measures(t: Tables):
    """Non-null measures of the newest reading."""
    return sv.latest_measures(b.readings(t), ["entity"], list(b.MEASURED))


def _skill_history_sql() -> str:
    from .score_queries import _ROLLING

    return f"WITH {_ROLLING}, h AS (SELECT target, horizon, window_end, n, skill_mae, skill_vs_window_update FROM rolling WHERE entity IS NULL), r AS (SELECT * FROM h WHERE window_end > (SELECT max(window_end) - 30 FROM h)) SELECT target, horizon, count(*) AS points, arg_max(skill_mae, window_end) AS current_vs_persistence, arg_max(n, window_end) AS n FROM r GROUP BY ALL"


@query("skill_series", _skill_history_sql(), "current_vs_persistence")
def skill_series(t: Tables):
    """Daily skill series per product and its last value."""
    from ..operators.scoring import rolling_skill
    from .score_queries import scores

    pooled = rolling_skill(scores(t), F.to_date("target_time"), "entity", days=30).where("entity IS NULL")
    s = sv.skill_series(pooled, days=30)
    return s.select("target", "horizon", F.size("series").cast("long").alias("points"), "current_vs_persistence", "n")


_PRODUCTS = (("aqi", 6), ("pm25", 6))
_STATUS = f"""{b.FORECAST_CTE}, stn AS (SELECT DISTINCT user_id // 50 AS entity FROM events), f AS (SELECT entity, ts, 'aqi' AS target, 6 AS horizon, y_pred AS y_hat FROM fc WHERE ts <= {_NOW} UNION ALL SELECT entity, ts, 'pm25', 6, y_pred / 2 FROM fc WHERE ts <= {_NOW} - to_hours(entity % 5)),
  nw AS (SELECT entity, target, horizon, max(ts) AS issue, arg_max(y_hat, ts) AS value FROM f GROUP BY ALL), cu AS (SELECT max(ts) AS cur FROM f WHERE ts > {_NOW} - INTERVAL 12 HOUR), pr AS (SELECT unnest(['aqi', 'pm25']) AS target, 6 AS horizon),
  j AS (SELECT s.entity, pr.target, pr.horizon, issue, value, cur, cur IS NULL OR date_diff('hour', cur, {_NOW}) > 4 AS job_stale FROM stn s CROSS JOIN pr CROSS JOIN cu LEFT JOIN nw USING (entity, target, horizon)),
  k AS (SELECT *, NOT job_stale AND coalesce(issue = cur, false) AS ok FROM j)"""


@query(
    "product_status",
    f"""WITH {_STATUS} SELECT entity, target, horizon, CASE WHEN ok THEN 'ok' ELSE 'unavailable' END AS status, CASE WHEN job_stale THEN 'the forecast job has not run recently' WHEN NOT ok THEN CASE WHEN target = 'pm25' AND entity = 1 THEN 'stale' WHEN entity = 2 THEN 'few rows' ELSE 'no forecast for this hour' END END AS reason,
      CASE WHEN ok THEN value END AS value, CASE WHEN job_stale THEN date_diff('hour', TIMESTAMP '1970-01-01', issue) END AS last_issue FROM k""",
    "value",
)
def product_status(t: Tables):
    """Status, reason and value of every product per station."""
    f = b.forecast_frame(t)
    now = now_hour()
    a = f.where(F.col(HOUR) <= now).select("entity", HOUR, F.lit("aqi").alias("target"), F.lit(6).alias("horizon"), F.col("y_pred").alias("y_hat"))
    p = f.where(F.col(HOUR) <= now - F.col("entity") % 5).select("entity", HOUR, F.lit("pm25").alias("target"), F.lit(6).alias("horizon"), (F.col("y_pred") / 2).alias("y_hat"))
    known = stations(t)
    r1 = known.where("entity = 1").select("entity", F.lit("pm25").alias("target"), F.lit(6).alias("horizon"), F.lit("stale").alias("reason"))
    r2 = known.where("entity = 2").select("entity", F.lit(None).cast("string").alias("target"), F.lit(None).cast("int").alias("horizon"), F.lit("few rows").alias("reason"))
    return sv.product_status(known, a.unionByName(p), r1.unionByName(r2), "entity", now, products=_PRODUCTS)


_ISSUE = "TIMESTAMP '2024-01-28 06:00:00'"
_VERD = f"""{b.INDEX_CTE}, h AS (SELECT * FROM idx WHERE ts <= {_ISSUE} - to_hours(entity % 5 * 2)), rdd AS (SELECT entity, max(ts) AS latest FROM readings WHERE ts <= {_ISSUE} - to_hours(entity % 5 * 2) GROUP BY 1),
  a AS (SELECT entity, max(index_value) FILTER (WHERE ts = {_ISSUE}) AS cur, count(index_value) FILTER (WHERE ts > {_ISSUE} - INTERVAL 336 HOUR) AS history_rows, count(no2) > 0 AS has_no2, avg((pm10 IS NULL)::INT) FILTER (WHERE ts > {_ISSUE} - INTERVAL 24 HOUR) AS missing FROM h GROUP BY 1),
  v AS (SELECT entity, CASE WHEN latest IS NULL THEN 'no readings' WHEN date_diff('hour', latest, {_ISSUE}) > 3 THEN 'stale' WHEN cur IS NULL THEN 'current index missing' WHEN NOT has_no2 THEN 'required group missing: no2' WHEN history_rows < 169 THEN 'insufficient history' WHEN missing > 0.9 THEN 'core features missing' END AS reason FROM a LEFT JOIN rdd USING (entity))"""


def verdicts(t: Tables):
    issue = hour_number(F.lit("2024-01-28 06:00:00").cast("timestamp_ntz"))
    known = F.col(HOUR) <= issue - F.col("entity") % 5 * 2
    latest = b.readings(t).where(known).groupBy("entity").agg(F.max(HOUR).alias("latest_hour"))
    h = b.index(t).where(known)
    a = h.groupBy("entity").agg(
        F.max(F.when(F.col(HOUR) == issue, F.col("index_value"))).alias("current"),
        F.count(F.when(F.col(HOUR) > issue - 336, F.col("index_value"))).alias("history_rows"),
        (F.count("no2") > 0).alias("has_no2"),
        F.avg(F.when(F.col(HOUR) > issue - 24, F.col("pm10").isNull().cast("double"))).alias("missing_share"),
    )
    return sv.station_verdicts(a.join(latest, "entity", "left"), "entity", required={"no2": "has_no2"}, issue_hour=issue, max_missing=0.9)


@query("station_verdicts", f"WITH {_VERD} SELECT entity, reason IS NULL AS ok, reason FROM v")
def station_verdicts(t: Tables):
    """Which stations may be forecast, with the first failing rule."""
    return verdicts(t)


@query(
    "run_status",
    f"""WITH {_VERD}, m AS (SELECT count(*) FILTER (WHERE reason IS NULL) AS done, count(*) AS stations, count(*) FILTER (WHERE reason IN ('stale', 'insufficient history')) AS d FROM v)
    SELECT done, stations, CASE WHEN done = 0 THEN CASE WHEN stations > 0 AND d = stations THEN 'stale' ELSE 'failed' END WHEN done = stations THEN 'success' ELSE 'partial' END AS status FROM m""",
)
def run_status(t: Tables):
    """Status of a forecast run."""
    return sv.run_status(verdicts(t))


@query("skip_reasons", f"WITH {_VERD} SELECT reason, count(*) AS stations FROM v WHERE reason IS NOT NULL GROUP BY 1 UNION ALL SELECT 'none', count(*) FROM v WHERE reason IS NULL")
def skip_reasons(t: Tables):
    """Stations skipped per reason; the forecast ones are listed under none."""
    v = verdicts(t)
    return sv.skip_reasons(v).unionByName(v.where("ok").agg(F.lit("none").alias("reason"), F.count(F.lit(1)).alias("stations")).select("reason", "stations"))


_FRESH = f"{_UPTO}, fr AS (SELECT entity, (date_diff('hour', max(r.ts), {_NOW}) - 1)::DOUBLE AS age_hours FROM stn LEFT JOIN (SELECT * FROM rd WHERE ts <= {_NOW} - to_hours(entity % 5 * 2)) r USING (entity) GROUP BY 1)"


def _fresh(t: Tables):
    return sv.freshness(b.readings(t).where(F.col(HOUR) <= now_hour() - F.col("entity") % 5 * 2), stations(t), "entity", now_hour())


@query("feed_freshness", f"WITH {_FRESH} SELECT entity, age_hours, coalesce(age_hours <= 3, false) AS fresh FROM fr", "age_hours")
def feed_freshness(t: Tables):
    """Age and state per station."""
    return _fresh(t)


@query("feed_status", f"WITH {_FRESH}, m AS (SELECT count(*) FILTER (WHERE age_hours <= 3) AS fresh_stations, count(*) AS stations FROM fr) SELECT *, CASE WHEN fresh_stations = 0 THEN 'stale' WHEN fresh_stations = stations THEN 'success' ELSE 'partial' END AS status FROM m")
def feed_status(t: Tables):
    """stale / partial / success of an ingest."""
    return sv.feed_status(_fresh(t))


@query(
    "replay_coverage",
    f"""WITH {b.FORECAST_CTE}, stn AS (SELECT DISTINCT user_id // 50 AS entity FROM events), f AS (SELECT entity, ts, 'aqi' AS target, 6 AS horizon FROM fc UNION ALL SELECT entity, ts, 'pm25', 6 FROM fc WHERE hour(ts) % 2 = 0),
      s AS (SELECT f.* FROM f JOIN readings r ON f.target = 'pm25' AND r.entity = f.entity AND r.ts = f.ts + INTERVAL 6 HOUR)
    SELECT target, horizon, (SELECT count(*) * (SELECT date_diff('hour', min(ts), max(ts)) + 1 FROM events) FROM stn) AS station_hours, count(*) AS forecast, count(*) / (SELECT count(*) * (SELECT date_diff('hour', min(ts), max(ts)) + 1 FROM events) FROM stn) AS forecast_share, (SELECT count(*) FROM s WHERE s.target = f.target) AS scored FROM f GROUP BY ALL""",
    "forecast_share",
)
def replay_coverage(t: Tables):
    """Possible, issued and scored station-hours per product."""
    f = b.forecast_frame(t)
    a = f.select("entity", HOUR, F.lit("aqi").alias("target"), F.lit(6).alias("horizon"))
    p = f.where(F.hour("ts") % 2 == 0).select("entity", HOUR, F.lit("pm25").alias("target"), F.lit(6).alias("horizon"))
    scored = p.join(b.readings(t).select("entity", (F.col(HOUR) - 6).alias(HOUR)), ["entity", HOUR], "left_semi")
    hours = t.events.agg(F.floor(F.unix_timestamp(F.max("ts").cast("timestamp")) / 3600) - F.floor(F.unix_timestamp(F.min("ts").cast("timestamp")) / 3600) + 1).scalar()
    possible = stations(t).agg(F.count(F.lit(1)) * hours).scalar()
    return sv.replay_coverage(a.unionByName(p), scored, possible)


@query(
    "assembled_forecasts",
    f"""WITH {b.INDEX_CTE}, b0 AS (SELECT entity, ts, index_value, pm25, CASE WHEN hour(ts) % 3 <> 0 THEN index_value END AS rule, CASE WHEN pm25 > 20 THEN pm25 * 0.9 END AS hat FROM idx WHERE index_value IS NOT NULL),
      l AS (SELECT entity, ts, 'aqi' AS target, 1 AS horizon, rule AS y_hat, index_value AS y_persistence, coalesce(rule, index_value) AS y_window_update FROM b0 UNION ALL SELECT entity, ts, 'pm25', 6, hat, pm25, NULL FROM b0)
    SELECT target, horizon, CASE WHEN y_hat IS NOT NULL AND y_persistence IS NOT NULL THEN 'kept' WHEN y_persistence IS NULL THEN 'no current ' || target || ' value at the issue hour' ELSE 'the model returned no value' END AS outcome, count(*) AS n FROM l GROUP BY ALL""",
)
def assembled_forecasts(t: Tables):
    """Products assembled per station; rows without a value dropped with a reason."""
    rows = b.index_ts(t).where("index_value IS NOT NULL").withColumn("rule", F.when(F.hour("ts") % 3 != 0, F.col("index_value"))).withColumn("hat", F.when(F.col("pm25") > 20, F.col("pm25") * 0.9))
    kept, dropped = sv.assemble_forecasts(rows, "entity", [("aqi", 1, "rule", "index_value", "rule"), ("pm25", 6, "hat", "pm25", None)])
    both = kept.select("target", "horizon", F.lit("kept").alias("outcome")).unionByName(dropped.select("target", "horizon", F.col("reason").alias("outcome")))
    return both.groupBy("target", "horizon", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query(
    "usage_by_day",
    "SELECT ts::DATE AS day, coalesce(sum((props->>'$.k')::BIGINT), 0)::BIGINT AS requests, count(*) AS runs FROM events GROUP BY 1",
)
def usage_by_day(t: Tables):
    """Requests per local day summed from the run log's JSON."""
    from ..streaming.jobs import usage_by_day as usage

    return usage(t.events, "ts", "props", "$.k", out="requests")


