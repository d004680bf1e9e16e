"""Forecast scoring: metric sets, skill intervals, rolling windows, alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hours import hour_label
from ..operators import bootstrap as bs, scoring as sc
from ..operators.grid import HOUR
from . import bindings as b
from .catalog import Tables, query
from .table_queries import MATURED_CTE, matured

DRAWS = 1000
_FC = b.FORECAST_CTE


def _day(ts: str = "ts"):
    return F.to_date(ts)


@query(
    "recompute_error_summary",
    f"""WITH {_FC} SELECT count(*) AS n, avg(abs(y_pred - y_true)) AS mae, quantile_cont(abs(y_pred - y_true), 0.5) AS median_abs_error, avg(y_pred - y_true) AS bias,
      avg((abs(y_pred - y_true) <= 5)::INT) AS share_within_5, avg((abs(y_pred - y_true) <= 10)::INT) AS share_within_10 FROM fc""",
    "mae median_abs_error bias share_within_5 share_within_10",
)
def recompute_error_summary(t: Tables):
    """Recomputed against official: counts, errors and shares within 5 and 10."""
    return sc.error_summary(b.forecast_frame(t), [], "y_true", "y_pred")


_PERIOD = "CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 'before' WHEN ts < TIMESTAMP '2024-01-21' THEN 'validation' ELSE 'test' END"


@query(
    "error_breakdown",
    f"""WITH {_FC}, f AS (SELECT entity, month(ts)::INT AS month, {_PERIOD} AS period, y_pred - y_true AS e FROM fc)
    SELECT entity, month, period, count(*) AS n, avg(abs(e)) AS mae, avg(e) AS bias FROM f GROUP BY GROUPING SETS ((entity), (month), (period))""",
    "mae bias",
)
def error_breakdown(t: Tables):
    """Errors by station, month and named period."""
    period = F.expr(_PERIOD.replace("TIMESTAMP '", "TIMESTAMP_NTZ '"))
    return sc.error_breakdown(b.forecast_frame(t), "entity", F.month("ts"), period, "y_true", "y_pred")


_METRICS = "mae rmse r2 mape mape_positive bias mae_extreme mae_severe"
_METRIC_SQL = """count(*) AS n, avg(abs(p - y)) AS mae, sqrt(avg((p - y) * (p - y))) AS rmse, 1 - sum((p - y) * (p - y)) / (count(*) * var_pop(y)) AS r2, 100 * avg(abs(p - y) / greatest(abs(y), 1)) AS mape,
  100 * avg(abs(p - y) / y) FILTER (WHERE y > 0) AS mape_positive, avg(p - y) AS bias, avg(abs(p - y)) FILTER (WHERE y >= 250) AS mae_extreme, avg(abs(p - y)) FILTER (WHERE y >= 280) AS mae_severe"""
_LONG = "l AS (SELECT entity, ts, 'model' AS model, y_true AS y, y_pred AS p, y_curr AS c FROM fc UNION ALL SELECT entity, ts, 'persistence', y_true, y_curr, y_curr FROM fc)"


def _stacked(t: Tables):
    return sc.stack_models(b.forecast_frame(t), ["entity", "ts", "y_true", "y_curr"], {"model": "y_pred", "persistence": "y_curr"})


@query("regression_metrics", f"WITH {_FC}, {_LONG} SELECT model, {_METRIC_SQL}, 100 * avg((sign(y - c) = sign(p - c))::INT) AS directional_accuracy FROM l GROUP BY 1", _METRICS + " directional_accuracy")
def regression_metrics(t: Tables):
    """Full metric set for model and persistence."""
    return sc.regression_metrics(_stacked(t), ["model"], "y_true", "predicted", current="y_curr", extreme=250.0, severe=280.0)


@query("metrics_by_station", f"WITH {_FC}, {_LONG} SELECT entity, model, {_METRIC_SQL} FROM l GROUP BY ALL", _METRICS)
def metrics_by_station(t: Tables):
    """Metric set per station and model."""
    return sc.regression_metrics(_stacked(t), ["entity", "model"], "y_true", "predicted", extreme=250.0, severe=280.0)


_RANGE = "CASE " + " ".join(f"WHEN y BETWEEN {lo} AND {hi} THEN '{label}'" for lo, hi, label in sc.RANGES) + " END"


@query("metrics_by_range", f"WITH {_FC}, {_LONG} SELECT {_RANGE} AS index_range, model, count(*) AS n, avg(abs(p - y)) AS mae, avg(p - y) AS bias FROM l WHERE {_RANGE} IS NOT NULL GROUP BY ALL", "mae bias")
def metrics_by_range(t: Tables):
    """Errors per index range and model; values between two ranges belong to none."""
    s = _stacked(t).withColumn("index_range", sc.range_label("y_true")).where("index_range IS NOT NULL")
    return sc.regression_metrics(s, ["index_range", "model"], "y_true", "predicted").select("index_range", "model", "n", "mae", "bias")


@query(
    "baseline_comparison",
    f"""WITH {_FC}, s AS (SELECT *, {_PERIOD} AS split, lag(y_curr, 18) OVER (PARTITION BY entity ORDER BY ts) AS seasonal, 2 * y_pred - y_curr AS ma FROM fc),
      l AS (SELECT split, 'persistence' AS model, y_true AS y, y_curr AS p, y_curr AS c FROM s UNION ALL SELECT split, 'seasonal', y_true, seasonal, y_curr FROM s UNION ALL SELECT split, 'moving_average', y_true, ma, y_curr FROM s)
    SELECT split, model, count(*) AS n, avg(abs(p - y)) AS mae, sqrt(avg((p - y) * (p - y))) AS rmse FROM l WHERE p IS NOT NULL GROUP BY ALL""",
    "mae rmse",
)
def baseline_comparison(t: Tables):
    """Heuristic baselines per split."""
    from ..operators.ordered import BLOCK_ROWS, row_index, with_frames

    f = row_index(b.forecast_frame(t), b.BY, HOUR, "row")
    f = with_frames(f, b.BY, "row", lambda w: {"seasonal": w.at("y_curr", -18)}, behind=18, block=BLOCK_ROWS)
    f = f.withColumn("split", F.expr(_PERIOD.replace("TIMESTAMP '", "TIMESTAMP_NTZ '"))).withColumn("ma", 2 * F.col("y_pred") - F.col("y_curr"))
    s = sc.stack_models(f, ["split", "y_true", "y_curr"], {"persistence": "y_curr", "seasonal": "seasonal", "moving_average": "ma"})
    return sc.regression_metrics(s, ["split", "model"], "y_true", "predicted", current="y_curr").select("split", "model", "n", "mae", "rmse")


# --------------------------------------------------------------------------------------------------------- bootstrap
def _draws_cte(keys: str) -> str:
    """Resampled totals per (keys, draw) from CTE ``ds`` (keys, day, n, sums...)."""
    return f"""num AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY day) - 1 AS no FROM ds), sz AS (SELECT {keys}, count(*) AS days FROM ds GROUP BY {keys}),
  op AS (SELECT {keys}, days, unnest(range({DRAWS})) AS draw FROM sz), op2 AS (SELECT *, unnest(range(days)) AS pos FROM op),
  a1 AS (SELECT *, ({bs.SEED} + (draw + 1) * 7919 + (pos + 1) * 104729) % {bs.PRIME} AS a FROM op2), a2 AS (SELECT *, (a * a + 48271) % {bs.PRIME} AS b FROM a1),
  pk AS (SELECT {keys}, draw, ((b * b + a) % {bs.PRIME}) % days AS no FROM a2)"""


_DS = "ds AS (SELECT entity, ts::DATE AS day, count(*)::DOUBLE AS n, sum(abs(y_pred - y_true)) AS am, sum((y_pred - y_true) ** 2) AS qm, sum(abs(y_curr - y_true)) AS ar, sum((y_curr - y_true) ** 2) AS qr FROM fc GROUP BY ALL)"


@query(
    "skill_intervals",
    f"""WITH {_FC}, {_DS}, {_draws_cte('entity')}, dr AS (SELECT entity, draw, sum(n) AS n, sum(am) AS am, sum(qm) AS qm, sum(ar) AS ar, sum(qr) AS qr FROM pk JOIN num USING (entity, no) GROUP BY ALL),
      ci AS (SELECT entity, {', '.join(f"quantile_cont({e}, {p}) AS {n}_{s}" for n, e in (('mae', 'am / n'), ('rmse', 'sqrt(qm / n)'), ('skill_mae', '1 - am / ar'), ('skill_rmse', '1 - sqrt(qm) / sqrt(qr)')) for s, p in (('lo', 0.025), ('hi', 0.975)))} FROM dr GROUP BY 1),
      pt AS (SELECT entity, sum(n)::BIGINT AS n, count(*) AS days, sum(am) / sum(n) AS mae, sqrt(sum(qm) / sum(n)) AS rmse, 1 - sum(am) / sum(ar) AS skill_mae, 1 - sqrt(sum(qm)) / sqrt(sum(qr)) AS skill_rmse FROM ds GROUP BY 1)
    SELECT * FROM pt JOIN ci USING (entity)""",
    " ".join(f"{n}{s}" for n in ("mae", "rmse", "skill_mae", "skill_rmse") for s in ("", "_lo", "_hi")),
)
def skill_intervals(t: Tables):
    """Point metrics and skill with day-block bootstrap intervals per station."""
    return sc.skill_intervals(b.forecast_frame(t), ["entity"], _day(), "y_true", "y_pred", "y_curr", draws=DRAWS)


@query(
    "paired_difference",
    f"""WITH {_FC}, ds AS (SELECT 1 AS k, ts::DATE AS day, count(*)::DOUBLE AS n, sum(abs(y_pred - y_true)) AS s, sum(abs(0.75 * y_curr + 0.25 * y_pred - y_true)) AS bb, sum(abs(y_curr - y_true)) AS p FROM fc GROUP BY ALL), {_draws_cte('k')},
      dr AS (SELECT draw, sum(n) AS n, sum(s) AS s, sum(bb) AS bb, sum(p) AS p FROM pk JOIN num USING (k, no) GROUP BY ALL)
    SELECT (SELECT sum(n)::BIGINT FROM ds) AS n, (SELECT sum(s) / sum(n) FROM ds) AS mae, (SELECT sum(p) / sum(n) FROM ds) AS mae_persistence, (SELECT sum(bb) / sum(n) FROM ds) AS mae_baseline, (SELECT 1 - sum(s) / sum(p) FROM ds) AS skill_mae,
      (SELECT (sum(s) - sum(bb)) / sum(n) FROM ds) AS delta_mae_vs_baseline, quantile_cont(1 - s / p, 0.025) AS skill_lo, quantile_cont(1 - s / p, 0.975) AS skill_hi, quantile_cont((s - bb) / n, 0.025) AS delta_mae_lo, quantile_cont((s - bb) / n, 0.975) AS delta_mae_hi FROM dr""",
    "mae mae_persistence mae_baseline skill_mae delta_mae_vs_baseline skill_lo skill_hi delta_mae_lo delta_mae_hi",
)
def paired_difference(t: Tables):
    """Paired error difference of two models with the same draws, over all rows."""
    f = b.forecast_frame(t).withColumn("base", 0.75 * F.col("y_curr") + 0.25 * F.col("y_pred"))
    return sc.paired_difference(f, [], _day(), "y_true", "y_pred", "base", "y_curr", draws=DRAWS)


@query(
    "brier_difference",
    f"""WITH {_FC}, r AS (SELECT entity, ts::DATE AS day, (y_true >= 250)::INT AS y, least(y_pred / 500, 1) AS pm, least(y_curr / 400, 1) AS pb FROM fc), ds AS (SELECT entity, day, count(*)::DOUBLE AS n, sum((pm - y) ** 2) AS m, sum((pb - y) ** 2) AS bb FROM r GROUP BY ALL), {_draws_cte('entity')},
      dr AS (SELECT entity, draw, sum(n) AS n, sum(m) AS m, sum(bb) AS bb FROM pk JOIN num USING (entity, no) GROUP BY ALL), ci AS (SELECT entity, quantile_cont((m - bb) / n, 0.025) AS brier_diff_lo, quantile_cont((m - bb) / n, 0.975) AS brier_diff_hi FROM dr GROUP BY 1),
      pt AS (SELECT entity, sum(m) / sum(n) AS brier_model, sum(bb) / sum(n) AS brier_baseline, (sum(m) - sum(bb)) / sum(n) AS brier_diff FROM ds GROUP BY 1) SELECT * FROM pt JOIN ci USING (entity)""",
    "brier_model brier_baseline brier_diff brier_diff_lo brier_diff_hi",
)
def brier_difference(t: Tables):
    """Brier scores of two probability forecasts with the interval of their difference."""
    f = b.forecast_frame(t)
    f = f.select("entity", "ts", (F.col("y_true") >= 250).cast("int").alias("y"), F.least(F.col("y_pred") / 500, F.lit(1.0)).alias("pm"), F.least(F.col("y_curr") / 400, F.lit(1.0)).alias("pb"))
    return sc.brier_difference(f, ["entity"], _day(), "y", "pm", "pb", draws=DRAWS)


_RULE = "CASE WHEN hour(ts) % 4 <> 0 THEN (y_pred + y_curr) / 2 END"


@query(
    "three_way_skill",
    f"""WITH {_FC}, r AS (SELECT entity, ts::DATE AS day, y_true, y_pred, y_curr, {_RULE} AS rule FROM fc), ds AS (SELECT entity, day, count(*)::DOUBLE AS n, sum(abs(y_pred - y_true)) AS m, sum(abs(coalesce(rule, y_curr) - y_true)) AS w, sum(abs(y_curr - y_true)) AS p, sum((rule IS NULL)::INT) AS f FROM r GROUP BY ALL), {_draws_cte('entity')},
      dr AS (SELECT entity, draw, sum(m) AS m, sum(w) AS w, sum(p) AS p FROM pk JOIN num USING (entity, no) GROUP BY ALL),
      ci AS (SELECT entity, {', '.join(f"quantile_cont(1 - {x}, {p}) AS {n}_{s}" for n, x in (('rule_vs_persistence', 'w / p'), ('model_vs_persistence', 'm / p'), ('model_vs_rule', 'm / w')) for s, p in (('lo', 0.025), ('hi', 0.975)))} FROM dr GROUP BY 1),
      tt AS (SELECT entity, sum(n) AS n, sum(f) AS f, sum(m) AS m, sum(w) AS w, sum(p) AS p FROM ds GROUP BY 1)
    SELECT entity, n::BIGINT AS n, f::BIGINT AS fallback_rows, p / n AS persistence_mae, w / n AS rule_mae, m / n AS model_mae, 1 - w / p AS rule_vs_persistence, 1 - m / p AS model_vs_persistence, 1 - m / w AS model_vs_rule,
      CASE WHEN p > m THEN (p - w) / (p - m) END AS share_of_gain_from_rule, ci.* EXCLUDE (entity) FROM tt JOIN ci USING (entity)""",
    "persistence_mae rule_mae model_mae share_of_gain_from_rule " + " ".join(f"{n}{s}" for n in ("rule_vs_persistence", "model_vs_persistence", "model_vs_rule") for s in ("", "_lo", "_hi")),
)
def three_way_skill(t: Tables):
    """Model, rule and persistence against each other, missing rule values falling back to persistence."""
    f = b.forecast_frame(t).withColumn("rule", F.expr(_RULE))
    return sc.three_way_skill(f, ["entity"], _day(), "y_true", "y_pred", "rule", "y_curr", draws=DRAWS)


# ------------------------------------------------------------------------------------------------------- live scores
_SCORES = f"""{MATURED_CTE}, scores AS (SELECT hash AS forecast_id, entity, target, 6 AS horizon, target_time, actual, abs(y_hat - actual) AS abs_err, abs(y_persistence - actual) AS abs_err_persistence,
    CASE WHEN target = 'aqi' THEN abs((y_hat + y_persistence) / 2 - actual) END AS abs_err_window_update, CASE WHEN target = 'aqi' THEN actual >= 401 END AS severe_actual FROM matured WHERE actual IS NOT NULL)"""


def scores(t: Tables):
    rule = F.when(F.col("target") == "aqi", (F.col("y_hat") + F.col("y_persistence")) / 2)
    m = matured(t).withColumn("horizon", F.lit(6)).withColumn("y_window_update", rule).withColumn("target_time", hour_label("target_hour"))
    return sc.score_frame(m)


@query("score_frame", f"WITH {_SCORES} SELECT * FROM scores", "actual abs_err abs_err_persistence abs_err_window_update")
def score_frame(t: Tables):
    """Absolute errors per matured forecast."""
    return scores(t).select("forecast_id", "entity", "target", "horizon", "target_time", "actual", "abs_err", "abs_err_persistence", "abs_err_window_update", "severe_actual")


@query(
    "product_skill",
    f"""WITH {_SCORES}, ds AS (SELECT target, horizon, target_time::DATE AS day, count(*)::DOUBLE AS n, sum(abs_err) AS m, sum(abs_err_persistence) AS p, sum(abs_err_window_update) AS w FROM scores GROUP BY ALL), {_draws_cte('target, horizon')},
      dr AS (SELECT target, horizon, draw, sum(m) AS m, sum(p) AS p, sum(w) AS w FROM pk JOIN num USING (target, horizon, no) GROUP BY ALL),
      ci AS (SELECT target, horizon, {', '.join(f"quantile_cont(1 - {x}, {q}) AS {n}_{s}" for n, x in (('skill_vs_persistence', 'm / p'), ('skill_vs_window_update', 'm / w')) for s, q in (('lo', 0.025), ('hi', 0.975)))} FROM dr GROUP BY ALL)
    SELECT target, horizon, sum(n)::BIGINT AS n, count(*) AS days, sum(m) / sum(n) AS mae_model, sum(p) / sum(n) AS mae_persistence, sum(w) / sum(n) AS mae_window_update, 1 - sum(m) / sum(p) AS skill_vs_persistence, 1 - sum(m) / sum(w) AS skill_vs_window_update,
      any_value(skill_vs_persistence_lo) AS skill_vs_persistence_lo, any_value(skill_vs_persistence_hi) AS skill_vs_persistence_hi, any_value(skill_vs_window_update_lo) AS skill_vs_window_update_lo, any_value(skill_vs_window_update_hi) AS skill_vs_window_update_hi
    FROM ds JOIN ci USING (target, horizon) GROUP BY ALL""",
    "mae_model mae_persistence mae_window_update " + " ".join(f"{n}{s}" for n in ("skill_vs_persistence", "skill_vs_window_update") for s in ("", "_lo", "_hi")),
)
def product_skill(t: Tables):
    """Skill per product against both stored references with intervals."""
    return sc.product_skill(scores(t), _day("target_time"), draws=DRAWS)


_ROLLING = f"""{_SCORES}, ends AS (SELECT DISTINCT target_time::DATE AS d FROM scores), mx AS (SELECT min(d) AS lo, max(d) AS hi FROM ends), days AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS window_end FROM mx),
  rolling AS (SELECT CASE WHEN grouping(entity) = 0 THEN entity END AS entity, horizon, target, window_end, count(*) AS n, avg(abs_err) AS mae_model, avg(abs_err_persistence) AS mae_persistence, 1 - sum(abs_err) / sum(abs_err_persistence) AS skill_mae,
    avg(abs_err_window_update) AS mae_window_update, 1 - sum(abs_err) / sum(abs_err_window_update) AS skill_vs_window_update
  FROM scores JOIN days ON target_time::DATE BETWEEN window_end - 29 AND window_end GROUP BY GROUPING SETS ((target, horizon, window_end), (entity, target, horizon, window_end)) HAVING count(*) >= 20)"""


@query("rolling_skill", f"WITH {_ROLLING} SELECT * FROM rolling", "mae_model mae_persistence skill_mae mae_window_update skill_vs_window_update")
def rolling_skill(t: Tables):
    """Trailing 30-day skill, pooled and per station."""
    return sc.rolling_skill(scores(t), _day("target_time"), "entity", days=30)


_STREAK = """st AS (SELECT target, horizon, max(CASE WHEN s IS NULL OR s >= 0 THEN window_end END) AS brk FROM hist GROUP BY ALL),
  streaks AS (SELECT target, horizon, count(*) FILTER (WHERE brk IS NULL OR window_end > brk) AS streak FROM hist JOIN st USING (target, horizon) GROUP BY ALL)"""


@query("negative_streaks", f"WITH {_ROLLING}, hist AS (SELECT target, horizon, window_end, skill_vs_window_update AS s FROM rolling WHERE entity IS NULL), {_STREAK} SELECT * FROM streaks")
def negative_streaks(t: Tables):
    """Trailing days with negative skill per product."""
    pooled = sc.rolling_skill(scores(t), _day("target_time"), "entity", days=30).where("entity IS NULL")
    return sc.negative_streak(pooled, ["target", "horizon"], "window_end", "skill_vs_window_update", "streak")


_RUNS = "runs AS (SELECT event_type AS job, CASE WHEN user_id % 3 = 0 THEN 'success' ELSE 'failed' END AS status, ts AS started_at FROM events)"


def runs(t: Tables):
    status = F.when(F.col("user_id") % 3 == 0, "success").otherwise("failed")
    return t.events.select(F.col("event_type").alias("job"), status.alias("status"), F.col("ts").alias("started_at"))


@query("failed_jobs", f"WITH {_RUNS}, l AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY job ORDER BY started_at DESC) <= 3) SELECT job, max(started_at) AS newest FROM l GROUP BY job HAVING bool_and(status = 'failed') AND count(*) = 3")
def failed_jobs(t: Tables):
    """Jobs whose newest runs all failed."""
    return sc.failed_streaks(runs(t), "job", "status", "started_at", last=3)


@query(
    "alert_table",
    f"""WITH {_ROLLING}, {_RUNS}, hist AS (SELECT target, horizon, window_end, skill_mae AS s FROM rolling WHERE entity IS NULL), {_STREAK},
      hist2 AS (SELECT target, horizon, window_end, skill_vs_window_update AS s FROM rolling WHERE entity IS NULL), {_STREAK.replace('streaks AS', 'streaks2 AS').replace('st AS', 'st2 AS').replace('FROM hist ', 'FROM hist2 ').replace('JOIN st ', 'JOIN st2 ')}
    SELECT 'skill-' || target || '-' || horizon || 'h' AS key, 'No gain over persistence in 7 daily windows: ' || target || ' at ' || horizon || 'h' AS title FROM streaks WHERE streak >= 7
    UNION ALL SELECT 'skill-vs-rule-aqi-' || horizon || 'h', 'Window update ahead in 7 daily windows: aqi at ' || horizon || 'h' FROM streaks2 WHERE streak >= 7 AND target = 'aqi' AND horizon IN (1, 6)
    UNION ALL SELECT 'job-' || job, '3 failed runs in a row: ' || job FROM (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY job ORDER BY started_at DESC) <= 3) GROUP BY job HAVING bool_and(status = 'failed') AND count(*) = 3""",
)
def alert_table(t: Tables):
    """Alerts from rolling skill and the run log."""
    pooled = sc.rolling_skill(scores(t), _day("target_time"), "entity", days=30).where("entity IS NULL")
    return sc.alert_table(pooled, runs(t), days=7, failures=3)


@query(
    "stall_decisions",
    f"""WITH {b.READINGS_CTE}, a AS (SELECT entity, day(ts)::INT AS day, date_diff('hour', max(ts), date_trunc('day', min(ts)) + INTERVAL 24 HOUR) - 1 + entity % 5 * 3 AS age FROM readings GROUP BY entity, day(ts), date_trunc('day', ts))
    SELECT entity, day, age::DOUBLE AS age, CASE WHEN age > 5 THEN CASE WHEN day % 2 = 0 THEN 'refresh' ELSE 'open' END WHEN age <= 2 AND day % 2 = 0 THEN 'close' ELSE 'none' END AS action FROM a""",
    "age",
)
def stall_decisions(t: Tables):
    """open / refresh / close / none per station and day from the age of its newest hour."""
    r = b.readings(t).withColumn("d", F.floor(F.col(HOUR) / 24))
    newest = r.groupBy("entity", "d").agg(F.max(HOUR).alias("h"))
    day = F.dayofmonth(hour_label("h"))
    aged = newest.select("entity", day.alias("day"), ((F.col("d") + 1) * 24 - F.col("h") - 1 + F.col("entity") % 5 * 3).cast("double").alias("age"))
    return aged.withColumn("action", sc.stall_decision(F.col("age"), F.col("day") % 2 == 0, stale_after=2.0, stall_after=5.0))
