"""Splits, regressions and fitted models over the feature matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as ft, isotonic as iso, models as md, regression as rg, scoring as sc, serving as sv, splits as sp
from ..operators.grid import HOUR, with_label
from ..operators.lineage import cut_lineage
from . import bindings as b
from .catalog import Tables, query

WINDOWS = {"val": ("2024-01-19 00:00:00", "2024-01-23 23:59:59"), "test": ("2024-01-24 00:00:00", "2024-01-31 23:59:59")}
VAL_START = WINDOWS["val"][0]
_SPLIT_SQL = "CASE WHEN ts BETWEEN TIMESTAMP '2024-01-19' AND TIMESTAMP '2024-01-23 23:59:59' THEN 'val' WHEN ts BETWEEN TIMESTAMP '2024-01-24' AND TIMESTAMP '2024-01-31 23:59:59' THEN 'test' ELSE 'train' END"


def split_frame(t: Tables):
    f = b.forecast_frame(t)
    return f.withColumn("split", sp.assign_split("ts", WINDOWS))


@query(
    "chronological_splits",
    f"""WITH {b.FORECAST_CTE}, s AS (SELECT *, {_SPLIT_SQL} AS split FROM fc) SELECT entity, split, count(*) AS n, count(*) FILTER (WHERE split = 'train' AND ts < TIMESTAMP '2024-01-19' - INTERVAL 24 HOUR) AS after_embargo,
      count(*) FILTER (WHERE split = 'val' AND ts + INTERVAL 6 HOUR <= TIMESTAMP '2024-01-23 23:59:59') AS strict_val FROM s GROUP BY ALL""",
)
def chronological_splits(t: Tables):
    """Rows per split, left after the embargo, and with the label inside the validation window."""
    s = split_frame(t)
    n = s.groupBy("entity", "split").agg(F.count(F.lit(1)).alias("n"))
    kept = sp.training_rows(s, "ts", VAL_START).groupBy("entity", "split").agg(F.count(F.lit(1)).alias("after_embargo"))
    strict = sp.strict_rows(s.where("split = 'val'"), "ts", 6, WINDOWS["val"][1]).groupBy("entity", "split").agg(F.count(F.lit(1)).alias("strict_val"))
    j = n.join(kept, ["entity", "split"], "left").join(strict, ["entity", "split"], "left")
    return j.fillna(0, ["after_embargo", "strict_val"])


@query(
    "target_statistics",
    f"""WITH {b.FORECAST_CTE}, s AS (SELECT {_SPLIT_SQL} AS split, y_true AS v FROM fc), u AS (SELECT * FROM s UNION ALL SELECT 'total', v FROM s)
    SELECT split, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS minimum, max(v) AS maximum, count(*) FILTER (WHERE v >= 270) AS extreme, 100.0 * count(*) FILTER (WHERE v >= 270) / count(*) AS extreme_pct,
      quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.95) AS p95 FROM u GROUP BY 1""",
    "mean std minimum maximum extreme_pct p25 p50 p75 p95",
)
def target_statistics(t: Tables):
    """Target distribution per split and in total."""
    return sp.target_statistics(split_frame(t), "split", "y_true", extreme=270.0)


@query(
    "rolling_folds",
    f"""WITH {b.FORECAST_CTE}, f AS (SELECT * FROM (VALUES ('first', TIMESTAMP '2024-01-15', TIMESTAMP '2024-01-18 23:59:59'), ('second', TIMESTAMP '2024-01-22', TIMESTAMP '2024-01-26 23:59:59')) v(fold, lo, hi))
    SELECT fold, CASE WHEN ts < lo - INTERVAL 24 HOUR THEN 'train' ELSE 'test' END AS part, count(*) AS n, avg(abs(y_pred - y_true)) AS mae FROM fc JOIN f ON ts < lo - INTERVAL 24 HOUR OR ts BETWEEN lo AND hi GROUP BY ALL""",
    "mae",
)
def rolling_folds(t: Tables):
    """Expanding train and fixed test rows per fold."""
    f = sp.fold_rows(b.forecast_frame(t), "ts", FOLDS)
    return f.groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("y_pred") - F.col("y_true"))).alias("mae"))


FOLDS = [("first", "2024-01-15 00:00:00", "2024-01-18 23:59:59"), ("second", "2024-01-22 00:00:00", "2024-01-26 23:59:59")]


@query(
    "blend_weights",
    f"""WITH {b.FORECAST_CTE}, w AS (SELECT unnest(range(21)) / 20.0 AS w), l AS (SELECT w, y_true AS y, w * y_curr + (1 - w) * y_pred AS p FROM fc, w)
    SELECT w::DOUBLE AS weight_naive, count(*) AS n, avg(abs(p - y)) AS mae, sqrt(avg((p - y) ** 2)) AS rmse, 1 - sum((p - y) ** 2) / (count(*) * var_pop(y)) AS r2, avg(p - y) AS bias, avg(abs(p - y)) FILTER (WHERE y >= 300) AS mae_extreme, avg(abs(p - y)) FILTER (WHERE y >= 400) AS mae_severe FROM l GROUP BY 1""",
    "weight_naive mae rmse r2 bias mae_extreme mae_severe",
)
def blend_weights(t: Tables):
    """Every blend weight of forecast and persistence scored in one pass."""
    return md.blend_grid(b.forecast_frame(t), "y_true", "y_pred", "y_curr")


# ------------------------------------------------------------------------------------------------------- regression
_DAILY = f"""{b.READINGS_CTE}, d AS (SELECT entity, ts::DATE AS day, avg(pm25) AS pm25, avg(no2) AS no2, avg(o3) AS o3 FROM readings GROUP BY ALL)"""


def daily(t: Tables):
    from ..operators.profiles import daily_means

    return daily_means(b.readings_ts(t), ["entity"], "ts", {"pm25": "pm25", "no2": "no2", "o3": "o3"})


@query(
    "station_effects_regression",
    f"""WITH {_DAILY}, r AS (SELECT entity, day, pm25 AS y, (date_diff('day', DATE '2024-01-16', day) > 0)::INT AS x FROM d WHERE day <> DATE '2024-01-16' AND pm25 IS NOT NULL),
      c AS (SELECT entity, day, y, x - avg(x) OVER (PARTITION BY entity) AS xt, y - avg(y) OVER (PARTITION BY entity) AS yt FROM r), bt AS (SELECT sum(xt * yt) / sum(xt * xt) AS beta, sum(xt * xt) AS sxx, count(*) AS n, count(DISTINCT entity) AS e, count(DISTINCT day) AS g FROM c),
      s AS (SELECT day, sum(xt * (yt - beta * xt)) AS s FROM c, bt GROUP BY 1)
    SELECT 'post' AS coef, beta AS estimate, sqrt((SELECT sum(s * s) FROM s) * g / (g - 1) * (n - 1) / (n - 1 - e)) / sxx AS std_err, n AS n_obs, g AS n_clusters FROM bt""",
    "estimate std_err",
)
def station_effects_regression(t: Tables):
    """Before/after shift with station effects and day-clustered errors."""
    d = rg.event_design(daily(t), "day", "2024-01-16").where("rel_day <> 0")
    return rg.clustered_ols(d, "pm25", ["post"], "day", effects="entity").select("coef", "estimate", "std_err", "n_obs", "n_clusters")


@query("event_study")
def event_study(t: Tables):
    """Pre-trend, before/after, station effects, controls, interrupted series and placebo."""
    return rg.event_study(daily(t), "pm25", "day", "2024-01-16", station="entity", controls=["no2", "o3"], placebo="2024-01-10")


@query("price_regression")
def price_regression(t: Tables):
    """Price on quantity, discount and tax with errors clustered by ship month, over every line item."""
    l = t.lineitem.select("l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", F.date_trunc("month", "l_shipdate").alias("month"))
    return rg.clustered_ols(l, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], "month", effects="l_returnflag")


_PRICE_SQL = """WITH l AS (SELECT l_extendedprice::DOUBLE AS y, l_quantity::DOUBLE AS a, l_discount::DOUBLE AS b, l_tax::DOUBLE AS c, l_returnflag AS e, date_trunc('month', l_shipdate) AS g FROM lineitem),
    z AS (SELECT g, e, y - avg(y) OVER w AS y, a - avg(a) OVER w AS a, b - avg(b) OVER w AS b, c - avg(c) OVER w AS c FROM l WINDOW w AS (PARTITION BY e)),
    m AS (SELECT count(*) AS n, count(DISTINCT e) AS e, count(DISTINCT g) AS g, sum(a * a) AS aa, sum(a * b) AS ab, sum(a * c) AS ac, sum(b * b) AS bb, sum(b * c) AS bc, sum(c * c) AS cc,
      sum(a * y) AS ay, sum(b * y) AS yb, sum(c * y) AS cy, sum(y * y) AS yy FROM z),
    d AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM m),
    i AS (SELECT *, (bb * cc - bc * bc) / det AS iaa, (ac * bc - ab * cc) / det AS iab, (ab * bc - ac * bb) / det AS iac, (aa * cc - ac * ac) / det AS ibb, (ab * ac - aa * bc) / det AS ibc, (aa * bb - ab * ab) / det AS icc FROM d),
    t AS (SELECT *, iaa * ay + iab * yb + iac * cy AS ba, iab * ay + ibb * yb + ibc * cy AS be, iac * ay + ibc * yb + icc * cy AS bg FROM i),
    s AS (SELECT z.g, sum(z.a * (z.y - ba * z.a - be * z.b - bg * z.c)) AS sa, sum(z.b * (z.y - ba * z.a - be * z.b - bg * z.c)) AS sb, sum(z.c * (z.y - ba * z.a - be * z.b - bg * z.c)) AS sc FROM z, t GROUP BY 1),
    k AS (SELECT *, sqrt(g / (g - 1.0) * (n - 1.0) / (n - 3.0 - e)) AS f, 1 - (yy - ba * ay - be * yb - bg * cy) / (SELECT count(*) * var_pop(y) FROM l) AS r2 FROM t)
    SELECT 'l_quantity' AS coef, ba AS estimate, f * sqrt((SELECT sum((iaa * sa + iab * sb + iac * sc) ** 2) FROM s)) AS std_err, r2 AS r_squared, n AS n_obs, g AS n_clusters FROM k
    UNION ALL SELECT 'l_discount', be, f * sqrt((SELECT sum((iab * sa + ibb * sb + ibc * sc) ** 2) FROM s)), r2, n, g FROM k
    UNION ALL SELECT 'l_tax', bg, f * sqrt((SELECT sum((iac * sa + ibc * sb + icc * sc) ** 2) FROM s)), r2, n, g FROM k"""


@query("price_effects", _PRICE_SQL, "estimate std_err r_squared", 4)
def price_effects(t: Tables):
    """The same regression without what follows from estimate and error."""
    return price_regression(t).select("coef", "estimate", "std_err", "r_squared", "n_obs", "n_clusters")


# ------------------------------------------------------------------------------------------------------------ models
BASE = ["aqi_curr", "aqi_lag_1h", "aqi_lag_3h", "aqi_lag_6h", "aqi_lag_12h", "aqi_lag_24h", "pm25_curr", "pm25_lag_1h", "pm10_curr", "no2_curr"]
ROLLS = ["aqi_roll_mean_6h", "aqi_roll_mean_24h", "aqi_roll_std_24h", "pm25_roll_mean_6h", "pm25_roll_mean_24h"]
EXTRA = ["aqi_lag_48h", "pm25_lag_24h", "o3_curr"]
CALENDAR = ["sin_hour", "cos_hour"]
TARGET, CURRENT = "target_aqi_6h", "aqi_curr"


def model_frame(t: Tables):
    """Feature rows with a six-hour target, their split and the daily cycle."""
    from ..functions.calendar import calendar_columns

    f = with_label(ft.entity_features(b.index(t), b.BY)).where(F.col(TARGET).isNotNull())
    cal = calendar_columns("ts")
    keep = ["entity", HOUR, "ts", TARGET, *BASE, *ROLLS, *EXTRA]
    out = f.select(*keep, *[cal[c].alias(c) for c in CALENDAR]).withColumn("split", sp.assign_split("ts", WINDOWS))
    return cut_lineage(out)


def _parts(f):
    return sp.training_rows(f, "ts", VAL_START), f.where("split = 'val'"), f.where("split = 'test'")


@query("ridge_blend")
def ridge_blend(t: Tables):
    """Ridge on train, half persistence, scored on the test split with day-block intervals per station."""
    train, _, test = _parts(model_frame(t))
    model = md.fit_ridge(train, BASE + ROLLS, TARGET, alpha=100.0)
    p = md.predict(model, test, BASE + ROLLS, keep=["entity", "ts", TARGET, CURRENT]).withColumn("prediction", md.blend("prediction", CURRENT))
    return sc.skill_intervals(p, ["entity"], F.to_date("ts"), TARGET, "prediction", CURRENT, draws=1000)


@query("alpha_sweep")
def alpha_sweep(t: Tables):
    """Validation metrics per ridge penalty."""
    train, val, _ = _parts(model_frame(t))
    return md.alpha_sweep(train, val, BASE + ROLLS, TARGET, CURRENT, [10.0, 100.0, 1000.0])


@query("feature_set_comparison")
def feature_set_comparison(t: Tables):
    """Validation metrics per candidate feature set."""
    train, val, _ = _parts(model_frame(t))
    sets = md.feature_sets(BASE, ROLLS, EXTRA, CALENDAR, EXTRA)
    return md.compare_feature_sets(train, val, sets, TARGET, CURRENT, alpha=100.0)


@query("tree_variants")
def tree_variants(t: Tables):
    """Boosted trees in level and delta form, with and without calendar, against the ridge blend."""
    train, val, _ = _parts(model_frame(t))
    return md.tree_variants(train, val, BASE, CALENDAR, TARGET, CURRENT)


@query("group_ablation")
def group_ablation(t: Tables):
    """Feature groups added one by one; the oracle group is never eligible, an empty group is reported as not run."""
    train, val, _ = _parts(model_frame(t))
    groups = {"base": BASE, "base+rolling": BASE + ROLLS, "oracle": BASE + ["o3_curr"], "satellite": []}
    return md.group_ablation(train, val, groups, TARGET, CURRENT, ineligible=["oracle"])


@query("severe_event_classifier")
def severe_event_classifier(t: Tables):
    """Probability of a high index in six hours, scored by Brier and ranking areas."""
    from ..operators import classify as cl

    train, _, test = _parts(model_frame(t).withColumn("high", (F.col(TARGET) >= 260).cast("int")))
    model = md.fit_event_classifier(train, BASE + ROLLS, "high")
    p = cut_lineage(md.event_probability(model, test, BASE + ROLLS, keep=["entity", "high"]))
    areas = cl.ranking_areas(p, [], F.col("high") == 1, "probability")
    return areas.withColumn("brier", p.agg(cl.brier("high", "probability")).scalar())


@query(
    "isotonic_steps",
    f"""WITH {b.FORECAST_CTE}, c AS (SELECT floor(y_pred * 10 + 0.500001)::BIGINT AS x, count(*) AS n, sum(y_true) AS s FROM fc GROUP BY 1),
    o AS (SELECT x, n, s, row_number() OVER (ORDER BY x) AS i, sum(n) OVER (ORDER BY x) AS cn, sum(s) OVER (ORDER BY x) AS cs FROM c),
    m AS (SELECT j.i AS j, k.i AS i, min((k.cs - j.cs + j.s) / (k.cn - j.cn + j.n)) OVER (PARTITION BY j.i ORDER BY k.i DESC) AS least FROM o j JOIN o k ON k.i >= j.i)
    SELECT x, any_value(n) AS n, max(least) AS fitted FROM m JOIN o USING (i) GROUP BY x""",
    "fitted",
)
def isotonic_steps(t: Tables):
    """Monotone fit of the truth on the forecast in tenths: its value for every value of the forecast."""
    f = cut_lineage(b.forecast_frame(t).select(F.floor(F.col("y_pred") * 10 + 0.500001).cast("long").alias("x"), "y_true"))
    counted = f.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    return iso.isotonic_fit(f, "x", "y_true").apply(counted, "x", "fitted")


@query("isotonic_calibration")
def isotonic_calibration(t: Tables):
    """Monotone calibration fitted on train, errors before and after on both parts."""
    f = cut_lineage(split_frame(t))
    train, val, _ = _parts(f)
    return md.calibration_report(train, {"train": train, "val": val}, "y_pred", "y_true")


@query("rolling_origin")
def rolling_origin(t: Tables):
    """Ridge blend refitted per fold with intervals, one row per fold."""
    p = md.rolling_origin(model_frame(t), "ts", FOLDS, BASE + ROLLS, TARGET, CURRENT, alpha=100.0)
    return sc.skill_intervals(p, ["fold"], F.to_date("ts"), TARGET, "prediction", CURRENT, draws=1000)


def two_feature_frame(t: Tables):
    """Forecast rows with the measured PM2.5 of their hour, which has gaps: two features that SQL can solve for."""
    return b.forecast_frame(t).join(b.readings(t).select("entity", HOUR, "pm25"), ["entity", HOUR], "left")


_TWO = f"""{b.FORECAST_CTE}, x AS (SELECT fc.entity, fc.ts, y_true AS y, y_curr AS c, pm25 AS p FROM fc LEFT JOIN readings r ON r.entity = fc.entity AND r.ts = fc.ts)"""


def two_feature_ridge(source: str, keys: str, alpha: str) -> str:
    """CTEs ``md`` and ``w``: medians, and the two weights of a ridge on z-scores, per ``keys`` of the rows of ``source``."""
    return f"""md AS (SELECT {keys}, quantile_cont(c, 0.5) AS mc, quantile_cont(p, 0.5) AS mp FROM {source} GROUP BY ALL),
    tf AS (SELECT {keys}, y, coalesce(c, mc) AS c, coalesce(p, mp) AS p FROM {source} JOIN md USING ({keys})),
    st AS (SELECT {keys}, count(*) AS n, avg(y) AS ym, avg(c) AS cm, avg(p) AS pm, stddev_pop(c) AS cs, stddev_pop(p) AS ps, covar_pop(c, p) AS cp, covar_pop(c, y) AS cy, covar_pop(p, y) AS py FROM tf GROUP BY ALL),
    sy AS (SELECT *, n + {alpha} AS d, n * cp / (cs * ps) AS o, n * cy / cs AS b1, n * py / ps AS b2 FROM st),
    w AS (SELECT *, (b1 * d - o * b2) / (d * d - o * o) AS w1, (d * b2 - o * b1) / (d * d - o * o) AS w2 FROM sy)"""


_RIDGE_SQL = "ym + w1 * (coalesce(c, mc) - cm) / cs + w2 * (coalesce(p, mp) - pm) / ps"
_FOLD_SQL = f"""WITH {_TWO}, f AS (SELECT * FROM (VALUES ('first', TIMESTAMP '2024-01-15', TIMESTAMP '2024-01-18 23:59:59'), ('second', TIMESTAMP '2024-01-22', TIMESTAMP '2024-01-26 23:59:59')) v(fold, lo, hi)),
    tr AS (SELECT fold, y, c, p FROM x JOIN f ON ts < lo - INTERVAL 24 HOUR), {two_feature_ridge("tr", "fold", "1000")},
    te AS (SELECT fold, n AS n_train, y, c, 0.5 * c + 0.5 * ({_RIDGE_SQL}) AS p FROM x JOIN f ON ts BETWEEN lo AND hi JOIN md USING (fold) JOIN w USING (fold)),
    sc AS (SELECT fold, n_train, count(*) AS n_test, avg(abs(p - y)) AS mae, sqrt(avg((p - y) ** 2)) AS rmse, 1 - sum((p - y) ** 2) / (count(*) * var_pop(y)) AS r2,
      avg(abs(c - y)) AS persistence_mae, sqrt(avg((c - y) ** 2)) AS persistence_rmse FROM te GROUP BY ALL),
    folds AS (SELECT *, 1 - mae / persistence_mae AS skill_mae, 1 - rmse / persistence_rmse AS skill_rmse FROM sc)"""


def _fold_scores(t: Tables):
    p = md.rolling_origin(two_feature_frame(t), "ts", FOLDS, ["y_curr", "pm25"], "y_true", "y_curr")
    return md.fold_scores(p, "y_true", "y_curr")


@query("rolling_origin_folds", f"{_FOLD_SQL} SELECT * FROM folds", "mae rmse r2 persistence_mae persistence_rmse skill_mae skill_rmse")
def rolling_origin_folds(t: Tables):
    """Scores of the blend of a two-feature ridge and persistence per fold."""
    return _fold_scores(t)


@query(
    "rolling_origin_summary",
    f"{_FOLD_SQL} SELECT avg(skill_mae) AS mean_skill_mae, stddev_pop(skill_mae) AS std_skill_mae, avg(skill_rmse) AS mean_skill_rmse, stddev_pop(skill_rmse) AS std_skill_rmse, count(*) AS folds FROM folds",
    "mean_skill_mae std_skill_mae mean_skill_rmse std_skill_rmse",
)
def rolling_origin_summary(t: Tables):
    """Mean and population deviation of both skills over the folds."""
    return md.fold_summary(_fold_scores(t), "skill_mae", "skill_rmse")


@query(
    "penalty_sweep",
    f"""WITH {_TWO}, s AS (SELECT *, {_SPLIT_SQL} AS split FROM x), tr AS (SELECT alpha, y, c, p FROM s, (SELECT unnest([10.0, 1000.0, 100000.0])::DOUBLE AS alpha) WHERE split = 'train' AND ts < TIMESTAMP '2024-01-19' - INTERVAL 24 HOUR),
      {two_feature_ridge("tr", "alpha", "alpha")}, pr AS (SELECT alpha, y, c, {_RIDGE_SQL} AS r FROM s, w JOIN md USING (alpha) WHERE split = 'val'),
      l AS (SELECT alpha, 'ridge' AS model, y, r AS p FROM pr UNION ALL SELECT alpha, 'blend', y, 0.5 * c + 0.5 * r FROM pr)
    SELECT alpha, model, count(*) AS n, avg(abs(p - y)) AS mae, sqrt(avg((p - y) ** 2)) AS rmse, 1 - sum((p - y) ** 2) / (count(*) * var_pop(y)) AS r2 FROM l GROUP BY ALL""",
    "alpha mae rmse r2",
)
def penalty_sweep(t: Tables):
    """Validation metrics of a two-feature ridge and its blend per penalty."""
    f = two_feature_frame(t).withColumn("split", sp.assign_split("ts", WINDOWS))
    return md.alpha_sweep(sp.training_rows(f, "ts", VAL_START), f.where("split = 'val'"), ["y_curr", "pm25"], "y_true", "y_curr", [10.0, 1000.0, 100000.0])


AUDIT_SCENARIOS = {"baseline": {}, "no_no2": {"*": ["no2_curr"]}, "no_pm10_one": {0: ["pm10_curr"]}, "no_pm25": {"*": ["pm25_curr", "pm25_lag_1h", "pm25_roll_mean_6h", "pm25_roll_mean_24h"]}}
HORIZONS = {1: "target_aqi_1h", 6: "target_aqi_6h", 24: "target_aqi_24h"}


@query("availability_audit")
def availability_audit(t: Tables):
    """Scenarios of missing inputs x three horizons x row sets, with paired differences from the unmasked prediction."""
    f = with_label(ft.entity_features(b.index(t), b.BY)).where(F.col(CURRENT).isNotNull())
    f = cut_lineage(f.select("entity", "ts", *HORIZONS.values(), *BASE, *ROLLS).withColumn("split", sp.assign_split("ts", WINDOWS)))
    train, val, _ = _parts(f)
    return md.availability_audit(train, val, AUDIT_SCENARIOS, HORIZONS, BASE + ROLLS, "entity", "ts", CURRENT, WINDOWS["val"][1], alpha=100.0)


@query("exogenous_ablation")
def exogenous_ablation(t: Tables):
    """Panels x families x driver groups: the oracle group is scored but never chosen, drivers without columns are not run."""
    from ..operators import exogenous as ex

    driver = b.readings(t).select("entity", HOUR, F.col("no2").alias("wx"))
    f = cut_lineage(ex.attach_hourly(model_frame(t), driver, b.BY, ["wx"]))
    train, val, test = _parts(f)
    base, causal, oracle = BASE + ROLLS, ["wx_mean24"], ["wx_mean24", "wx_plus24"]
    groups = {"baseline": base, "+weather_causal": base + causal, "+weather_oracle": base + oracle, "+fires": None, "+weather_causal+fires": None}
    panels = {"full": (F.lit(True), groups), "late_window": (F.col("ts") >= F.lit("2024-01-08").cast("timestamp_ntz"), {**groups, "baseline": base + ["o3_curr"]})}
    return md.exogenous_ablation(train, {"val": val, "test": test}, panels, TARGET, CURRENT, oracle=["+weather_oracle"], alpha=100.0)


@query("scenario_audit")
def scenario_audit(t: Tables):
    """One model on masked scenarios over the same rows, paired with the baseline prediction."""
    from ..operators.cleaning import mask_scenario

    f = model_frame(t)
    train, val, _ = _parts(f)
    cols = BASE + ROLLS
    model = md.fit_ridge(train, cols, TARGET, alpha=100.0)
    frames = {"baseline": val, "no_no2": mask_scenario(val, "entity", {"*": ["no2_curr"]}), "no_pm10_one": mask_scenario(val, "entity", {0: ["pm10_curr"]})}
    p = cut_lineage(md.scenario_predictions(model, frames, cols, ["entity", HOUR], TARGET, CURRENT))
    base = p.where("scenario = 'baseline'").select("entity", HOUR, F.col("prediction").alias("base"))
    return sc.paired_difference(with_label(p.join(base, ["entity", HOUR])), ["scenario"], F.to_date("ts"), TARGET, "prediction", "base", CURRENT, draws=1000)


@query("replayed_forecasts")
def replayed_forecasts(t: Tables):
    """Forecasts for every issue hour at once from features that only look back."""
    f = model_frame(t)
    train, _, _ = _parts(f)
    model = md.fit_ridge(train, BASE + ROLLS, TARGET, alpha=100.0)
    return with_label(md.replay(f, model, BASE + ROLLS, b.BY, CURRENT)).drop("target_hour", HOUR)


@query("gain_by_family")
def gain_by_family(t: Tables):
    """Share of the split gains per feature family."""
    train, _, _ = _parts(model_frame(t))
    model = md.fit_trees(train, BASE + ROLLS, TARGET, current=CURRENT)
    family = F.when(F.col("feature").contains("_roll_"), "rolling").when(F.col("feature").contains("_lag_"), "lag").otherwise("current")
    return sv.family_share(md.importance_table(model, BASE + ROLLS, train), "feature", "gain", family)
