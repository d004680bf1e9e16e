"""Forecast scores: metric sets, skill with day-block intervals, rolling windows, streaks, alerts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import wraps

from pyspark.sql import Column, DataFrame, functions as F

from . import bootstrap as bs
from .lineage import cut_lineage
from .ranks import quantiles

SEVERE = 401.0
WINDOW_DAYS = 30
MIN_WINDOW_ROWS = 20


# ------------------------------------------------------------------------------------------------------- metric sets
def error_summary(df: DataFrame, by: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """n, MAE, exact median absolute error, bias and shares within 5 and 10."""
    both = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    err = F.col(predicted) - F.col(actual)
    rows = both.select(*by, err.alias("e"), F.abs(err).alias("a"))
    base = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("a").alias("mae"),
        F.avg("e").alias("bias"),
        F.avg((F.col("a") <= 5).cast("double")).alias("share_within_5"),
        F.avg((F.col("a") <= 10).cast("double")).alias("share_within_10"),
    )
    median = quantiles(rows, by, "a", {"median_abs_error": 0.5})
    return base.join(median, list(by)) if by else base.select("*", median.scalar().alias("median_abs_error"))


def error_breakdown(df: DataFrame, entity: str, month: Column, period: Column, actual: str, predicted: str) -> DataFrame:
    """MAE and bias by entity, by month and by named period in one pass over grouping sets."""
    err = F.col(predicted) - F.col(actual)
    rows = df.where(err.isNotNull()).select(entity, month.alias("month"), period.alias("period"), err.alias("e"))
    sets = [[F.col(entity)], [F.col("month")], [F.col("period")]]
    return rows.groupingSets(sets, F.col(entity), F.col("month"), F.col("period")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs("e")).alias("mae"), F.avg("e").alias("bias")
    )


def regression_metrics(
    df: DataFrame, by: Sequence[str], actual: str, predicted: str, *, current: str | None = None, extreme: float = 300.0, severe: float = 400.0
) -> DataFrame:
    """Every point metric in one pass: MAE, RMSE, R2, both MAPE conventions, bias, extreme errors, directional accuracy.

    R2 is 1 - SSE / (n * var_pop(actual)); the variance is accumulated around a running mean, so no digits are lost.
    """
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    ok = y.isNotNull() & p.isNotNull() & ~F.isnan(y) & ~F.isnan(p)
    if current is not None:
        ok = ok & F.col(current).isNotNull()
    rows = df.where(ok).select(
        *by, y.alias("y"), (p - y).alias("e"), *([] if current is None else [(F.signum(y - F.col(current)) == F.signum(p - F.col(current))).alias("same")])
    )
    n, a = F.count(F.lit(1)), F.abs("e")
    sse = F.sum(F.col("e") * F.col("e"))
    spread = n * F.var_pop("y")
    aggs = [
        n.alias("n"),
        F.avg(a).alias("mae"),
        F.sqrt(sse / n).alias("rmse"),
        F.when(spread > 0, 1 - sse / spread).alias("r2"),
        (100 * F.avg(a / F.greatest(F.abs("y"), F.lit(1.0)))).alias("mape"),
        (100 * F.avg(F.when(F.col("y") > 0, a / F.col("y")))).alias("mape_positive"),
        F.avg("e").alias("bias"),
        F.avg(F.when(F.col("y") >= extreme, a)).alias("mae_extreme"),
        F.avg(F.when(F.col("y") >= severe, a)).alias("mae_severe"),
    ]
    if current is not None:
        aggs.append((100 * F.avg(F.col("same").cast("double"))).alias("directional_accuracy"))
    return rows.groupBy(*by).agg(*aggs)


# Index ranges of the breakdown; values between two ranges (50..51 and so on) belong to none.
RANGES = ((0, 50, "Good (0-50)"), (51, 100, "Satisfactory (51-100)"), (101, 200, "Moderate (101-200)"),
          (201, 300, "Poor (201-300)"), (301, 400, "Very Poor (301-400)"), (401, 500, "Severe (401-500)"))


def range_label(value: str) -> Column:
    expr = None
    for low, high, label in RANGES:
        expr = (F if expr is None else expr).when(F.col(value).between(low, high), label)
    return expr


def stack_models(df: DataFrame, keep: Sequence[str], models: Mapping[str, str], *, out: str = "predicted") -> DataFrame:
    """One row per (row, model), unpivoted inside the row."""
    cells = F.array(*[F.struct(F.lit(name).alias("model"), F.col(c).alias(out)) for name, c in models.items()])
    return df.select(*keep, F.inline(cells))


# ---------------------------------------------------------------------------------------------- skill with intervals
def _grouped(score):
    """Let a score be taken over all rows: without keys one constant key is added for the joins and dropped again."""

    @wraps(score)
    def run(df: DataFrame, by: Sequence[str], *args, **kw) -> DataFrame:
        if by:
            return score(df, by, *args, **kw)
        return score(df.withColumn("__all", F.lit(0)), ["__all"], *args, **kw).drop("__all")

    return run


def _error_sums(actual: str, columns: Mapping[str, str]) -> dict[str, Column]:
    out = {}
    for name, c in columns.items():
        e = F.col(c) - F.col(actual)
        out[f"a_{name}"], out[f"q_{name}"] = F.abs(e), e * e
    return out


@_grouped
def skill_intervals(
    df: DataFrame, by: Sequence[str], day: Column, actual: str, model: str, reference: str, *, draws: int = bs.DRAWS, seed: int = bs.SEED, pick=bs.portable_pick
) -> DataFrame:
    """MAE, RMSE and both skills of a model against a reference, with 95 % day-block intervals."""
    sums = bs.day_sums(df, by, day, _error_sums(actual, {"m": model, "r": reference}))
    names = ["a_m", "q_m", "a_r", "q_r"]
    n = F.col("n")

    def stats(c) -> dict[str, Column]:
        return {
            "mae": c("a_m") / n,
            "rmse": F.sqrt(c("q_m") / n),
            "skill_mae": bs.skill(c("a_m"), c("a_r")),
            "skill_rmse": bs.skill(F.sqrt(c("q_m")), F.sqrt(c("q_r"))),
        }

    totals = sums.groupBy(*by).agg(F.count(F.lit(1)).alias("days"), F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names])
    points = totals.select(*by, F.col("n").cast("long").alias("n"), "days", *[c.alias(k) for k, c in stats(F.col).items()])
    bands = bs.intervals(bs.resample(sums, by, names, draws=draws, seed=seed, pick=pick), by, stats(F.col))
    return points.join(bands, list(by))


@_grouped
def paired_difference(
    df: DataFrame, by: Sequence[str], day: Column, actual: str, model: str, baseline: str, persistence: str, *, draws: int = bs.DRAWS, seed: int = bs.SEED, pick=bs.portable_pick
) -> DataFrame:
    """Skill against persistence and paired MAE difference against a baseline model, from the same draws."""
    errs = {n: F.abs(F.col(c) - F.col(actual)) for n, c in (("s", model), ("b", baseline), ("p", persistence))}
    sums = bs.day_sums(df, by, day, errs)
    totals = sums.groupBy(*by).agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in errs])
    n = F.col("n")
    stats = {"skill": bs.skill(F.col("s"), F.col("p")), "delta_mae": (F.col("s") - F.col("b")) / n}
    points = totals.select(
        *by, n.cast("long").alias("n"), (F.col("s") / n).alias("mae"), (F.col("p") / n).alias("mae_persistence"), (F.col("b") / n).alias("mae_baseline"),
        stats["skill"].alias("skill_mae"), stats["delta_mae"].alias("delta_mae_vs_baseline"),
    )
    bands = bs.intervals(bs.resample(sums, by, list(errs), draws=draws, seed=seed, pick=pick), by, stats)
    return points.join(bands, list(by))


@_grouped
def brier_difference(
    df: DataFrame, by: Sequence[str], day: Column, outcome: str, model: str, baseline: str, *, draws: int = bs.DRAWS, seed: int = bs.SEED, pick=bs.portable_pick
) -> DataFrame:
    """Brier scores of two probability forecasts and the interval of their difference."""
    y = F.col(outcome).cast("double")
    errs = {"m": (F.col(model) - y) * (F.col(model) - y), "b": (F.col(baseline) - y) * (F.col(baseline) - y)}
    sums = bs.day_sums(df, by, day, errs)
    totals = sums.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum("b").alias("b"))
    stats = {"brier_diff": (F.col("m") - F.col("b")) / F.col("n")}
    points = totals.select(*by, (F.col("m") / F.col("n")).alias("brier_model"), (F.col("b") / F.col("n")).alias("brier_baseline"), stats["brier_diff"].alias("brier_diff"))
    bands = bs.intervals(bs.resample(sums, by, ["m", "b"], draws=draws, seed=seed, pick=pick), by, stats)
    return points.join(bands, list(by))


@_grouped
def three_way_skill(
    df: DataFrame, by: Sequence[str], day: Column, actual: str, model: str, rule: str, persistence: str, *, draws: int = bs.DRAWS, seed: int = bs.SEED, pick=bs.portable_pick
) -> DataFrame:
    """Model against persistence, rule against persistence and model against rule from one set of draws.

    A missing rule value falls back to persistence and is counted.
    """
    used = F.coalesce(F.col(rule), F.col(persistence))
    rows = df.withColumn("__rule", used)
    errs = {n: F.abs(F.col(c) - F.col(actual)) for n, c in (("m", model), ("w", "__rule"), ("p", persistence))}
    errs["f"] = F.col(rule).isNull().cast("double")
    sums = bs.day_sums(rows, by, day, errs)
    totals = sums.groupBy(*by).agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in errs])
    n, m, w, p = (F.col(c) for c in ("n", "m", "w", "p"))
    stats = {"rule_vs_persistence": bs.skill(w, p), "model_vs_persistence": bs.skill(m, p), "model_vs_rule": bs.skill(m, w)}
    points = totals.select(
        *by, n.cast("long").alias("n"), F.col("f").cast("long").alias("fallback_rows"), (p / n).alias("persistence_mae"), (w / n).alias("rule_mae"), (m / n).alias("model_mae"),
        *[c.alias(k) for k, c in stats.items()], F.when(p > m, (p - w) / (p - m)).alias("share_of_gain_from_rule"),
    )
    bands = bs.intervals(bs.resample(sums, by, ["m", "w", "p"], draws=draws, seed=seed, pick=pick), by, stats)
    return points.join(bands, list(by))


class DriftError(ValueError):
    """A rebuilt series disagrees with the stored one."""


def require_same(df: DataFrame, left: str, right: str, *, tolerance: float = 1e-6) -> float:
    """Largest absolute difference of two columns; raises beyond the tolerance. One number reaches the driver."""
    worst = df.agg(F.max(F.abs(F.col(left) - F.col(right)))).first()[0]
    if worst is None or not worst < tolerance:
        raise DriftError(f"{left} and {right} disagree (largest difference {worst})")
    return worst


# ------------------------------------------------------------------------------------------------------- live scores
def score_frame(matured: DataFrame) -> DataFrame:
    """Absolute errors of the model and both references; the severe flag exists only for the index."""
    actual = F.col("actual")
    err = lambda c: F.abs(F.col(c) - actual)
    return matured.where(actual.isNotNull()).select(
        "*",
        err("y_hat").alias("abs_err"),
        err("y_persistence").alias("abs_err_persistence"),
        err("y_window_update").alias("abs_err_window_update"),
        F.when(F.col("target") == "aqi", actual >= SEVERE).alias("severe_actual"),
    )


def product_skill(scores: DataFrame, day: Column, *, draws: int = bs.DRAWS, seed: int = bs.SEED, pick=bs.portable_pick) -> DataFrame:
    """Per (target, horizon): errors and skill against persistence and, for the index, against the rule."""
    by = ["target", "horizon"]
    sums = bs.day_sums(scores, by, day, {"m": F.col("abs_err"), "p": F.col("abs_err_persistence"), "w": F.col("abs_err_window_update")})
    totals = sums.groupBy(*by).agg(F.count(F.lit(1)).alias("days"), F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in "mpw"])
    n, m, p = F.col("n"), F.col("m"), F.col("p")
    w = F.when(F.col("target") == "aqi", F.col("w"))
    stats = {"skill_vs_persistence": bs.skill(m, p), "skill_vs_window_update": bs.skill(m, w)}
    points = totals.select(
        *by, n.cast("long").alias("n"), "days", (m / n).alias("mae_model"), (p / n).alias("mae_persistence"), (w / n).alias("mae_window_update"), *[c.alias(k) for k, c in stats.items()]
    )
    return points.join(bs.intervals(bs.resample(sums, by, list("mpw"), draws=draws, seed=seed, pick=pick), by, stats), by)


def rolling_skill(scores: DataFrame, day: Column, entity: str, *, days: int = WINDOW_DAYS, min_rows: int = MIN_WINDOW_ROWS) -> DataFrame:
    """Skill over the trailing ``days`` ending on each day with scores, pooled (NULL entity) and per entity.

    Scores become one row of sums per (entity, target, horizon, day) before each day is copied into the windows it
    belongs to, so the copies are of day sums, never of scores.
    """
    keys = [entity, "target", "horizon"]
    daily = scores.groupBy(*keys, day.alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("abs_err").alias("m"), F.sum("abs_err_persistence").alias("p"), F.sum("abs_err_window_update").alias("w")
    )
    daily = cut_lineage(daily)  # day sums, read for the last day and for the windows
    last = daily.agg(F.max("day")).scalar()
    ends = F.sequence(F.col("day"), F.least(F.date_add("day", days - 1), last))
    windows = daily.select("*", F.explode(ends).alias("window_end"))
    sets = [[F.col("target"), F.col("horizon"), F.col("window_end")], [F.col(entity), F.col("target"), F.col("horizon"), F.col("window_end")]]
    total = windows.groupingSets(sets, F.col(entity), F.col("target"), F.col("horizon"), F.col("window_end")).agg(*[F.sum(c).alias(c) for c in ("n", "m", "p", "w")])
    n = F.col("n")
    w = F.when(F.col("target") == "aqi", F.col("w"))
    return total.where(n >= min_rows).select(
        entity, "horizon", "target", "window_end", "n", (F.col("m") / n).alias("mae_model"), (F.col("p") / n).alias("mae_persistence"), bs.skill(F.col("m"), F.col("p")).alias("skill_mae"),
        (w / n).alias("mae_window_update"), bs.skill(F.col("m"), w).alias("skill_vs_window_update"),
    )


# ------------------------------------------------------------------------------------------------------------ alerts
def negative_streak(history: DataFrame, by: Sequence[str], day: str, value: str, out: str) -> DataFrame:
    """Trailing days below zero per key: days after the last one that is zero, positive or missing.

    Two aggregates and a join, no ordering: a row counts when its day lies after the last break.
    """
    broken = F.col(value).isNull() | (F.col(value) >= 0)
    breaks = history.groupBy(*by).agg(F.max(F.when(broken, F.col(day))).alias("__break"))
    after = F.col("__break").isNull() | (F.col(day) > F.col("__break"))
    return history.join(breaks, list(by)).groupBy(*by).agg(F.count_if(after).alias(out))


def failed_streaks(runs: DataFrame, job: str, status: str, started: str, *, last: int = 3) -> DataFrame:
    """Jobs whose newest ``last`` runs all failed."""
    from .tables import top_k

    newest = top_k(runs.select(job, status, started), [job], [F.col(started).desc()], last)
    return newest.groupBy(job).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col(status) == "failed").alias("failed"), F.max(started).alias("newest")
    ).where((F.col("runs") == last) & (F.col("failed") == last)).select(job, "newest")


def alert_table(history: DataFrame, runs: DataFrame, *, days: int = 7, failures: int = 3, rule_horizons: Sequence[int] = (1, 6)) -> DataFrame:
    """Alert rows (key, title) from pooled rolling skill and the run log."""
    by = ["target", "horizon"]
    history = cut_lineage(history)
    plain = negative_streak(history, by, "window_end", "skill_mae", "streak").where(F.col("streak") >= days)
    rule = negative_streak(history, by, "window_end", "skill_vs_window_update", "streak")
    rule = rule.where((F.col("streak") >= days) & (F.col("target") == "aqi") & F.col("horizon").isin(*rule_horizons))
    h = F.concat(F.col("horizon").cast("string"), F.lit("h"))
    a = plain.select(F.concat(F.lit("skill-"), "target", F.lit("-"), h).alias("key"), F.concat(F.lit(f"No gain over persistence in {days} daily windows: "), "target", F.lit(" at "), h).alias("title"))
    b = rule.select(F.concat(F.lit("skill-vs-rule-aqi-"), h).alias("key"), F.concat(F.lit(f"Window update ahead in {days} daily windows: aqi at "), h).alias("title"))
    c = failed_streaks(runs, "job", "status", "started_at", last=failures)
    c = c.select(F.concat(F.lit("job-"), "job").alias("key"), F.concat(F.lit(f"{failures} failed runs in a row: "), "job").alias("title"))
    return a.unionByName(b).unionByName(c)


def stall_decision(age: Column, is_open: Column, *, stale_after: float = 3.0, stall_after: float = 48.0) -> Column:
    """open / refresh / close / none from the age of the freshest reading, with hysteresis between the two limits."""
    stalled = age.isNull() | (age > stall_after)
    return F.when(stalled, F.when(is_open, "refresh").otherwise("open")).when((age <= stale_after) & is_open, "close").otherwise("none")
