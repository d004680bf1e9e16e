"""Least squares with absorbed fixed effects and cluster-robust errors, on aggregated moments."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .lineage import cut_lineage


def _moments(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per (cluster, effect): count, means and co-moments of all columns, by aggregates that keep their digits (one pass)."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    n = F.count(F.lit(1))
    means = [F.avg(c).alias(f"__a{i}") for i, c in enumerate(cols)]
    return rows.groupBy("__g", "__e").agg(n.alias("n"), *means, *[(n * F.covar_pop(cols[i], cols[j])).alias(f"{i}_{j}") for i, j in pairs])


def clustered_ols(df: DataFrame, outcome: str, regressors: Sequence[str], cluster: str, *, effects: str | None = None) -> DataFrame:
    """Coefficient table of ``outcome`` on ``regressors`` with errors clustered by ``cluster``.

    The intercept, or one intercept per value of ``effects``, is absorbed by subtracting group means, so the number of
    stations never enters the matrix. The rows are read once, for moments per (cluster, effect); means of the effects, centred cross
    products and cluster scores all follow from those cells, since a cell's products about another centre are its co-moments
    plus its count times the shifts. The driver sees k x k numbers, and only that solve happens there. Correction
    G/(G-1) * (n-1)/(n-k) and normal p-values.
    """
    xs = list(regressors)
    cols = [outcome, *xs]
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in cols], F.col(cluster).alias("__g"), (F.col(effects) if effects else F.lit(0)).alias("__e"))
    cells = cut_lineage(_moments(rows.dropna(subset=cols), cols))
    weighted = lambda i: F.sum(F.col("n") * F.col(f"__a{i}")) / F.sum("n")
    grand = cells.agg(weighted(0)).scalar()
    if effects:
        means = cells.groupBy("__e").agg(*[weighted(i).alias(f"__m{i}") for i in range(len(cols))])
        joined, mean = cells.join(means, "__e"), [F.col(f"__m{i}") for i in range(len(cols))]
    else:
        # one intercept: its means are scalars, a join on a constant key would gather all cells in one task
        joined, mean = cells, [cells.agg(weighted(i)).scalar() for i in range(len(cols))]
    shifted = joined.select("*", *[(F.col(f"__a{i}") - mean[i]).alias(f"__d{i}") for i in range(len(cols))], (F.col("__a0") - grand).alias("__d"))
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    about = {(i, j): F.col(f"{i}_{j}") + F.col("n") * F.col(f"__d{i}") * F.col(f"__d{j}") for i, j in pairs}
    sst = F.sum(F.col("0_0") + F.col("n") * F.col("__d") * F.col("__d"))
    per_cluster = cut_lineage(shifted.groupBy("__g").agg(F.sum("n").alias("n"), sst.alias("sst"), *[F.sum(c).alias(f"{i}_{j}") for (i, j), c in about.items()]))
    m = per_cluster.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("g"), F.sum("sst").alias("sst"), *[F.sum(f"{i}_{j}").alias(f"{i}_{j}") for i, j in pairs]).first()
    k = len(xs)
    full = np.array([[m[f"{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)], dtype=float)
    xx, xy = full[1:, 1:], full[1:, 0]
    beta = np.linalg.solve(xx, xy)
    sse = full[0, 0] - float(beta @ xy)
    score = lambda i: F.col(f"0_{i}") - sum((F.lit(float(b)) * F.col(f"{min(i, j)}_{max(i, j)}") for j, b in enumerate(beta, 1)), F.lit(0.0))
    scored = per_cluster.select(*[score(i).alias(f"__s{i}") for i in range(1, k + 1)])
    meat_row = scored.agg(*[F.sum(F.col(f"__s{i}") * F.col(f"__s{j}")).alias(f"{i}_{j}") for i in range(1, k + 1) for j in range(i, k + 1)]).first()
    meat = np.array([[meat_row[f"{min(i, j)}_{max(i, j)}"] for j in range(1, k + 1)] for i in range(1, k + 1)], dtype=float)
    n, g, params = m["n"], m["g"], k + cells.select("__e").distinct().count()
    bread = np.linalg.inv(xx)
    cov = g / (g - 1) * (n - 1) / (n - params) * bread @ meat @ bread
    out = []
    for i, x in enumerate(xs):
        se = math.sqrt(float(cov[i, i]))
        t = float(beta[i]) / se if se > 0 else float("nan")
        half = 1.959963984540054 * se
        out.append((x, float(beta[i]), se, t, math.erfc(abs(t) / math.sqrt(2)), float(beta[i]) - half, float(beta[i]) + half, float(1 - sse / m["sst"]), n, g))
    return df.sparkSession.createDataFrame(out, "coef string, estimate double, std_err double, t_stat double, p_value double, ci_lower double, ci_upper double, r_squared double, n_obs long, n_clusters long")


def event_design(df: DataFrame, day: str, event: str) -> DataFrame:
    """Relative day, after-event flag and their product around an event date."""
    rel = F.datediff(F.col(day), F.lit(event).cast("date"))
    post = (rel > 0).cast("int")
    return df.select("*", rel.alias("rel_day"), post.alias("post"), (rel * post).alias("post_rel_day"))


def event_study(df: DataFrame, outcome: str, day: str, event: str, *, station: str, controls: Sequence[str] = (), placebo: str | None = None) -> DataFrame:
    """Pre-trend, before/after, station effects, controls, interrupted series and placebo, one coefficient each."""
    df = cut_lineage(df)  # read by every specification
    design = event_design(df, day, event)
    around = design.where("rel_day <> 0")
    specs = [
        ("pre_trend", design.where("rel_day < 0"), ["rel_day"], None, "rel_day"),
        ("before_after", around, ["post"], None, "post"),
        ("station_effects", around, ["post"], station, "post"),
        ("controls", around.dropna(subset=list(controls)), ["post", *controls], station, "post"),
        ("interrupted_series", around.dropna(subset=list(controls)), ["rel_day", "post", "post_rel_day", *controls], station, "post"),
    ]
    if placebo is not None:
        specs.append(("placebo", event_design(df, day, placebo).where("rel_day <> 0"), ["post"], station, "post"))
    out = None
    for name, rows, xs, effects, shown in specs:
        fit = clustered_ols(rows, outcome, xs, day, effects=effects).where(F.col("coef") == shown).withColumn("model", F.lit(name))
        out = fit if out is None else out.unionByName(fit)
    return out
