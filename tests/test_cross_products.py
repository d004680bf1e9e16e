"""Fits from additive cross products against separate fits in numpy, and the grids that are built on them."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourglass.operators import cross_products as cp, models as md

NAMES = ["a", "b", "c", "d", "flat"]


def frame(n=600, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(50, 20, (n, 5)) * [1, 10, 0.01, 1000, 0] + [0, 0, 0, 1e6, 7]
    x[:, 1] += 5 * x[:, 0]
    y = 2 * x[:, 0] + 0.3 * x[:, 1] - 100 * x[:, 2] + rng.normal(0, 5, n)
    x[rng.random((n, 5)) < 0.15] = np.nan
    f = pd.DataFrame(x, columns=NAMES).assign(y=y, now=y + rng.normal(0, 9, n), y2=y[::-1])
    f.loc[rng.random(n) < 0.1, "y2"] = np.nan
    f["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), unit="h")
    f["st"] = np.arange(n) % 3
    return f


def separate(train, cols, target, alpha):
    """Prediction function of one ridge: train medians, z-scores by population deviation, penalised squares."""
    train = train[train[target].notna()]
    med = train[cols].median()
    z = train[cols].fillna(med)
    mean, std = z.mean(), z.std(ddof=0).where(lambda s: s > 1e-9, 1.0)
    z, y = ((z - mean) / std).to_numpy(), train[target].to_numpy()
    w = np.linalg.solve(z.T @ z + alpha * np.eye(len(cols)), z.T @ (y - y.mean()))
    return lambda part: y.mean() + ((part[cols].fillna(med) - mean) / std).to_numpy() @ w


def spark_frame(spark, f):
    return spark.createDataFrame(f).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def metrics(y, p):
    return np.abs(p - y).mean(), np.sqrt(((p - y) ** 2).mean()), 1 - ((p - y) ** 2).sum() / ((y - y.mean()) ** 2).sum()


@pytest.mark.parametrize("alpha", [0.5, 100.0, 10_000.0])
def test_any_union_of_groups_and_any_subset_equals_its_own_fit(spark, alpha):
    f = frame()
    df = spark_frame(spark, f)
    shift = cp.medians(df.withColumn("g", F.lit("all")), "g", NAMES)["all"]
    products = cp.cross_products(df, NAMES, ["y", "y2"], F.col("st"), shift)
    for groups, cols, target in ((["0"], NAMES, "y"), (["0", "2"], ["d", "a"], "y2"), (["0", "1", "2"], NAMES, "y2"), (["1"], ["flat"], "y")):
        part = f[f.st.isin([int(g) for g in groups])]
        held = part[part[target].notna()]
        fill = {c: float(held[c].median()) for c in NAMES}
        model, n = products.ridge(groups, target, fill, cols, alpha=alpha)
        got = df.select("ts", model.expr().alias("p")).orderBy("ts").toPandas().p
        assert n == len(held) and np.allclose(got, separate(part, cols, target, alpha)(f), rtol=1e-7)
    lost = {c: F.col("st") == 1 for c in ("a", "c")}
    model, _ = products.ridge(["0"], "y", shift, alpha=alpha)
    got = df.select("ts", (model.expr() + model.change(lost)).alias("p")).orderBy("ts").toPandas().p
    masked = f.copy()
    masked.loc[masked.st == 1, ["a", "c"]] = np.nan
    want = spark_frame(spark, masked).select("ts", model.expr().alias("p")).orderBy("ts").toPandas().p
    assert np.allclose(got, want)


def test_missing_columns_and_no_rows(spark):
    f = frame(50).assign(none=np.nan)
    df = spark_frame(spark, f)
    fill = cp.medians(df.withColumn("g", F.lit("x")), "g", ["a", "none"])["x"]
    model, _ = cp.cross_products(df, ["a", "none"], ["y"], F.lit("x"), fill).ridge(["x"], "y", fill, alpha=1.0)
    assert fill["none"] is None and model.coef[1] == 0.0 and np.isfinite(model.intercept)
    with pytest.raises(ValueError):
        cp.cross_products(df.where("false"), ["a"], ["y"], F.lit("x"), {}).ridge(["x"], "y", {}, alpha=1.0)


def test_folds_equal_separate_fits(spark):
    f = frame()
    folds = [("late", "2024-01-20 00:00:00", "2024-01-24 23:00:00"), ("early", "2024-01-10 00:00:00", "2024-01-12 23:00:00")]
    p = md.rolling_origin(spark_frame(spark, f), "ts", folds, NAMES, "y", "now", alpha=10.0)
    rows = {r.fold: r for r in md.fold_scores(p, "y", "now").collect()}
    skills = []
    for name, lo, hi in folds:
        train, test = f[f.ts < pd.Timestamp(lo) - pd.Timedelta(hours=24)], f[f.ts.between(lo, hi)]
        mae, rmse, r2 = metrics(test.y, 0.5 * test.now + 0.5 * separate(train, NAMES, "y", 10.0)(test))
        r = rows[name]
        assert (r.n_train, r.n_test) == (len(train), len(test)) and np.allclose([r.mae, r.rmse, r.r2], [mae, rmse, r2])
        skills.append(1 - mae / np.abs(test.now - test.y).mean())
        assert np.isclose(r.skill_mae, skills[-1])
    (s,) = md.fold_summary(md.fold_scores(p, "y", "now"), "skill_mae").collect()
    assert np.allclose([s.mean_skill_mae, s.std_skill_mae, s.folds], [np.mean(skills), np.std(skills), 2])


def test_ablation_grid_equals_separate_fits(spark):
    f = frame()
    train, val, test = f[:400], f[400:500], f[500:]
    groups = {"baseline": ["a", "d"], "+b": ["a", "d", "b"], "+oracle": ["a", "d", "b", "c"], "+none": None, "+empty": []}
    panels = {"full": (F.lit(True), groups), "recent": (F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz"), groups)}
    parts = {"val": spark_frame(spark, val), "test": spark_frame(spark, test)}
    out = md.exogenous_ablation(spark_frame(spark, train), parts, panels, "y", "now", oracle=["+oracle"], families=("ridge_hybrid",), alpha=10.0).toPandas()
    ran = out[out.status == "ok"].set_index(["panel", "group", "split"])
    assert len(out) == 2 * 5 + 2 and len(ran) == 8
    best = None
    for panel, rows in (("full", train), ("recent", train[train.ts >= "2024-01-05"])):
        for group in ("baseline", "+b", "+oracle"):
            mae, rmse, r2 = metrics(val.y, 0.5 * val.now + 0.5 * separate(rows, groups[group], "y", 10.0)(val))
            r = ran.loc[panel, group, "val"]
            assert np.allclose([r.mae, r.rmse, r.r2], [mae, rmse, r2]) and r.n_train == len(rows) and r.n_features == len(groups[group])
            assert r.deployable == (group != "+oracle") and np.isclose(r.mae_delta_vs_baseline, r.mae - ran.loc[panel, "baseline", "val"].mae)
            if r.deployable and (best is None or mae < best[0]):
                best = mae, panel, group, rows
    _, panel, group, rows = best
    assert set(ran.xs("test", level="split").index) == {(panel, group), (panel, "baseline")}
    assert np.isclose(ran.loc[panel, group, "test"].mae, metrics(test.y, 0.5 * test.now + 0.5 * separate(rows, groups[group], "y", 10.0)(test))[0])
    idle = out[out.status == "not_run"]
    assert set(idle.group) == {"+none", "+empty"} and idle.mae.isna().all()


def test_audit_grid(spark):
    f = frame()
    train, val = f[:400], f[400:]
    scenarios = {"baseline": {}, "no_b": {"*": ["b"]}, "no_a_of_one": {1: ["a"], 2: ["c"]}}
    end = str(val.ts.max() - pd.Timedelta(hours=5))
    rows = md.availability_audit(spark_frame(spark, train), spark_frame(spark, val), scenarios, {1: "y", 24: "y2"}, NAMES, "st", "ts", "now", end, alpha=10.0, draws=50).toPandas()
    assert len(rows) == 2 * 2 * 3 and (rows[rows.scenario == "baseline"].delta_mae_vs_baseline == 0).all()
    rows = rows.set_index(["horizon", "row_set", "scenario"])
    for hours, target in ((1, "y"), (24, "y2")):
        model = separate(train, NAMES, target, 10.0)
        for name, gaps in scenarios.items():
            masked = val.copy()
            for who, cols in gaps.items():
                masked.loc[masked.st.eq(who) if who != "*" else masked.st >= 0, cols] = np.nan
            for row_set in ("all", "strict"):
                keep = val[target].notna() & ((val.ts + pd.Timedelta(hours=hours) <= end) | (row_set == "all"))
                part = masked[keep]
                want = np.abs(0.5 * part.now + 0.5 * model(part) - part[target]).mean()
                got = rows.loc[hours, row_set, name]
                assert got.n == keep.sum() and np.isclose(got.mae, want)


def test_grids_read_their_rows_once(spark):
    """One pass for medians and one for products, however many fits are read from them."""
    df = spark_frame(spark, frame(100))
    plan = cp.cross_products.__wrapped__ if hasattr(cp.cross_products, "__wrapped__") else cp.cross_products
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    products = plan(df, NAMES, ["y", "y2"], F.col("st"), {})
    jobs = len(set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - set(before))
    for alpha in (1.0, 2.0, 3.0):
        for cols in (NAMES[:2], NAMES[:3]):
            products.ridge(["0", "1"], "y", dict.fromkeys(NAMES, 0.0), cols, alpha=alpha)
    assert len(set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - set(before)) == jobs
