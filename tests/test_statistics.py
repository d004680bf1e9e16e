"""Order statistics, correlations, bootstrap and regression against numpy / pandas restatements."""

import numpy as np
import pandas as pd
import pytest
from helpers import frame
from hypothesis import HealthCheck, given, settings, strategies as hs
from pyspark.sql import functions as F

from hourglass.operators import bootstrap as bs, classify as cl, correlation as co, ranks as rk, regression as rg, scoring as sc
from hourglass.operators.ordered import row_blocks
from hourglass.operators.tables import as_of


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(hs.lists(hs.one_of(hs.floats(-1e6, 1e6, allow_nan=False), hs.sampled_from([0.0, 1.0, -1.0, 250.0])), min_size=3, max_size=60))
def test_quantiles_and_ranks_equal_numpy(spark, values):
    df = spark.createDataFrame([(1, float(v)) for v in values], "g int, v double")
    q = rk.quantiles(df, ["g"], "v", {"a": 0.1, "b": 0.5, "c": 0.99}, widths=4).first()
    np.testing.assert_allclose([q.a, q.b, q.c], np.quantile(values, [0.1, 0.5, 0.99]), rtol=1e-9, atol=1e-9)
    ranks = sorted((r.v, r.r) for r in rk.average_ranks(df, ["g"], "v", "r").collect())
    want = sorted(zip([float(v) for v in values], pd.Series(values).rank().tolist(), strict=True))
    np.testing.assert_allclose([r for _, r in ranks], [r for _, r in want])


def test_buckets_never_decrease_with_the_value(spark):
    values = sorted([0.0, 1e-12, 1e-3, 5.0, 5.0000001, 1e5, 1e9, -1e-3, -5.0, -1e9, *np.random.default_rng(1).normal(100, 1e-3, 300)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    rows = df.select("v", rk._bucket(F.col("v"), F.lit(min(values)), F.lit(max(values)), 64).alias("b")).orderBy("v").collect()
    assert all(x.b <= y.b for x, y in zip(rows, rows[1:], strict=False))


def test_spearman_and_distribution_equal_pandas(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"a": rng.integers(0, 9, 300).astype(float), "b": rng.normal(size=300), "c": rng.normal(size=300)})
    pdf["b"] += pdf["a"]
    pdf.loc[::7, "c"] = np.nan
    df = frame(spark, pdf, "a double, b double, c double")
    got = {(r.left, r.right): (r.pearson, r.spearman, r.n) for r in co.correlation_table(df, [("a", "b"), ("a", "c")]).collect()}
    for x, y in (("a", "b"), ("a", "c")):
        both = pdf[[x, y]].dropna()
        assert got[(x, y)][0] == pytest.approx(both[x].corr(both[y]))
        # pandas spearman needs scipy, so rank and correlate
        assert got[(x, y)][1] == pytest.approx(both[x].rank().corr(both[y].rank()))
        assert got[(x, y)][2] == len(both)
    d = {r.measure: r for r in co.distribution_summary(df, ["a", "b", "c"]).collect()}
    assert d["b"].skewness == pytest.approx(pdf["b"].skew()) and d["c"].kurtosis == pytest.approx(pdf["c"].kurt())
    assert d["c"].p95 == pytest.approx(pdf["c"].quantile(0.95))


def test_station_correlation_does_not_depend_on_blocks(spark):
    rng = np.random.default_rng(4)
    ts = pd.date_range("2024-01-20", periods=500, freq="h")
    base = rng.normal(size=500)
    rows = [(s, t.to_pydatetime(), float(base[i] + rng.normal())) for s in range(6) for i, t in enumerate(ts) if rng.random() > 0.1]
    df = spark.createDataFrame(rows, "e long, ts timestamp_ntz, v double")
    wide = pd.DataFrame(rows, columns=["e", "ts", "v"]).pivot(index="ts", columns="e", values="v").corr()
    for size in (2, 256):
        got = {tuple(sorted((r.left, r.right))): r.r for r in co.station_correlation(df, "e", "ts", "v", per_block=size).collect()}
        assert len(got) == 15
        for (a, b), r in got.items():
            assert r == pytest.approx(wide.loc[a, b])


def _pick(draws, days, seed):
    d, p = np.meshgrid(np.arange(draws), np.arange(days), indexing="ij")
    a = (seed + (d + 1) * 7919 + (p + 1) * 104729) % bs.PRIME
    b = (a * a + 48271) % bs.PRIME
    return ((b * b + a) % bs.PRIME) % days


def test_day_block_bootstrap_equals_resampling_rows(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"day": np.repeat(np.arange(12), rng.integers(3, 9, 12))})
    pdf["y"], pdf["p"], pdf["r"] = rng.normal(100, 20, len(pdf)), rng.normal(100, 20, len(pdf)), rng.normal(100, 25, len(pdf))
    df = frame(spark, pdf, "day long, y double, p double, r double")
    got = sc.skill_intervals(df, [], F.col("day"), "y", "p", "r", draws=300).first()
    skills = []
    for picked in _pick(300, 12, bs.SEED):
        rows = pd.concat([pdf[pdf.day == d] for d in picked])
        skills.append(1 - (rows.p - rows.y).abs().mean() / (rows.r - rows.y).abs().mean())
    assert got.skill_mae == pytest.approx(1 - (pdf.p - pdf.y).abs().mean() / (pdf.r - pdf.y).abs().mean())
    np.testing.assert_allclose([got.skill_mae_lo, got.skill_mae_hi], np.percentile(skills, [2.5, 97.5]))


def test_draws_look_like_independent_picks():
    picks = _pick(2000, 30, 42)
    counts = np.apply_along_axis(np.bincount, 1, picks, minlength=30)
    assert abs(counts.mean() - 1) < 1e-9 and abs(counts.var() - (1 - 1 / 30)) < 0.05
    assert np.abs(picks.mean(axis=0) - 14.5).max() < 1.0


def test_clustered_ols_with_effects_equals_dummies(spark):
    rng = np.random.default_rng(6)
    n = 240
    pdf = pd.DataFrame({"day": np.arange(n) % 20, "s": np.arange(n) % 4, "x": rng.normal(size=n), "z": rng.normal(size=n)})
    pdf["y"] = 2 * pdf.x - pdf.z + pdf.s * 5 + rng.normal(size=n)
    df = frame(spark, pdf, "day long, s long, x double, z double, y double")
    for effects in (None, "s"):
        dummies = np.ones((n, 1)) if effects is None else np.eye(4)[pdf.s]
        x = np.column_stack([pdf.x, pdf.z, dummies])
        beta, *_ = np.linalg.lstsq(x, pdf.y, rcond=None)
        u, bread, meat = pdf.y - x @ beta, np.linalg.inv(x.T @ x), 0
        for d in range(20):
            g = x[pdf.day == d].T @ u[pdf.day == d]
            meat = meat + np.outer(g, g)
        cov = 20 / 19 * (n - 1) / (n - x.shape[1]) * bread @ meat @ bread
        got = {r.coef: r for r in rg.clustered_ols(df, "y", ["x", "z"], "day", effects=effects).collect()}
        for i, c in enumerate(("x", "z")):
            assert got[c].estimate == pytest.approx(beta[i]) and got[c].std_err == pytest.approx(np.sqrt(cov[i, i]))
        assert got["x"].r_squared == pytest.approx(1 - (u**2).sum() / ((pdf.y - pdf.y.mean()) ** 2).sum())


def test_as_of_equals_a_direct_search(spark):
    rng = np.random.default_rng(9)
    right = sorted({(int(k), int(p)) for k, p in zip(rng.integers(0, 2, 40), rng.integers(0, 300, 40), strict=True)})
    left = [(i, int(k), int(p)) for i, (k, p) in enumerate(zip(rng.integers(0, 2, 60), rng.integers(0, 300, 60), strict=True))]
    r = spark.createDataFrame([(k, p, float(p) * 2) for k, p in right], "k long, at long, v double")
    l = spark.createDataFrame(left, "id long, k long, x long")
    for equal in (True, False):
        got = {x.id: x.v for x in as_of(l, r, ["k"], "x", "at", ["v"], block=25, include_equal=equal).collect()}
        for i, k, p in left:
            before = [q for kk, q in right if kk == k and (q <= p if equal else q < p)]
            assert got[i] == (max(before) * 2.0 if before else None)


def test_as_of_with_half_of_all_rows_in_one_key_and_hour(spark):
    rng = np.random.default_rng(11)
    n, hour = 3000, 3_600_000
    pos = np.concatenate([40 * hour + rng.integers(0, hour, n // 2), np.full(n // 4, 40 * hour + 777), rng.integers(0, 90 * hour, n // 4)])
    key = np.concatenate([np.zeros(3 * n // 4, int), rng.integers(0, 5, n // 4)])
    pdf = pd.DataFrame({"id": np.arange(n), "k": key, "x": pos, "right": rng.random(n) < 0.4})
    right = pdf[pdf.right].groupby(["k", "x"], as_index=False).id.max()  # ties: the largest value
    l, r = frame(spark, pdf[~pdf.right][["id", "k", "x"]], "id long, k long, x long"), frame(spark, pdf[pdf.right][["k", "x", "id"]], "k long, at long, v long")
    for equal in (True, False):
        got = {x.id: x.v for x in as_of(l, r, ["k"], "x", "at", ["v"], rows=64, include_equal=equal).collect()}
        want = pd.merge_asof(pdf[~pdf.right].sort_values("x"), right.rename(columns={"id": "v"}).sort_values("x"), on="x", by="k", allow_exact_matches=equal)
        assert got == {i: None if np.isnan(v) else int(v) for i, v in zip(want.id, want.v, strict=True)}
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = row_blocks(l.select("k", "x").union(r.select("k", "at")), ["k"], "x", "b", rows=64).groupBy("k", "b").count()
    assert sizes.where("b % 2 = 0").agg(F.max("count")).first()[0] <= 1.5 * n / parts  # what has to be ordered in one task
    assert sizes.where("b % 2 = 1").agg(F.max("count")).first()[0] >= n // 4


def test_as_of_without_rows_or_positions(spark):
    l, r = spark.createDataFrame([(1, 1, 5), (2, 1, None), (3, None, 5)], "id int, k int, x int"), spark.createDataFrame([(1, 5, 2.0), (1, None, 3.0)], "k int, at int, v double")
    assert [tuple(x) for x in as_of(l, r, ["k"], "x", "at", ["v"]).collect()] == [(1, 1, 5, 2.0, 5)]
    assert [tuple(x) for x in as_of(l, r.limit(0), ["k"], "x", "at", ["v"]).collect()] == [(1, 1, 5, None, None)]
    assert as_of(l.limit(0), r, ["k"], "x", "at", ["v"]).count() == 0


def test_neighbourhood_rate_equals_brute_force(spark):
    rng = np.random.default_rng(10)
    train = pd.DataFrame({"c": rng.integers(0, 200, 80), "o": rng.integers(0, 2, 80)})
    test = pd.DataFrame({"c": [0, 30, 199, 400, 400, 77]})
    got = cl.neighbourhood_rate(frame(spark, train, "c long, o long"), frame(spark, test, "c long"), "c", "o", "rate", radius=25, block=16).collect()
    assert len(got) == 6
    for r in got:
        near = train[(train.c - r.c).abs() <= 25]
        assert r.rate == pytest.approx(near.o.mean() if len(near) else train.o.mean())


def test_conformal_pad_edges(spark):
    df = spark.createDataFrame([(float(i), 0.0, 5.0) for i in range(10)], "y double, lo double, hi double")
    assert cl.conformal_pad(df, [], "y", "lo", "hi", 0.8).first().pad == pytest.approx(sorted(max(-i, i - 5.0) for i in range(10))[8])
    assert cl.conformal_pad(df, [], "y", "lo", "hi", 0.99).first().pad == float("inf")
    inside = df.withColumn("hi", F.lit(100.0)).withColumn("lo", F.lit(-100.0))
    assert cl.conformal_pad(inside, [], "y", "lo", "hi", 0.5).first().pad == 0.0


def test_ridge_equals_the_closed_form(spark):
    from hourglass.operators import models as md

    rng = np.random.default_rng(12)
    x = rng.normal(size=(120, 3)) * [1, 5, 20] + [0, 3, 7]
    y = x @ [2.0, -1.0, 0.3] + rng.normal(size=120)
    df = frame(spark, pd.DataFrame(np.column_stack([x, y]), columns=["a", "b", "c", "y"]), "a double, b double, c double, y double")
    model = md.fit_ridge(df, ["a", "b", "c"], "y", alpha=50.0)
    got = sorted((r.y, r.prediction) for r in md.predict(model, df, ["a", "b", "c"], keep=["y"]).collect())
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    w = np.linalg.solve(z.T @ z + 50.0 * np.eye(3), z.T @ (y - y.mean()))
    want = sorted(zip(y, y.mean() + z @ w, strict=True))
    np.testing.assert_allclose([p for _, p in got], [p for _, p in want], rtol=1e-6)
