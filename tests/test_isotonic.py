"""The monotone fit over value ranges against the plain pooling pass over all values."""

import numpy as np
import pandas as pd
import pytest

from hourglass.operators import isotonic as iso


def plain(x, y):
    """Fitted value of every distinct value, by the min-max formula."""
    f = pd.DataFrame({"x": x, "y": y}).dropna().groupby("x").y.agg(["sum", "count"])
    s, n = np.r_[0, f["sum"].cumsum()], np.r_[0, f["count"].cumsum()]
    k = len(f)
    means = np.full((k, k), np.inf)
    for j in range(k):
        means[j, j:] = (s[j + 1 :] - s[j]) / (n[j + 1 :] - n[j])
    least = np.minimum.accumulate(means[:, ::-1], axis=1)[:, ::-1]
    least[np.tril_indices(k, -1)] = -np.inf
    return f.index.to_numpy(), least.max(axis=0)


CASES = {
    "rising": lambda r: (np.arange(300.0), np.arange(300.0) + r.normal(0, 3, 300)),
    "falling": lambda r: (np.arange(300.0), -np.arange(300.0)),
    "flat": lambda r: (np.arange(300.0), r.normal(0, 1, 300)),
    "steps": lambda r: (np.arange(400.0), np.where(np.arange(400) % 100 < 50, 5.0, 0.0) + np.arange(400) / 50),
    "late fall": lambda r: (np.arange(400.0), np.where(np.arange(400) > 350, -1000.0, np.arange(400.0))),
    "ties": lambda r: (np.where(r.random(500) < 0.5, 7.0, r.integers(0, 40, 500)), r.normal(0, 1, 500)),
    "gaps": lambda r: (np.where(r.random(200) < 0.2, np.nan, r.normal(0, 1e9, 200)), np.where(r.random(200) < 0.2, np.nan, r.normal(0, 1, 200))),
    "one": lambda r: (np.full(50, 3.0), np.arange(50.0)),
}


@pytest.mark.parametrize("case", CASES)
def test_equals_the_min_max_formula(spark, monkeypatch, case):
    monkeypatch.setattr(iso, "MOVED", 2)
    x, y = CASES[case](np.random.default_rng(1))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    fit = iso.isotonic_fit(df, "x", "y", ranges=9)
    at, want = plain(x, y)
    asked = np.r_[at, (at[1:] + at[:-1]) / 2, at[0] - 5, at[-1] + 5]
    got = fit.apply(spark.createDataFrame(pd.DataFrame({"q": asked})), "q", "p").toPandas().set_index("q").p
    assert np.allclose(got.loc[asked], np.interp(asked, at, want), rtol=1e-9, atol=1e-9)
    values = fit.blocks.orderBy("low").toPandas()
    assert (np.diff(values.value) > 0).all() and (values.low.to_numpy()[1:] > values.high.to_numpy()[:-1]).all()


def test_no_rows_and_missing_values(spark):
    empty = iso.isotonic_fit(spark.createDataFrame([], "x double, y double"), "x", "y")
    assert empty.blocks.collect() == [] and empty.apply(spark.createDataFrame([(1.0,)], "q double"), "q", "p").collect()[0].p is None
    fit = iso.isotonic_fit(spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "x double, y double"), "x", "y", ranges=1)
    rows = fit.apply(spark.createDataFrame([(2.0,), (2.0,), (None,), (float("nan"),)], "q double"), "q", "p").collect()
    assert sorted((r.p is None, r.p) for r in rows)[:2] == [(False, 3.0)] * 2 and sum(r.p is None for r in rows) == 2


def test_many_values_are_split(spark):
    """A third of the rows on one value, many distinct ones: no task pools more than its share of them."""
    rng = np.random.default_rng(2)
    x = np.where(rng.random(60_000) < 0.33, 0.5, rng.random(60_000))
    y = x + rng.normal(0, 0.3, 60_000)
    fit = iso.isotonic_fit(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), "x", "y", ranges=12)
    blocks = pd.DataFrame(iso.pooled([(a, a, n, s) for a, s, n in pd.DataFrame({"x": x, "y": y}).groupby("x").y.agg(["sum", "count"]).reset_index().itertuples(index=False)]), columns=["low", "high", "w", "t"])
    got = fit.blocks.orderBy("low").toPandas()
    assert np.allclose(got.low, blocks.low) and np.allclose(got.value, blocks.t / blocks.w)
