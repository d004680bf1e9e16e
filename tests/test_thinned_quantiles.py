"""Percentiles from thinned groups against numpy, and how much of a group is left to shuffle."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from hourglass.operators import ranks

PROBS = {"a": 0.0, "b": 0.001, "c": 0.25, "d": 0.5, "e": 0.999, "f": 1.0}
SHAPES = {
    "tails": lambda r, n: r.normal(0, 1, n) ** 7,
    "one heavy value": lambda r, n: np.where(r.random(n) < 0.4, 5.0, r.normal(5, 1, n)),
    "one value": lambda r, n: np.full(n, 3.5),
    "few values": lambda r, n: r.integers(0, 4, n).astype(float),
    "narrow band": lambda r, n: 1e9 + r.random(n) * 1e-3,
}


@pytest.mark.parametrize("shape", SHAPES)
def test_equals_numpy_with_a_third_of_the_rows_in_one_group(spark, shape):
    rng = np.random.default_rng(4)
    n = 90_000
    g = np.where(rng.random(n) < 0.33, 0, np.minimum(rng.geometric(0.3, n), 12))
    f = pd.DataFrame({"g": g, "v": SHAPES[shape](rng, n)})
    f.loc[rng.random(n) < 0.02, "v"] = np.nan
    df = spark.createDataFrame(f).selectExpr("g", "nullif(v, double('nan')) v")
    got = ranks.quantiles(df, ["g"], "v", PROBS).toPandas().set_index("g").sort_index()
    want = f.groupby("g").v.quantile(list(PROBS.values())).unstack()
    assert np.allclose(got.to_numpy(float), want.to_numpy(), rtol=1e-12)
    whole = ranks.quantiles(df, [], "v", PROBS).toPandas()
    assert np.allclose(whole.to_numpy(float)[0], f.v.quantile(list(PROBS.values())), rtol=1e-12)


def test_large_groups_are_thinned_before_the_shuffle(spark):
    df = spark.range(400_000).selectExpr("id % 2 g", "double(hash(id)) v")
    few = ranks.thinned(df, ["g"], "v", [0.25, 0.5, 0.99])
    rows = few.groupBy("g").agg({"n": "sum", "*": "count"}).toPandas()
    assert (rows["sum(n)"] == 200_000).all() and (rows["count(1)"] < 1_500).all()


def test_empty_input(spark):
    empty = spark.createDataFrame([], "g int, v double")
    assert ranks.quantiles(empty, ["g"], "v", PROBS).collect() == [] and ranks.quantiles(empty, [], "v", PROBS).collect()[0].d is None


def test_brackets_are_the_same_in_every_pass(spark):
    """Which rows a partial sketch gets, and in what order, moves its brackets; a cluster does not fix it, and here each reading differs."""

    def dealt(batches):
        rows = pa.Table.from_batches(batches)
        yield from rows.take(np.random.default_rng().permutation(rows.num_rows)).to_batches()

    n = 300_000
    f = pd.DataFrame({"g": np.arange(n) % 2, "v": np.random.default_rng(7).normal(50, 20, n) ** 3})
    df = spark.createDataFrame(f).coalesce(1).mapInArrow(dealt, "g bigint, v double")
    probs = {"a": 0.5, "b": 0.9, "c": 0.95}
    reuse = spark.conf.get("spark.sql.exchange.reuse", "true")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = ranks.quantiles(df, ["g"], "v", probs).toPandas().set_index("g").sort_index()
    finally:
        spark.conf.set("spark.sql.exchange.reuse", reuse)
    assert np.allclose(got.to_numpy(float), f.groupby("g").v.quantile(list(probs.values())).unstack().to_numpy(), rtol=1e-12)
