"""Breakpoints, trailing rules, causality and blocked frames."""

import numpy as np
import pandas as pd
import pytest
from helpers import READING_SCHEMA, brute_index, frame, readings
from pyspark.sql import functions as F

from hourglass.functions import piecewise as pw
from hourglass.operators import features as ft, index as ix
from hourglass.operators.ordered import fill_from_neighbours, previous_row, row_index

BY = ["entity"]


def _index(spark, pdf, block=48):
    df = frame(spark, pdf, READING_SCHEMA)
    return ix.trailing_index(ix.hourly_index(df, BY, block=block), BY, block=block)


def _values(df, column):
    return {(r.entity, r.hour_no): r[column] for r in df.select("entity", "hour_no", column).collect()}


def test_breakpoints(spark):
    cases = [("pm25", c, i) for c, i in [(0, 0), (30, 50), (45, 75), (60, 100), (90, 200), (120, 300), (250, 400), (500, 500), (900, 500), (-5, 0), (None, None)]]
    cases += [("co", c, i) for c, i in [(1, 50), (2, 100), (10, 200), (50, 500)]]
    rows = spark.createDataFrame([(p, None if c is None else float(c), None if i is None else float(i)) for p, c, i in cases], "p string, c double, want double")
    got = rows.withColumn("got", F.when(F.col("p") == "pm25", pw.sub_index("pm25", "c")).otherwise(pw.sub_index("co", "c"))).collect()
    for r in got:
        assert (r.got is None) == (r.want is None)
        assert r.want is None or r.got == pytest.approx(r.want)


def test_us_index_rounds_half_up_and_round_trip_is_idempotent(spark):
    df = spark.createDataFrame([(35.0, 99.0), (60.0, 152.0), (199.0, 249.0), (None, None), (900.0, 500.0)], "c double, want double")
    once = pw.us_round_trip("pm25", "c")
    rows = df.select("want", pw.to_us_index("pm25", "c").alias("got"), pw.to_us_index("pm25", once).alias("again")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]
    assert [r.again for r in rows] == [r.got for r in rows]


def test_category_and_stage_cuts_differ_between_whole_numbers(spark):
    df = spark.createDataFrame([(50.5,), (450.5,), (200.9,), (None,)], "x double")
    r = df.select(pw.category("x").alias("cat"), pw.ordinal_class("x").alias("cls"), pw.stage_number("x").alias("num"), pw.stage_label("x").alias("lab")).collect()
    assert (r[0].cat, r[0].cls) == ("Satisfactory", 0)
    assert (r[1].num, r[1].lab) == (4, "III")
    assert (r[2].num, r[2].lab) == (0, None)
    assert tuple(r[3]) == (None, None, None, None)


def test_constant_hours_give_a_constant_index(spark):
    pdf = pd.DataFrame({"entity": 1, "hour_no": range(60), "pm25": 60.0, "pm10": 100.0, "no2": 40.0, "so2": 40.0, "nh3": 200.0, "co": 1.0, "o3": 50.0})
    got = _values(_index(spark, pdf), "index_value")
    assert all(got[(1, h)] is None for h in range(15)) and all(got[(1, h)] == pytest.approx(100) for h in range(15, 60))


@pytest.mark.parametrize("block", [24, 100, None])
def test_index_equals_pandas_with_gaps_and_any_block(spark, block):
    pdf = readings(200, (1, 2), gaps=0.2)
    want = brute_index(pdf).set_index(["entity", "hour_no"])
    df = _index(spark, pdf, block)
    for column in ("hourly_index", "index_value"):
        got = _values(df, column)
        assert len(got) == len(want)
        for key, value in got.items():
            w = want.loc[key, column]
            assert (value is None) == bool(np.isnan(w)), (key, column)
            assert value is None or value == pytest.approx(w, abs=1e-9)


def test_later_values_never_change_earlier_rows(spark):
    pdf = readings(120)
    bumped = pdf.copy()
    bumped.loc[bumped.hour_no >= 1080, ["pm25", "co", "o3"]] = 400.0
    for make in (lambda p: _index(spark, p), lambda p: ix.index_of_means(frame(spark, p, READING_SCHEMA), BY, block=48)):
        a, b = _values(make(pdf), "index_value"), _values(make(bumped), "index_value")
        assert all(a[k] == b[k] for k in a if k[1] < 1080)
        assert any(a[k] != b[k] for k in a if k[1] >= 1080)


def test_gas_window_is_exactly_eight_hours(spark):
    pdf = readings(40)
    bumped = pdf.copy()
    bumped.loc[bumped.hour_no == 1010, "o3"] = 1e6
    df = lambda p: ix.hourly_index(frame(spark, p, READING_SCHEMA), BY, block=24)
    a, b = _values(df(pdf), "hourly_index"), _values(df(bumped), "hourly_index")
    changed = sorted(k[1] for k in a if a[k] != b[k])
    assert changed == list(range(1010, 1018))


def test_window_update_is_exact_when_the_next_hours_repeat_the_current_one(spark):
    rng = np.random.default_rng(3)
    for h in (1, 6, 24):
        values = list(rng.uniform(50, 300, 60))
        values[60 - h - 1 :] = [values[60 - h - 1]] * (h + 1)
        pdf = pd.DataFrame({"entity": 1, "hour_no": range(60), "hourly_index": values})
        df = frame(spark, pdf, "entity long, hour_no long, hourly_index double")
        rule = _values(ix.window_update(df, BY, (h,), block=24), f"window_update_{h}h")
        future = _values(ix.trailing_index(df, BY, block=24), "index_value")
        assert rule[(1, 60 - h - 1)] == pytest.approx(future[(1, 59)])


def test_feature_frame_is_blocked_equally_and_has_no_leak(spark):
    pdf = pd.DataFrame({"entity": 1, "hour_no": range(300), "index_value": np.arange(300.0), "pm25": np.arange(300.0) * 2})
    schema = "entity long, hour_no long, index_value double, pm25 double"
    spike = pdf.copy()
    spike.loc[250, ["index_value", "pm25"]] = 99999.0
    one = ft.entity_features(frame(spark, pdf, schema), BY, block=None).toPandas().set_index("hour_no").sort_index()
    two = ft.entity_features(frame(spark, pdf, schema), BY, block=70).toPandas().set_index("hour_no").sort_index()
    pd.testing.assert_frame_equal(one, two[one.columns])
    hit = ft.entity_features(frame(spark, spike, schema), BY, block=70).toPandas().set_index("hour_no").sort_index()
    inputs = [c for c in two.columns if not c.startswith("target_")]
    pd.testing.assert_frame_equal(two.loc[:249, inputs], hit.loc[:249, inputs])
    assert two.loc[200, "aqi_lag_168h"] == 32 and two.loc[200, "target_aqi_24h"] == 224
    assert two.loc[10, "aqi_roll_mean_6h"] == pytest.approx(7.5) and np.isnan(two.loc[0, "aqi_roll_std_3h"])


def test_long_horizon_lags_count_rows_not_hours(spark):
    hours = [h for h in range(400) if h % 3 != 1]
    pdf = pd.DataFrame({"entity": 1, "hour_no": hours, "aqi_curr": np.arange(len(hours), dtype=float), "pm25_curr": 1.0, "aqi_lag_24h": 0.0, "aqi_lag_48h": 0.0, "aqi_lag_72h": 0.0, "pm25_lag_24h": 0.0})
    df = frame(spark, pdf, "entity long, hour_no long, aqi_curr double, pm25_curr double, aqi_lag_24h double, aqi_lag_48h double, aqi_lag_72h double, pm25_lag_24h double")
    out = ft.long_horizon_features(df, BY, block=50).toPandas().sort_values("hour_no").reset_index(drop=True)
    s = pdf["aqi_curr"]
    np.testing.assert_allclose(out["aqi_lag_96h"], s.shift(96))
    np.testing.assert_allclose(out["aqi_roll_mean_168h"], s.rolling(168, min_periods=42).mean())
    np.testing.assert_allclose(out["aqi_roll_std_72h"], s.rolling(72, min_periods=18).std())


def test_leave_one_out_alone_is_zero_or_null(spark):
    df = spark.createDataFrame([(1, 1, 10.0), (2, 1, 20.0), (3, 1, None), (1, 2, 5.0)], "entity long, hour_no long, v double")
    got = {(r.entity, r.hour_no): r.m for r in ft.leave_one_out(df, ["hour_no"], {"v": "m"}).collect()}
    assert got == {(1, 1): 20.0, (2, 1): 10.0, (3, 1): 15.0, (1, 2): 0.0}
    alone = ft.leave_one_out(df, ["hour_no"], {"v": "m"}, null_when_alone=True).where("hour_no = 2").first()
    assert alone.m is None


def test_row_numbers_previous_rows_and_fills_cross_blocks(spark):
    rng = np.random.default_rng(5)
    hours = sorted(rng.choice(500, 120, replace=False).tolist())
    labels = [None if i % 7 else f"s{i}" for i in range(120)]
    labels[0] = None
    df = spark.createDataFrame([(1, h, lab) for h, lab in zip(hours, labels, strict=True)], "entity long, hour_no long, label string")
    numbered = row_index(df, BY, "hour_no", "n", block=30)
    prev = previous_row(numbered, BY, "hour_no", {"hour_no": "prev"}, block=30)
    out = fill_from_neighbours(prev, BY, "hour_no", "label", "filled", block=30).toPandas().sort_values("hour_no")
    want = pd.Series(labels, dtype=object).ffill().bfill()
    assert out["n"].tolist() == list(range(1, 121))
    assert out["prev"].iloc[1:].astype(int).tolist() == hours[:-1]
    assert out["filled"].tolist() == want.tolist()
