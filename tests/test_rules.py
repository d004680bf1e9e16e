"""Quality rules, upserts, slots, feeds, episodes, gates, scores, alerts, splits."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from helpers import frame
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from hourglass.functions import quality as q
from hourglass.operators import agreement as ag, cleaning as c, episodes as ep, scoring as sc, slots as sl, splits as sp, tables as tb
from hourglass.sources import feeds as fd, files as fs
from hourglass.streaming import jobs as jb


def test_archive_rules_keep_the_row_and_the_reason(spark):
    df = spark.createDataFrame([(-9999.0, 50.0, 900.0), (-3.0, 101.0, 999.0), (12.0, None, 300.0)], "pm25 double, rh_pct double, bp_mmhg double")
    rows = c.clean_cells(df, ["pm25", "rh_pct", "bp_mmhg"]).collect()
    assert rows[0].qc_flags == {"pm25": "SENTINEL_-9999.0"} and rows[0].pm25 is None and rows[0].rh_pct == 50.0
    assert rows[1].qc_flags == {"pm25": "OOB_BELOW_0(was_-3.0)", "rh_pct": "OOB_ABOVE_100(was_101.0)", "bp_mmhg": "OOB_ABOVE_998.9(was_999.0)"}
    assert rows[2].qc_flags == {"bp_mmhg": "OOB_BELOW_400(was_300.0)"} and rows[2].pm25 == 12.0


def test_live_rules_pass_true_extremes(spark):
    df = spark.createDataFrame([(998.0, 9.76, 20.0), (150000.0, -1.0, -20.0), (-999.0, 51.0, 60.0)], "pm25 double, co double, temperature double")
    rows = c.clean_cells(df, ["pm25", "co", "temperature"], limits=q.LIVE, verbose=False).collect()
    assert rows[0].qc_flags is None
    assert rows[1].qc_flags == {"pm25": "implausible", "co": "bounds", "temperature": "implausible"}
    assert rows[2].qc_flags == {"pm25": "sentinel", "co": "implausible", "temperature": "implausible"}


def test_batch_guard_needs_rows_and_share(spark):
    def run(n, bad):
        df = spark.createDataFrame([(1e6 if i < bad else 5.0,) for i in range(n)], "pm25 double")
        c.require_plausible(c.clean_cells(df, ["pm25"], limits=q.LIVE, verbose=False), ["pm25"])

    run(100, 5)
    run(10, 9)
    with pytest.raises(c.BatchRejected):
        run(40, 30)


def test_filled_cells_are_tagged_and_masked_again(spark):
    own = spark.createDataFrame([(1, 1, 20.0, None), (1, 2, None, None), (1, 3, None, None)], "station long, hour long, temperature double, humidity double")
    other = spark.createDataFrame([(1, 1, 99.0, 40.0), (1, 2, 10.0, 300.0)], "station long, hour long, temperature double, humidity double")
    filled = c.fill_missing(own, other, ["station", "hour"], ["temperature", "humidity"], tag="filled:open-meteo")
    out = c.finish_hourly(filled, ["temperature", "humidity"], source="x", row_flags="row_flags", weather=("temperature", "humidity")).orderBy("hour").collect()
    assert [r.weather_source for r in out] == ["mixed", "open-meteo"]
    assert out[1].qc_flags == {"humidity": "bounds", "temperature": "filled:open-meteo"}
    masked = c.mask_filled(spark.createDataFrame(out), ["temperature", "humidity"]).orderBy("hour").collect()
    assert [(r.temperature, r.humidity) for r in masked] == [(20.0, None), (None, None)]


def test_station_names(spark):
    df = spark.createDataFrame([("Jahangirpuri, Delhi - DPCC\t",), ("ITO, Delhi - CPCB",), ("Lonely",), ("A, B",)], "raw string")
    got = [tuple(r) for r in df.select(*[x.alias(n) for n, x in c.split_station_name("raw", city="Delhi").items()]).collect()]
    assert got == [("Jahangirpuri", "Delhi", "DPCC"), ("ITO", "Delhi", "CPCB"), ("Lonely", "Delhi", "Unknown"), ("A, B", "Delhi", "Unknown")]


def test_upserts_and_their_repetition(spark):
    old = spark.createDataFrame([(1, 1.0, "csv"), (2, 2.0, "live"), (3, 3.0, "live")], "k long, v double, source string")
    new = spark.createDataFrame([(2, 20.0, "csv"), (3, 30.0, "live"), (4, 40.0, "csv")], "k long, v double, source string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    latest = tb.upsert_latest(old, new, ["k"])
    assert rows(latest) == [(1, 1.0, "csv"), (2, 20.0, "csv"), (3, 30.0, "live"), (4, 40.0, "csv")]
    assert rows(tb.upsert_latest(latest, new, ["k"])) == rows(latest)
    assert rows(tb.upsert_same_source(old, new, ["k"])) == [(1, 1.0, "csv"), (2, 2.0, "live"), (3, 30.0, "live"), (4, 40.0, "csv")]
    assert rows(tb.upsert_replaceable(old, new, ["k"], ["csv"])) == [(1, 1.0, "csv"), (2, 2.0, "live"), (3, 3.0, "live"), (4, 40.0, "csv")]
    assert rows(tb.insert_absent(old, new, ["k"])) == [(4, 40.0, "csv")]


def test_an_hour_needs_all_four_slots(spark):
    base = dt.datetime(2024, 1, 1)
    minutes = [(0, 10.0), (15, 20.0), (30, 30.0), (45, 99.0), (45, 40.0), (120, 1.0), (135, 1.0), (150, 1.0)]
    df = spark.createDataFrame([(1, base + dt.timedelta(minutes=m), v, i) for i, (m, v) in enumerate(minutes)], "e long, start timestamp_ntz, v double, arrival long")
    got = sl.slots_to_hours(df, ["e"], "start", "v", "h", arrival="arrival").collect()
    assert [(r.hour_no % 24, r.h) for r in got] == [(0, 25.0)]
    assert sl.slots_to_hours(df, ["e"], "start", "v", "h", arrival="arrival", offsets=(-15,)).count() == 0


def test_long_feed_drops_unknown_stations_and_keeps_the_last_value(spark):
    records = [
        ("Alpha, City - Net", "PM2.5", "12.5", "03-01-2024 15:00:00", 1),
        ("alpha, elsewhere", "PM2.5", "13.5", "03-01-2024 15:00:00", 2),
        ("Alpha", "OZONE", "NA", "03-01-2024 15:00:00", 3),
        ("Nowhere", "PM10", "5", "03-01-2024 15:00:00", 4),
        ("Alpha", "PM10", "5", "bad stamp", 5),
    ]
    df = spark.createDataFrame(records, "station string, pollutant_id string, pollutant_avg string, last_update string, seq long")
    aliases = spark.createDataFrame([("Alpha", "Alpha")], "alias string, canonical string")
    rows = fd.long_feed_rows(df, aliases).collect()
    assert len(rows) == 1
    assert (rows[0].station_name, rows[0].hour, rows[0].pm25, rows[0].o3, rows[0].pm10) == ("Alpha", dt.datetime(2024, 1, 3, 14), 13.5, None, None)


def test_changed_units_are_quarantined_or_fatal(spark):
    payload = '{"dateTime":"2024-01-01T10:00:00Z","indexes":[{"code":"uaqi","aqi":70}],"pollutants":[{"code":"co","concentration":{"value":1000,"units":"PARTS_PER_BILLION"}},{"code":"pm25","concentration":{"value":5,"units":"PARTS_PER_BILLION"}}]}'
    df = spark.createDataFrame([(payload,)], "p string")
    rows = fd.array_feed_rows(df, "p", zone="Asia/Kolkata")
    r = rows.first()
    assert r.ts == dt.datetime(2024, 1, 1, 15) and r.universal_index == 70 and r.national_index is None
    assert r.co == pytest.approx(1000 * 28.01 / 24.45 / 1000) and r.pm25 is None and r.unit_changed == ["pm25"]
    with pytest.raises(PySparkException):
        fd.require_units(rows).collect()


def test_sheet_days_that_do_not_exist_have_no_time(spark):
    df = spark.createDataFrame([("x_2025_February_y.csv", "3.0", "120", "--"), ("x_2025_February_y.csv", "31", "7", "8")], "file string, Date string, `00:00:00` string, `13:00:00` string")
    rows = fs.wide_hours_to_long(df, "Date", ["00:00:00", "13:00:00"], "file").collect()
    assert sorted((r.ts is None, r.ts, r.value) for r in rows if r.ts) == [(False, dt.datetime(2025, 2, 3), 120.0)]
    assert sum(r.ts is None for r in rows) == 2


def test_csv_scan_reads_null_tokens_and_missing_columns(spark, tmp_path):
    folder = tmp_path / "Station A" / "Raw"
    folder.mkdir(parents=True)
    (folder / "2024_x_1H.csv").write_text("Timestamp,PM2.5 (µg/m³),Noise\n2024-01-01 00:00:00,NA,1\n2024-01-01 01:00:00,7.5,2\nbad,oops,3\n", encoding="utf-8")
    rows = fs.read_csv(spark, str(tmp_path))
    got = [(r.ts, r.pm25, r.pm10) for r in rows.orderBy("file_order").collect()]
    assert got == [("2024-01-01 00:00:00", None, None), ("2024-01-01 01:00:00", 7.5, None), ("bad", None, None)]
    parsed = c.drop_bad_timestamps(c.parse_timestamps(rows, "ts", "at"), "at")
    assert parsed.count() == 2
    found = fs.discover(spark, f"file:{tmp_path}").first()
    assert (found.entity.replace("%20", " "), found.extension) == ("Station A", ".csv")


def _direct_episodes(values, threshold, gap):
    high = [v >= threshold for v in values]
    out, i = [], 0
    while i < len(high):
        if not high[i]:
            i += 1
            continue
        start, last = i, i
        j = i + 1
        while j < len(high) and j - last <= gap + 1:
            if high[j]:
                last = j
            j += 1
        out.append((start, last))
        i = last + 1
    return out


def test_episodes_bridge_rows_like_a_direct_loop(spark):
    rng = np.random.default_rng(11)
    values = rng.uniform(300, 500, 300)
    df = frame(spark, pd.DataFrame({"e": 1, "hour_no": np.arange(300), "v": values}), "e long, hour_no long, v double")
    got = sorted((r.start_hour, r.end_hour, r.peak) for r in ep.episodes(df, ["e"], "v", 440.0, max_gap=3).collect())
    want = [(a, b, max(values[a : b + 1])) for a, b in _direct_episodes(values, 440.0, 3)]
    assert [g[:2] for g in got] == [w[:2] for w in want]
    np.testing.assert_allclose([g[2] for g in got], [w[2] for w in want])


def test_alerts_count_only_before_the_crossing(spark):
    hours = list(range(24))
    y = [450.0 if h <= 6 else 100.0 for h in hours]  # target hours 6..12 are high
    pred = [420.0 if h == 4 else 100.0 for h in hours]
    df = frame(spark, pd.DataFrame({"e": 1, "hour_no": hours, "y": y, "p": pred, "n": [100.0] * 24}), "e long, hour_no long, y double, p double, n double")
    rep = {r.model: r for r in ep.detection_report(df, ["e"], horizon=6, actual="y", models={"final": "p", "persistence": "n"}, threshold=401.0).collect()}
    assert (rep["final"].detection, rep["final"].lead_time_hours, rep["final"].n_alerts) == ("hit", 2.0, 1)
    assert (rep["persistence"].detection, rep["persistence"].lead_time_hours) == ("miss", 0.0)
    assert rep["final"].duration_hours == 7


def _sources(noise=6.0, shift=0, stations=7, days=10, bad=(), seed=3):
    rng = np.random.default_rng(seed)
    shadow, primary = [], []
    for s in range(stations):
        walk = 120 + 60 * np.sin(np.arange(days * 24) / 24 * 2 * np.pi) + np.cumsum(rng.normal(0, 2, days * 24))
        walk = np.maximum(walk, 20)
        for h in range(days * 24):
            primary.append((s, 1000 + h, float(walk[h])))
            v = walk[h] * (2.0 if s in bad else 1.0) + rng.normal(0, noise)
            shadow.append((s, 1000 + h - shift, float(v)))
    return shadow, primary


def _gate(spark, **kw):
    shadow, primary = _sources(**kw)
    schema = "e long, hour_no long, pm25 double"
    ev = ag.gate_evidence(spark.createDataFrame(shadow, schema), spark.createDataFrame(primary, schema), "e", ["pm25"])
    verdict = ag.gate_verdicts(ev, "e", ["pm25"])
    return verdict.first(), sorted(r.e for r in ag.usable_stations(ev, verdict, "e", ["pm25"]).collect())


def test_gate_passes_good_sources_and_names_the_failing_part(spark):
    verdict, usable = _gate(spark)
    assert verdict.passed and verdict.lag == 0 and usable == list(range(7))
    verdict, usable = _gate(spark, shift=1)
    assert verdict.passed and verdict.lag == 1
    verdict, usable = _gate(spark, bad=(0, 1))
    assert verdict.passed and usable == [2, 3, 4, 5, 6]
    verdict, usable = _gate(spark, bad=(0, 1, 2))
    assert not verdict.passed and verdict.reasons == "stations passing" and usable == []


def test_scores_skill_and_streaks(spark):
    rows = [(i, 1, "aqi", 6, dt.datetime(2024, 1, 1) + dt.timedelta(hours=12 * i), 100.0, 101.0, 102.0, 101.5) for i in range(60)]
    df = spark.createDataFrame(rows, "forecast_id long, e long, target string, horizon int, target_time timestamp_ntz, actual double, y_hat double, y_persistence double, y_window_update double")
    scores = sc.score_frame(df)
    p = sc.product_skill(scores, F.to_date("target_time"), draws=50).first()
    assert p.skill_vs_persistence == pytest.approx(0.5) and p.skill_vs_window_update == pytest.approx(1 / 3) and p.skill_vs_persistence_lo == pytest.approx(0.5)
    rolling = sc.rolling_skill(scores, F.to_date("target_time"), "e", days=30)
    assert rolling.where("n < 20").count() == 0 and rolling.where("e IS NULL").agg(F.max("n")).first()[0] == 60
    hist = [("aqi", 6, dt.date(2024, 1, d), -0.1 if d > 3 else 0.2, None if d == 8 else -0.2, 50) for d in range(1, 11)]
    history = spark.createDataFrame(hist, "target string, horizon int, window_end date, skill_mae double, skill_vs_window_update double, n long")
    runs = spark.createDataFrame([("a", "failed", i) for i in range(3)] + [("b", "failed" if i else "success", i) for i in range(3)], "job string, status string, started_at long")
    assert sc.negative_streak(history, ["target", "horizon"], "window_end", "skill_vs_window_update", "s").first().s == 2
    assert sorted(r.key for r in sc.alert_table(history, runs).collect()) == ["job-a", "skill-aqi-6h"]


def test_stall_decisions(spark):
    df = spark.createDataFrame([(None, False), (49.0, True), (10.0, True), (2.0, True), (2.0, False)], "age double, open boolean")
    assert [r[0] for r in df.select(sc.stall_decision(F.col("age"), F.col("open"))).collect()] == ["open", "refresh", "none", "close", "none"]


def test_splits_and_embargo_edges(spark):
    stamps = ["2025-08-30 23:00:00", "2025-08-31 00:00:00", "2025-09-01 00:00:00", "2025-10-31 23:00:00", "2025-11-01 00:00:00", "2026-02-01 00:00:00"]
    df = spark.createDataFrame([(s,) for s in stamps], "s string").select(F.to_timestamp_ntz("s").alias("ts"))
    windows = {"val": ("2025-09-01 00:00:00", "2025-10-31 23:59:59"), "test": ("2025-11-01 00:00:00", "2025-12-31 23:59:59")}
    s = df.withColumn("split", sp.assign_split("ts", windows))
    assert [r.split for r in s.orderBy("ts").collect()] == ["train", "train", "val", "val", "test", "train"]
    assert [str(r.ts) for r in sp.training_rows(s, "ts", "2025-09-01 00:00:00").collect()] == ["2025-08-30 23:00:00"]


def test_metric_conventions(spark):
    df = spark.createDataFrame([(0.5, 1.0, 0.0), (310.0, 300.0, 305.0), (100.0, None, 1.0)], "y double, p double, c double")
    m = sc.regression_metrics(df, [], "y", "p", current="c").first()
    assert m.n == 2 and m.mae == pytest.approx(5.25) and m.mape == pytest.approx(100 * (0.5 / 1 + 10 / 310) / 2)
    assert m.mape_positive == pytest.approx(100 * (0.5 / 0.5 + 10 / 310) / 2) and m.mae_extreme == 10.0 and m.mae_severe is None
    assert m.directional_accuracy == 50.0


def test_repair_window_arguments(spark):
    df = spark.createDataFrame([(h,) for h in range(20)], "hour_no long")
    assert jb.repair_rows(df, 3, 7, 10).count() == 5
    for args in ((7, 3, 10), (3, 11, 10), (0, 9, 10)):
        with pytest.raises(ValueError):
            jb.repair_rows(df, *args, limit=5)


def test_drift_guard(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.1)], "a double, b double")
    with pytest.raises(sc.DriftError):
        sc.require_same(df, "a", "b")
