"""Streams equal their batch form, incremental equals full, repeated delivery changes nothing."""

import numpy as np
import pytest
from helpers import READING_SCHEMA, brute_index, frame, readings
from pyspark.sql import functions as F

from hourglass.operators import slots as sl
from hourglass.streaming import jobs as jb, queries as st


def test_incremental_index_equals_full_with_late_rows(spark, tmp_path):
    pdf = readings(200, (1, 2), gaps=0.1)
    late = pdf[(pdf.hour_no >= 1090) & (pdf.hour_no < 1094)]
    batches = [pdf[(pdf.hour_no < 1100) & ~pdf.index.isin(late.index)], pdf[pdf.hour_no >= 1090], late]
    tables = [jb.DayTable(spark, str(tmp_path / n), ["entity", "hour_no"]) for n in ("readings", "index")]
    sink = jb.ingest_sink(*tables, ["entity"])
    for i, b in enumerate(batches):
        sink(frame(spark, b, READING_SCHEMA), i)
    sink(frame(spark, late, READING_SCHEMA), 3)  # delivered again
    want = brute_index(pdf).dropna(subset=["index_value"]).set_index(["entity", "hour_no"])["index_value"]
    got = {(r.entity, r.hour_no): r.index_value for r in tables[1].read().collect()}
    assert got.keys() == set(want.index)
    np.testing.assert_allclose([got[k] for k in want.index], want.to_numpy())


def test_slot_stream_over_several_batches_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    import datetime as dt

    base = dt.datetime(2024, 1, 1)
    rows = [(1, base + dt.timedelta(minutes=15 * int(m)), float(rng.normal()), i) for i, m in enumerate(rng.integers(0, 160, 600))]
    schema = "e long, start timestamp_ntz, v double, arrival long"
    df = spark.createDataFrame(rows, schema)
    for part in range(3):
        df.where(F.col("arrival") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = st.stream_table(spark, str(tmp_path / "in"), df.schema, "start", files_per_trigger=1)
    out = str(tmp_path / "out")
    st.run_available(st.slot_hours(stream, ["e"], "start", "v", "arrival", "h"), st.batch_sink(out), out)
    got = sorted((r.hour.replace(tzinfo=None), r.h) for r in st.read_latest(spark, out, ["e", "hour"]).where("h IS NOT NULL").collect())
    from hourglass.operators.grid import with_label

    want = sorted((r.ts, r.h) for r in with_label(sl.slots_to_hours(df, ["e"], "start", "v", "h", arrival="arrival")).collect())
    assert [g[0] for g in got] == [w[0] for w in want]
    np.testing.assert_allclose([g[1] for g in got], [w[1] for w in want])


def test_matrix_and_public_export_round_trip(spark, tmp_path):
    from hourglass.sources import export as xp

    df = spark.createDataFrame([(1, "train", 1.0, {"a": "sentinel"}), (2, "val", 2.0, None), (2, "val", 2.0, None)], "k long, split string, v double, qc map<string,string>").withColumn("ts", F.lit("2024-01-01 05:00:00").cast("timestamp_ntz"))
    xp.write_matrix(df, str(tmp_path / "m"), sort=["k"])
    assert spark.read.parquet(str(tmp_path / "m")).where("split = 'val'").count() == 2
    rows = xp.public_rows(df, ["k", "ts", "v", "qc"], "ts", flags="qc")
    xp.write_public_csv(rows, str(tmp_path / "c"), ["ts", "k"])
    back = spark.read.option("header", True).csv(str(tmp_path / "c"))
    assert {(r.ts, r.qc) for r in back.collect()} == {("2024-01-01T05:00:00+05:30", '{"a":"sentinel"}'), ("2024-01-01T05:00:00+05:30", None)}
    checks = {r.check: r.failures for r in xp.validate_export(df, rows=4, columns=["k"], keys=["k", "ts"], ranges={"v": (0, 1)}, foreign={"k": (df.where("k = 1"), "k")}).collect()}
    assert checks == {"row_count": 1, "range:v": 2, "columns": 1, "duplicate_keys": 1, "foreign:k": 2}


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    from hourglass.sources import files as fs

    class Cluster:
        class sparkContext:
            master = "yarn"
            getCheckpointDir = staticmethod(lambda: None)

        conf = type("C", (), {"get": staticmethod(lambda _k, d=None: d)})

    with pytest.raises(ValueError):
        fs.scratch_folder(Cluster, "x")
