"""Feed parsing, landed files, exports and streams over data derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import piecewise as pw
from ..operators.grid import HOUR, with_label
from ..sources import export as xp, feeds as fd, files as fs
from ..streaming import jobs as jb, queries as st
from . import bindings as b
from .catalog import Tables, query


@query(
    "long_feed_rows",
    f"""WITH {b.READINGS_CTE}, r AS (SELECT entity, ts, pm25, CASE WHEN hour(ts) % 4 <> 0 THEN no2 END AS no2 FROM readings WHERE entity % 7 <> 6) SELECT 'Station-' || entity AS station_name, ts AS hour, round(pm25 + 1e-9, 3) AS pm25, round(no2 + 1e-9, 3) AS no2 FROM r""",
    "pm25 no2",
    digits=3,
)
def long_feed_rows(t: Tables):
    """Station x pollutant records pivoted to hourly rows, `NA` as missing, the last delivery per cell."""
    r = b.readings_ts(t)
    stamp = F.date_format(F.col("ts") + F.expr("INTERVAL 1 HOUR"), "dd-MM-yyyy HH:mm:ss")
    # an early delivery of pm25 is replaced by the one that arrives later
    cells = F.array(
        F.struct(F.lit("PM2.5").alias("pollutant_id"), F.lit("1.0").alias("pollutant_avg"), F.lit(1).alias("seq")),
        F.struct(F.lit("pm2.5 ").alias("pollutant_id"), F.round(F.col("pm25") + 1e-9, 3).cast("string").alias("pollutant_avg"), F.lit(2).alias("seq")),
        F.struct(F.lit("NO2").alias("pollutant_id"), F.when(F.hour("ts") % 4 != 0, F.coalesce(F.round(F.col("no2") + 1e-9, 3).cast("string"), F.lit("NA"))).otherwise("NA").alias("pollutant_avg"), F.lit(1).alias("seq")),
        F.struct(F.lit("DUST").alias("pollutant_id"), F.lit("5").alias("pollutant_avg"), F.lit(1).alias("seq")),
    )
    # one label in seven is in no alias table
    station = F.when(F.col("entity") % 7 != 6, F.concat(F.lit("station-"), F.col("entity"), F.lit(", somewhere"))).otherwise("unknown place")
    records = r.select(station.alias("station"), stamp.alias("last_update"), F.inline(cells))
    name = F.concat(F.lit("Station-"), F.col("entity"))
    aliases = b.station_events(t).select("entity").distinct().select(name.alias("alias"), name.alias("canonical"))
    out = fd.long_feed_rows(records, aliases)
    return out.select("station_name", "hour", "pm25", "no2").where("pm25 IS NOT NULL OR no2 IS NOT NULL")


@query(
    "index_feed_rows",
    f"""WITH v AS (SELECT event_id, date_trunc('hour', ts + INTERVAL '5 hours 30 minutes') AS ts, floor(value)::DOUBLE AS us, event_type FROM events)
    SELECT event_id, ts, CASE WHEN event_type <> 'error' THEN {b.interpolation_sql('least(us, 500)', pw.US_INDEX_KNOTS, pw.US_CONCENTRATION_KNOTS['pm25'])} END AS pm25,
      CASE WHEN event_type = 'view' THEN {b.interpolation_sql('least(us, 500)', pw.US_INDEX_KNOTS, pw.US_CONCENTRATION_KNOTS['o3'])} / {pw._us_unit_factor('o3')!r} END AS o3 FROM v""",
    "pm25 o3",
)
def index_feed_rows(t: Tables):
    """Nested sub-index feed back to concentrations at the floored local hour."""
    us = F.floor("value").cast("double")
    cell = lambda cond: F.when(cond, F.struct(us.alias("v")))
    iaqi = F.struct(cell(F.col("event_type") != "error").alias("pm25"), cell(F.col("event_type") == "view").alias("o3"), F.struct(F.lit(20.0).alias("v")).alias("t"))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    payload = F.to_json(F.struct(F.struct(iso.alias("iso")).alias("time"), iaqi.alias("iaqi")))
    return fd.index_feed_rows(t.events.select("event_id", payload.alias("payload")), "payload", zone="Asia/Kolkata", keep=["event_id"]).select("event_id", "ts", "pm25", "o3")


@query(
    "array_feed_rows",
    """SELECT event_id, date_trunc('hour', ts + INTERVAL '5 hours 30 minutes') AS ts, value AS national_index, value / 2 AS universal_index, CASE WHEN event_id % 10 <> 0 THEN value END AS pm25, value * 46.0055 / 24.45 AS no2,
      CASE WHEN event_id % 10 = 0 THEN 'pm25' ELSE '' END AS unit_changed FROM events""",
    "national_index universal_index pm25 no2",
)
def array_feed_rows(t: Tables):
    """Array feed with unit labels: converted units, both index scales, changed labels quarantined."""
    conc = lambda unit: F.struct(F.col("value").alias("value"), unit.alias("units"))
    mass, ppb = F.lit("MICROGRAMS_PER_CUBIC_METER"), F.lit("PARTS_PER_BILLION")
    pollutants = F.array(
        F.struct(F.lit("pm25").alias("code"), conc(F.when(F.col("event_id") % 10 == 0, ppb).otherwise(mass)).alias("concentration")),
        F.struct(F.lit("no2").alias("code"), conc(ppb).alias("concentration")),
    )
    indexes = F.array(F.struct(F.lit("ind_cpcb").alias("code"), F.col("value").alias("aqi")), F.struct(F.lit("uaqi").alias("code"), (F.col("value") / 2).alias("aqi")))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    payload = F.to_json(F.struct(iso.alias("dateTime"), indexes.alias("indexes"), pollutants.alias("pollutants")))
    out = fd.array_feed_rows(t.events.select("event_id", payload.alias("payload")), "payload", zone="Asia/Kolkata", keep=["event_id"])
    return out.select("event_id", "ts", "national_index", "universal_index", "pm25", "no2", F.array_join("unit_changed", ",").alias("unit_changed"))


_HOURS = [f"{h:02d}:00:00" for h in range(24)]


@query("wide_sheet_rows", f"WITH {b.READINGS_CTE} SELECT entity, ts, round(pm25 + 1e-9, 3) AS value FROM readings WHERE pm25 IS NOT NULL", "value", digits=3)
def wide_sheet_rows(t: Tables):
    """Hour-column sheets (year and month in the file name, bare day numbers) back to one row per hour."""
    r = b.readings_ts(t)
    cells = [F.max(F.when(F.hour("ts") == h, F.round(F.col("pm25") + 1e-9, 3).cast("string"))).alias(name) for h, name in enumerate(_HOURS)]
    file = F.concat(F.lit("hourly_station_"), F.col("entity").cast("string"), F.date_format("ts", "_yyyy_MMMM_"), F.lit("sheet.csv"))
    day = F.concat(F.dayofmonth("ts").cast("string"), F.lit(".0"))
    sheets = r.groupBy(file.alias("file"), day.alias("Date")).agg(*cells)
    # a day that does not exist is dropped
    bad = sheets.withColumn("Date", F.lit("32"))
    long = fs.wide_hours_to_long(sheets.unionByName(bad), "Date", _HOURS, "file").where("ts IS NOT NULL")
    return long.select(F.regexp_extract("file", r"station_(\d+)_", 1).cast("long").alias("entity"), "ts", "value")


@query(
    "landed_csv_scan",
    "SELECT year(o_orderdate)::INT AS year, count(*) AS rows, count(CASE WHEN o_orderkey % 5 <> 0 THEN 1 END) AS present, sum(CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END) AS total FROM orders WHERE year(o_orderdate) IN (1996, 1997) GROUP BY 1",
    "total",
    digits=2,
)
def landed_csv_scan(t: Tables):
    """Orders landed as CSV by year with null tokens, discovered, read with renamed headers, stored by year, pruned."""
    root = fs.scratch_folder(t.spark, "landed")
    price = F.when(F.col("o_orderkey") % 5 == 0, F.when(F.col("o_orderkey") % 2 == 0, "NA").otherwise("--")).otherwise(F.col("o_totalprice").cast("string"))
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    landed = t.orders.select(stamp.alias("Timestamp"), F.col("o_orderkey").cast("string").alias("Key"), price.alias("PM2.5 (µg/m³)"), F.lit("x").alias("Other"))
    landed.write.option("header", True).csv(f"{root}/raw")
    rows = fs.read_csv(t.spark, f"{root}/raw", {"Timestamp": "ts", "Key": "key", "PM2.5 (µg/m³)": "pm25"}, text=("ts", "key"))
    rows.withColumn("year", F.substring("ts", 1, 4).cast("int")).write.partitionBy("year").parquet(f"{root}/stored")
    kept = fs.read_years(t.spark, f"{root}/stored", [1996, 1997], ["key"])
    return kept.groupBy("year").agg(F.count(F.lit(1)).alias("rows"), F.count("pm25").alias("present"), F.sum("pm25").alias("total"))


@query(
    "discovered_files",
    "SELECT 'station-' || (user_id // 50) AS entity, '.csv' AS extension, true AS has_content, count(DISTINCT date_trunc('day', ts)) AS days FROM events GROUP BY 1",
)
def discovered_files(t: Tables):
    """Landed station folders listed without reading a file: one folder per station, one file per day."""
    root = fs.scratch_folder(t.spark, "archive")
    name = F.concat(F.lit("station-"), F.col("entity"))
    rows = b.station_events(t).select(name.alias("station"), F.to_date("ts").cast("string").alias("day"), "event_id", "value")
    rows.repartition("station", "day").write.partitionBy("station", "day").option("header", True).csv(root)
    found = fs.discover(t.spark, root, pattern="*.csv")
    folder = F.regexp_replace(F.element_at(F.split("path", "/"), -2), "%3A", ":")
    station = F.regexp_extract("path", "station=([^/]+)/", 1)
    return found.groupBy(station.alias("entity"), "extension").agg((F.min("length") > 0).alias("has_content"), F.count_distinct(folder).alias("days"))


@query(
    "landed_time_range",
    "SELECT event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-12 12:00:00' GROUP BY 1",
)
def landed_time_range(t: Tables):
    """Inclusive time range pushed down to the parquet scan."""
    rows = fs.read_range(t.spark, f"{t.path}/events.parquet", "ts", "2024-01-10 00:00:00", "2024-01-12 12:00:00")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(
    "dataset_export",
    f"""WITH {b.FORECAST_CTE}, s AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-19' THEN 'train' WHEN ts < TIMESTAMP '2024-01-24' THEN 'val' ELSE 'test' END AS split FROM fc)
    SELECT split, count(*) AS rows, 2 AS features, min(y_true) AS target_min, max(y_true) AS target_max FROM s GROUP BY 1""",
    "target_min target_max",
)
def dataset_export(t: Tables):
    """Per-horizon dataset written by split, reloaded and summarised in its manifest."""
    from ..operators.splits import assign_split
    from .model_queries import WINDOWS

    folder = fs.scratch_folder(t.spark, "dataset")
    f = b.forecast_frame(t).withColumn("split", assign_split("ts", WINDOWS))
    data = xp.horizon_dataset(f, "y_true", {"A": ["y_curr"], "C": ["y_pred"]}, meta=["entity", "ts", "split"])
    xp.write_matrix(data, folder, sort=["entity", "ts"])
    return xp.dataset_manifest(t.spark.read.parquet(folder), "split", "y_true", 2)


@query("public_export", "SELECT 'columns' AS check, 0::BIGINT AS failures, true AS ok UNION ALL SELECT 'row_count', 0, true UNION ALL SELECT 'range:pm25', (SELECT count(*) FROM events WHERE value > 400), (SELECT count(*) FROM events WHERE value > 400) = 0 UNION ALL SELECT 'duplicate_keys', 0, true UNION ALL SELECT 'foreign:kind', (SELECT count(*) FROM events WHERE event_type = 'error'), (SELECT count(*) FROM events WHERE event_type = 'error') = 0")
def public_export(t: Tables):
    """Ordered public CSV with ISO stamps and JSON flags, read back and validated."""
    folder = fs.scratch_folder(t.spark, "public")
    flags = F.when(F.col("event_id") % 97 == 0, F.create_map(F.lit("pm25"), F.lit("sentinel")))
    rows = t.events.select(F.col("event_id").alias("station_id"), F.col("ts").alias("timestamp"), F.col("value").alias("pm25"), F.col("event_type").alias("kind"), flags.alias("qc_flags"))
    columns = ["station_id", "timestamp", "pm25", "kind", "qc_flags"]
    xp.write_public_csv(xp.public_rows(rows, columns, "timestamp", flags="qc_flags"), folder, ["timestamp", "station_id"])
    back = t.spark.read.option("header", True).schema("station_id long, timestamp string, pm25 double, kind string, qc_flags string").csv(folder)
    n = t.events.count()
    return xp.validate_export(back, rows=n, columns=columns, keys=["station_id", "timestamp"], ranges={"pm25": (0, 400)}, foreign={"kind": (t.events.where("event_type <> 'error'"), "event_type")})


# --------------------------------------------------------------------------------------------------------- streaming
def _events_stream(t: Tables, watermark: str | None = st.LOOKBACK):
    s = st.stream_table(t.spark, f"{t.path}/events.parque[t]", t.events.schema, "ts", watermark=watermark)
    return s.withColumn("entity", b.entity_of())


@query(
    "streamed_slot_hours",
    """WITH s AS (SELECT user_id // 50 AS entity, time_bucket(INTERVAL 15 MINUTE, ts) AS start, arg_max(value, event_id) AS v FROM events GROUP BY ALL) SELECT entity, date_trunc('hour', start) AS ts, avg(v) AS hourly FROM s GROUP BY ALL HAVING count(*) = 4""",
    "hourly",
)
def streamed_slot_hours(t: Tables):
    """Complete hours from slots on a stream; equals the batch result."""
    folder = fs.scratch_folder(t.spark, "stream")
    hours = st.slot_hours(_events_stream(t), ["entity"], "ts", "value", "event_id", "hourly")
    st.run_available(hours, st.batch_sink(folder), folder)
    out = st.read_latest(t.spark, folder, ["entity", "hour"]).where("hourly IS NOT NULL")
    return out.select("entity", F.col("hour").cast("timestamp_ntz").alias("ts"), "hourly")


def _hour_table(t: Tables) -> str:
    """Hourly index written once as the stream's input."""
    folder = fs.scratch_folder(t.spark, "hours")
    with_label(b.hourly(t)).select("entity", HOUR, "ts", "hourly_index").write.parquet(folder)
    return folder


def _hour_stream(t: Tables):
    path = _hour_table(t)
    return st.stream_table(t.spark, path, t.spark.read.parquet(path).schema, "ts").where("hourly_index IS NOT NULL")


@query(
    "streamed_sliding_index",
    f"""WITH {b.INDEX_CTE}, h AS (SELECT entity, ts, hourly_index AS v FROM hourly WHERE hourly_index IS NOT NULL), w AS (SELECT entity, ts + to_hours(k) AS ts, v FROM h, (SELECT unnest(range(24)) AS k))
    SELECT entity, ts, avg(v) AS index_value FROM w GROUP BY ALL HAVING count(*) >= 16""",
    "index_value",
)
def streamed_sliding_index(t: Tables):
    """Trailing index by sliding windows on a stream of hourly values."""
    folder = fs.scratch_folder(t.spark, "stream")
    st.run_available(st.sliding_index(_hour_stream(t), ["entity"], "ts", "hourly_index", "index_value"), st.batch_sink(folder), folder)
    return st.read_latest(t.spark, folder, ["entity", "ts"]).select("entity", F.col("ts").cast("timestamp_ntz").alias("ts"), "index_value")


@query(
    "streamed_episodes",
    f"""WITH {b.INDEX_CTE}, h AS (SELECT entity, ts, hourly_index AS v FROM hourly WHERE hourly_index >= 320), s AS (SELECT *, CASE WHEN date_diff('hour', lag(ts) OVER (PARTITION BY entity ORDER BY ts), ts) <= 4 THEN 0 ELSE 1 END AS s FROM h),
      g AS (SELECT *, sum(s) OVER (PARTITION BY entity ORDER BY ts) AS g FROM s), e AS (SELECT entity, min(ts) AS start_time, max(ts) AS end_time, max(v) AS peak, count(*) AS hours_above FROM g GROUP BY entity, g)
    SELECT e.*, end_time + INTERVAL '4 hours 1 second' < (SELECT max(ts) FROM h) - INTERVAL 192 HOUR AS closed FROM e""",
    "peak",
)
def streamed_episodes(t: Tables):
    """Bridged episodes as session windows of a bounded replay, with those the look-back can no longer change marked closed."""
    folder = fs.scratch_folder(t.spark, "stream")
    sessions = st.episode_sessions(_hour_stream(t), ["entity"], "ts", "hourly_index", 320.0)
    st.run_available(sessions, st.batch_sink(folder), folder, mode="complete")
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    rows = st.newest_batch(t.spark, folder)
    horizon = rows.agg(F.max("end_time") - F.expr(f"INTERVAL {st.LOOKBACK}")).scalar()
    closed = F.col("end_time") + F.expr("INTERVAL '4:00:01' HOUR TO SECOND") < horizon
    return rows.select("entity", ntz("start_time"), ntz("end_time"), "peak", "hours_above", closed.alias("closed"))


@query("streamed_freshness", "SELECT user_id // 50 AS entity, max(ts) AS newest FROM events GROUP BY 1")
def streamed_freshness(t: Tables):
    """Newest event per station kept as stream state."""
    folder = fs.scratch_folder(t.spark, "stream")
    st.run_available(st.newest_hours(_events_stream(t, None), ["entity"], "ts"), st.batch_sink(folder), folder)
    return st.read_latest(t.spark, folder, ["entity"]).select("entity", F.col("newest").cast("timestamp_ntz").alias("newest"))


@query(
    "streamed_matured_forecasts",
    f"WITH {b.FORECAST_CTE} SELECT fc.entity, fc.ts + INTERVAL 6 HOUR AS target_time, y_pred AS y_hat, r.pm25 AS actual FROM fc JOIN readings r ON r.entity = fc.entity AND r.ts = fc.ts + INTERVAL 6 HOUR",
    "y_hat actual",
)
def streamed_matured_forecasts(t: Tables):
    """Forecasts meeting their actual in a stream-stream join with watermarks on both sides."""
    root = fs.scratch_folder(t.spark, "join")
    f = b.forecast_frame(t).select("entity", (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("target_time"), F.col("y_pred").alias("y_hat"))
    f.write.parquet(f"{root}/forecasts")
    b.readings_ts(t).select("entity", F.col("ts").alias("actual_time"), F.col("pm25").alias("actual")).write.parquet(f"{root}/actuals")
    read = lambda name, ts: st.stream_table(t.spark, f"{root}/{name}", t.spark.read.parquet(f"{root}/{name}").schema, ts, watermark="30 days")
    joined = st.matured_stream(read("forecasts", "target_time"), read("actuals", "actual_time"), ["entity"])
    st.run_available(joined, st.batch_sink(root), root, mode="append")
    return st.append_result(t.spark, root).select("entity", F.col("target_time").cast("timestamp_ntz").alias("target_time"), "y_hat", "actual")


@query("incremental_index", f"WITH {b.INDEX_CTE} SELECT entity, ts, index_value FROM idx WHERE index_value IS NOT NULL", "index_value")
def incremental_index(t: Tables):
    """Readings arriving in overlapping batches, upserted by day, the index recomputed from 48 hours of history.

    The result equals the index computed at once over all readings.
    """
    root = fs.scratch_folder(t.spark, "ingest")
    r = b.readings(t)
    first, last = r.agg(F.min(HOUR), F.max(HOUR)).first()
    n = (last - first) // 240 + 1
    part = F.floor((F.col(HOUR) - first) / 240)
    # later batches repeat the last 24 hours of the batch before, like a feed fetched with look-back
    again = r.where((F.col(HOUR) - first) % 240 >= 216).withColumn("part", F.least(part + 1, F.lit(n - 1)))
    r.withColumn("part", part).unionByName(again).write.partitionBy("part").parquet(f"{root}/landed")
    readings = jb.DayTable(t.spark, f"{root}/readings", ["entity", HOUR])
    index = jb.DayTable(t.spark, f"{root}/index", ["entity", HOUR])
    sink = jb.ingest_sink(readings, index, ["entity"])
    schema = t.spark.read.parquet(f"{root}/landed").drop("part").schema
    for p in range(n):
        stream = t.spark.readStream.schema(schema).parquet(f"{root}/landed/part={p}")
        st.run_available(stream, sink, f"{root}/run{p}", mode="append")
    return with_label(index.read()).select("entity", "ts", "index_value")


@query(
    "newest_live_hours",
    f"WITH {b.READINGS_CTE}, s AS (SELECT DISTINCT user_id // 50 AS entity FROM events) SELECT s.entity, max(r.ts) AS newest FROM s LEFT JOIN readings r ON r.entity = s.entity AND hour(r.ts) % 6 <> 0 GROUP BY 1",
)
def newest_live_hours(t: Tables):
    """Newest hour per station over live sources, rows tagged as backfill ignored."""
    r = b.readings_ts(t).withColumn("source", F.when(F.hour("ts") % 6 == 0, "backfill").otherwise("feed"))
    stations = b.station_events(t).select("entity").distinct()
    return with_label(jb.newest_live(r, stations, "entity", excluded=["backfill"]).withColumnRenamed("newest", HOUR), "newest").drop(HOUR)


@query("repair_window", f"WITH {b.READINGS_CTE} SELECT entity, ts, pm25 FROM readings WHERE ts BETWEEN TIMESTAMP '2024-01-12' AND TIMESTAMP '2024-01-13 23:00:00'", "pm25")
def repair_window(t: Tables):
    """Rows of an explicit closed window of complete hours."""
    first = 473352 + 11 * 24
    return with_label(jb.repair_rows(b.readings(t), first, first + 47, first + 400)).select("entity", "ts", "pm25")
