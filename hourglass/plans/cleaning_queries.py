"""Cleaning and quality queries over values with planted sentinels and sign errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quality as q
from ..operators import cleaning as c, health as hl
from . import bindings as b
from .catalog import Tables, query

# planted faults: instrument codes, sign flips, scale errors
_DIRTY_SQL = """dirty AS (SELECT event_id, ts, user_id, event_type,
    CASE WHEN event_id % 97 = 0 THEN -999.0 WHEN event_id % 101 = 0 THEN -value WHEN event_id % 211 = 0 THEN value * 1000 ELSE value END AS pm25,
    CASE WHEN event_id % 89 = 0 THEN 9999.0 ELSE value / 3 END AS rh_pct FROM events)"""


def dirty(t: Tables):
    e, v = F.col("event_id"), F.col("value")
    pm25 = F.when(e % 97 == 0, -999.0).when(e % 101 == 0, -v).when(e % 211 == 0, v * 1000).otherwise(v)
    rh = F.when(e % 89 == 0, 9999.0).otherwise(v / 3)
    return t.events.select("event_id", "ts", "user_id", "event_type", pm25.alias("pm25"), rh.alias("rh_pct"))


_PM = "CASE WHEN pm25 IN (-9999, 9999, -999) THEN 'SENTINEL' WHEN pm25 < 0 THEN 'OOB_BELOW_0' END"
_RH = "CASE WHEN rh_pct IN (-9999, 9999, -999) THEN 'SENTINEL' WHEN rh_pct < 0 THEN 'OOB_BELOW_0' WHEN rh_pct > 100 THEN 'OOB_ABOVE_100' END"


@query(
    "clean_cells",
    f"""WITH {_DIRTY_SQL} SELECT event_id, CASE WHEN {_PM} IS NULL THEN pm25 END AS pm25, CASE WHEN {_RH} IS NULL THEN rh_pct END AS rh_pct,
      {_PM} AS pm25_rule, {_RH} AS rh_rule FROM dirty""",
    "pm25 rh_pct",
)
def clean_cells(t: Tables):
    """Cells nulled by sentinel or bounds, with the rule that struck (the text before the rejected value)."""
    out = c.clean_cells(dirty(t), ["pm25", "rh_pct"])
    rule = lambda m: F.regexp_extract(F.try_element_at("qc_flags", F.lit(m)), r"^(SENTINEL|OOB_(BELOW|ABOVE)_\d+)", 1)
    return out.select("event_id", "pm25", "rh_pct", rule("pm25").alias("pm25_rule"), rule("rh_pct").alias("rh_rule"))


@query(
    "quality_counts",
    f"""WITH {_DIRTY_SQL}, r AS (SELECT {_PM} AS p, {_RH} AS h FROM dirty) SELECT (count(*) FILTER (WHERE p = 'SENTINEL') + count(*) FILTER (WHERE h = 'SENTINEL')) AS sentinel_replacements,
      (count(*) FILTER (WHERE p LIKE 'OOB%') + count(*) FILTER (WHERE h LIKE 'OOB%')) AS out_of_bounds_replacements,
      count(*) FILTER (WHERE p IS NOT NULL OR h IS NOT NULL) AS qc_flagged_rows, count(*) AS rows_total FROM r""",
)
def quality_counts(t: Tables):
    """Replacement counters of a cleaning run."""
    return c.qc_counts(c.clean_cells(dirty(t), ["pm25", "rh_pct"]))


_LIVE_SQL = """CASE WHEN pm25 IN (-9999, 9999, -999) THEN 'sentinel' WHEN pm25 < 0 THEN 'bounds' WHEN pm25 > 1500 THEN 'implausible' END"""
_HUM_SQL = """CASE WHEN rh_pct IN (-9999, 9999, -999) THEN 'sentinel' WHEN rh_pct < 0 OR rh_pct > 100 THEN 'bounds' END"""


def live(t: Tables):
    return c.clean_cells(dirty(t).withColumnRenamed("rh_pct", "humidity"), ["pm25", "humidity"], limits=q.LIVE, verbose=False)


@query(
    "live_quality_reasons",
    f"""WITH {_DIRTY_SQL}, r AS (SELECT user_id // 50 AS entity, 'pm25' AS measure, {_LIVE_SQL} AS reason FROM dirty UNION ALL SELECT user_id // 50, 'humidity', {_HUM_SQL} FROM dirty)
    SELECT entity, measure, reason, count(*) AS cells FROM r WHERE reason IS NOT NULL GROUP BY ALL""",
)
def live_quality_reasons(t: Tables):
    """Reason histogram of the live rules: flags exploded and counted over all rows."""
    return hl.flag_reasons(live(t).withColumn("entity", b.entity_of()), "qc_flags", ["entity"])


@query(
    "batch_guard",
    f"""WITH {_DIRTY_SQL}, r AS (SELECT 'pm25' AS measure, pm25 IS NOT NULL AS has, {_LIVE_SQL} AS reason FROM dirty UNION ALL SELECT 'humidity', rh_pct IS NOT NULL, {_HUM_SQL} FROM dirty)
    SELECT measure, count(*) FILTER (WHERE reason IS NULL OR reason = 'implausible') AS present, count(*) FILTER (WHERE reason = 'implausible') AS implausible,
      count(*) FILTER (WHERE reason IS NULL OR reason = 'implausible') >= 20 AND count(*) FILTER (WHERE reason = 'implausible') / count(*) FILTER (WHERE reason IS NULL OR reason = 'implausible') > 0.25 AS failed
    FROM r GROUP BY 1""",
)
def batch_guard(t: Tables):
    """Share of implausible cells per column and the verdict on the batch."""
    return c.batch_guard(live(t), ["pm25", "humidity"])


_JSON_K = "(props->>'$.k')::INT"


@query(
    "json_flag_reasons",
    """SELECT event_type, 'k' AS measure, (props->>'$.k') AS reason, count(*) AS cells FROM events GROUP BY ALL""",
)
def json_flag_reasons(t: Tables):
    """JSON flag maps parsed and counted by reason."""
    parsed = t.events.withColumn("flags", F.from_json("props", "map<string,string>"))
    return hl.flag_reasons(parsed, "flags", ["event_type"])


@query(
    "quality_hits",
    f"""WITH {_DIRTY_SQL}, r AS (SELECT event_type, 'pm25' AS measure, pm25 AS value, {_PM} AS why FROM dirty UNION ALL SELECT event_type, 'rh_pct', rh_pct, {_RH} FROM dirty)
    SELECT CASE WHEN why = 'SENTINEL' THEN 'sentinel' WHEN why LIKE 'OOB_BELOW%' THEN 'below' ELSE 'above' END AS rule, measure, value, count(*) AS hits, min(event_type) AS example_file
    FROM r WHERE why IS NOT NULL GROUP BY ALL""",
    "value",
)
def quality_hits(t: Tables):
    """Hits per rule, column and value with an example file."""
    return c.quality_hits(dirty(t), ["pm25", "rh_pct"], "event_type")


@query(
    "timestamp_coercion",
    """WITH r AS (SELECT user_id // 50 AS entity, CASE WHEN event_id % 13 = 0 THEN 'not a time' WHEN event_id % 17 = 0 THEN '1970-01-01 00:00:00' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS raw FROM events),
      p AS (SELECT entity, try_cast(raw AS TIMESTAMP) AS ts FROM r), g AS (SELECT entity, CASE WHEN ts > TIMESTAMP '1970-01-01' THEN ts END AS ts FROM p)
    SELECT entity, count(*) AS raw_rows, count(*) FILTER (WHERE ts IS NULL) AS dropped, min(ts) - INTERVAL '5 hours 30 minutes' AS first_utc FROM g GROUP BY 1""",
)
def timestamp_coercion(t: Tables):
    """Unparsable and epoch stamps dropped and counted, then localised to UTC."""
    e = F.col("event_id")
    raw = F.when(e % 13 == 0, "not a time").when(e % 17 == 0, "1970-01-01 00:00:00").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    parsed = c.parse_timestamps(b.station_events(t).withColumn("raw", raw), "raw", "at")
    return parsed.groupBy("entity").agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(F.col("at").isNull()).alias("dropped"),
        c.to_utc(F.min("at").cast("timestamp"), "Asia/Kolkata").cast("timestamp_ntz").alias("first_utc"),
    )


@query(
    "dedupe_keep_last",
    """SELECT user_id, date_trunc('hour', ts) AS hour, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY ALL""",
    "value",
)
def dedupe_keep_last(t: Tables):
    """One reading per key, last in file order."""
    e = t.events.select("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "value", "event_id")
    return c.dedupe(e, ["user_id", "hour"], ["event_id"])


@query(
    "dedupe_keep_first",
    """SELECT user_id, date_trunc('hour', ts) AS hour, arg_min(value, event_id) AS value, min(event_id) AS event_id FROM events GROUP BY ALL""",
    "value",
)
def dedupe_keep_first(t: Tables):
    """One reading per key, first in file order."""
    e = t.events.select("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "value", "event_id")
    return c.dedupe(e, ["user_id", "hour"], ["event_id"], keep="first")


@query(
    "station_names",
    """SELECT s_suppkey, trim(s_name) AS name, CASE WHEN s_suppkey % 7 = 0 THEN 'Delhi' ELSE n_name END AS city, CASE WHEN s_suppkey % 7 = 0 THEN 'Unknown' ELSE r_name END AS operator
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def station_names(t: Tables):
    """"Name, City - Operator" labels (with stray tabs) split into parts."""
    j = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    full = F.concat(F.col("s_name"), F.lit(", "), F.col("n_name"), F.lit(" - "), F.col("r_name"), F.lit("\t"))
    raw = F.when(F.col("s_suppkey") % 7 == 0, F.col("s_name")).otherwise(full)
    return j.withColumn("raw", raw).select("s_suppkey", *[x.alias(n) for n, x in c.split_station_name("raw", city="Delhi").items()])


@query("alias_mapping", """SELECT c_custkey, n_name AS station FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def alias_mapping(t: Tables):
    """Feed labels in another case and with a suffix mapped to canonical names."""
    aliases = t.nation.select(F.concat("n_name", F.lit(", City - Net")).alias("alias"), F.col("n_name").alias("canonical"))
    labelled = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    label = F.when(F.col("c_custkey") % 2 == 0, F.concat("n_name", F.lit(", City - Net\t"))).otherwise(F.concat(F.lower("n_name"), F.lit(", elsewhere")))
    return c.map_aliases(labelled.select("c_custkey", label.alias("label")), "label", aliases).select("c_custkey", "station")


_FINISH = f"""WITH {b.READINGS_CTE}, w AS (SELECT entity, ts, co * 10 AS temperature, no2 AS humidity FROM readings),
  s AS (SELECT entity, ts, pm25, CASE WHEN hour(ts) % 3 = 0 THEN co * 20 END AS temperature, CASE WHEN hour(ts) % 5 = 0 THEN no2 END AS humidity FROM readings),
  f AS (SELECT s.entity, s.ts, s.pm25, coalesce(s.temperature, w.temperature) AS temperature, coalesce(s.humidity, w.humidity) AS humidity,
    s.temperature IS NULL AND w.temperature IS NOT NULL AS tf, s.humidity IS NULL AND w.humidity IS NOT NULL AS hf FROM s LEFT JOIN w USING (entity, ts)),
  q AS (SELECT entity, ts, CASE WHEN pm25 BETWEEN 0 AND 1500 THEN pm25 END AS pm25, CASE WHEN temperature BETWEEN -5 AND 55 THEN temperature END AS temperature,
    CASE WHEN humidity BETWEEN 0 AND 100 THEN humidity END AS humidity, tf, hf FROM f),
  z AS (SELECT *, (temperature IS NOT NULL)::INT + (humidity IS NOT NULL)::INT AS np, (temperature IS NOT NULL AND tf)::INT + (humidity IS NOT NULL AND hf)::INT AS nf FROM q)"""


def finished(t: Tables):
    r = b.readings_ts(t)
    weather = r.select("entity", "ts", (F.col("co") * 10).alias("temperature"), F.col("no2").alias("humidity"))
    own = r.select(
        "entity", "ts", "pm25", F.when(F.hour("ts") % 3 == 0, F.col("co") * 20).alias("temperature"), F.when(F.hour("ts") % 5 == 0, F.col("no2")).alias("humidity")
    )
    filled = c.fill_missing(own, weather, ["entity", "ts"], ["temperature", "humidity"], tag="filled:open-meteo")
    return c.finish_hourly(filled, ["pm25", "temperature", "humidity"], source="feed", row_flags="row_flags", weather=("temperature", "humidity"))


@query(
    "finish_hourly",
    f"""{_FINISH} SELECT entity, ts, pm25, temperature, humidity, CASE WHEN np = 0 THEN NULL WHEN nf = 0 THEN 'station' WHEN nf = np THEN 'open-meteo' ELSE 'mixed' END AS weather_source, 'feed' AS source
    FROM z WHERE pm25 IS NOT NULL OR temperature IS NOT NULL OR humidity IS NOT NULL""",
    "pm25 temperature humidity",
)
def finish_hourly(t: Tables):
    """Weather cells filled from a second table, quality rules, weather source, empty rows dropped."""
    return finished(t).drop("qc_flags")


@query(
    "mask_filled",
    f"""{_FINISH} SELECT entity, ts, CASE WHEN NOT tf OR temperature IS NULL THEN temperature END AS temperature, CASE WHEN NOT hf OR humidity IS NULL THEN humidity END AS humidity
    FROM z WHERE pm25 IS NOT NULL OR temperature IS NOT NULL OR humidity IS NOT NULL""",
    "temperature humidity",
)
def mask_filled(t: Tables):
    """Filled cells nulled again by their flag."""
    return c.mask_filled(finished(t), ["temperature", "humidity"]).select("entity", "ts", "temperature", "humidity")


@query(
    "scenario_masking",
    f"""WITH {b.READINGS_CTE} SELECT entity, ts, NULL::DOUBLE AS o3, CASE WHEN entity <> 1 THEN co END AS co, CASE WHEN entity IN (0, 2) THEN pm10 / 3.6 ELSE no2 END AS no2, pm25 FROM readings""",
    "o3 co no2 pm25",
)
def scenario_masking(t: Tables):
    """Columns masked for everyone or for listed stations, one refilled with a unit factor."""
    r = b.readings_ts(t)
    weather = r.select("entity", "ts", F.col("pm10").alias("wind_kmh"))
    out = c.apply_scenario(r, "entity", ["entity", "ts"], {"*": ["o3"], 1: ["co"], 0: ["no2"], 2: ["no2"]}, weather, {"no2": ("wind_kmh", 1 / 3.6)})
    return out.select("entity", "ts", "o3", "co", "no2", "pm25")


@query(
    "source_preference",
    f"""WITH {b.READINGS_CTE}, p AS (SELECT entity, ts, pm25 AS v FROM readings WHERE hour(ts) % 2 = 0), s AS (SELECT entity, ts, pm10 AS v FROM readings WHERE hour(ts) % 3 = 0)
    SELECT entity, ts, v, 'official' AS origin FROM p UNION ALL SELECT entity, ts, v, 'recomputed' FROM s ANTI JOIN p USING (entity, ts)""",
    "v",
)
def source_preference(t: Tables):
    """Primary rows win, the second source only backfills."""
    r = b.readings_ts(t)
    primary = r.where(F.hour("ts") % 2 == 0).select("entity", "ts", F.col("pm25").alias("v"))
    second = r.where(F.hour("ts") % 3 == 0).select("entity", "ts", F.col("pm10").alias("v"))
    return c.prefer(primary, second, keys=["entity", "ts"], source="origin", names=["official", "recomputed"])


@query(
    "fallback_source",
    f"""WITH {b.READINGS_CTE}, p AS (SELECT entity, ts, ts::DATE AS day, pm25 AS v FROM readings WHERE day(ts) % 3 <> 0), s AS (SELECT entity, ts, ts::DATE AS day, pm10 AS v FROM readings)
    SELECT * FROM p UNION ALL SELECT * FROM s ANTI JOIN p USING (day)""",
    "v",
)
def fallback_source(t: Tables):
    """Second source used only for windows in which the first has no rows."""
    r = b.readings_ts(t).withColumn("day", F.to_date("ts"))
    primary = r.where(F.dayofmonth("ts") % 3 != 0).select("entity", "ts", "day", F.col("pm25").alias("v"))
    return c.fallback(primary, r.select("entity", "ts", "day", F.col("pm10").alias("v")), ["day"])


@query(
    "model_inputs",
    f"""WITH {b.READINGS_CTE} SELECT entity AS station_id, ts + INTERVAL '5 hours 30 minutes' AS timestamp, pm25, o3 AS ozone, NULL::DOUBLE AS nox FROM readings""",
    "pm25 ozone",
)
def model_inputs(t: Tables):
    """Stored readings reshaped for the model: zone shift, name map, missing columns added."""
    from ..sources.feeds import to_model_inputs

    return to_model_inputs(b.readings_ts(t), {"entity": "station_id", "pm25": "pm25", "o3": "ozone"}, "ts", "Asia/Kolkata", absent=["nox"])


# ------------------------------------------------------------------------------------------------------ data health
@query(
    "null_counts",
    f"""WITH {b.READINGS_CTE} SELECT entity, count(*) AS total, {', '.join(f'(count(*) - count({p})) AS {p}_missing' for p in b.MEASURED)} FROM readings GROUP BY GROUPING SETS ((entity), ())""",
)
def null_counts(t: Tables):
    """Missing cells per column, per station and in total."""
    return hl.null_counts(b.readings(t), "entity", b.MEASURED)


_GAPS = f"""{b.READINGS_CTE}, d AS (SELECT entity, ts, lag(ts) OVER (PARTITION BY entity ORDER BY ts) AS prev FROM readings),
  g AS (SELECT entity, prev AS gap_start, ts AS gap_end, date_diff('hour', prev, ts) - 1 AS missing_hours FROM d WHERE date_diff('hour', prev, ts) > 1)"""


@query("gap_list", f"WITH {_GAPS} SELECT * FROM g")
def gap_list(t: Tables):
    """Gaps between consecutive readings with the hours missing."""
    return hl.gap_list(b.readings(t), b.BY)


@query(
    "coverage",
    f"""WITH {_GAPS}, c AS (SELECT entity, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS observed, date_diff('hour', min(ts), max(ts)) + 1 AS expected FROM readings GROUP BY 1),
      a AS (SELECT entity, count(*) AS gaps, max(missing_hours) AS longest_gap FROM g GROUP BY 1)
    SELECT entity, first_ts, last_ts, observed, expected, expected - observed AS missing, coalesce(gaps, 0) AS gaps, coalesce(longest_gap, 0) AS longest_gap, 100.0 * observed / expected AS coverage_pct
    FROM c LEFT JOIN a USING (entity)""",
    "coverage_pct",
)
def coverage(t: Tables):
    """Observed, expected and missing hours, number of gaps and the longest, for all stations at once."""
    return hl.coverage(b.readings(t), b.BY)


@query(
    "gap_statistics",
    f"""WITH {b.READINGS_CTE}, d AS (SELECT entity, date_diff('hour', lag(ts) OVER (PARTITION BY entity ORDER BY ts), ts) AS h FROM readings)
    SELECT entity, count(*) FILTER (WHERE h > 1.5) AS gaps, max(h)::DOUBLE AS max_interval, min(h)::DOUBLE AS min_interval, quantile_cont(h, 0.5)::DOUBLE AS median_interval FROM d WHERE h IS NOT NULL GROUP BY 1""",
    "max_interval min_interval median_interval",
)
def gap_statistics(t: Tables):
    """Gap count above 1.5 times the expected step; largest, smallest and median step."""
    return hl.gap_statistics(b.readings(t), b.BY, expected=1.0)


@query("duplicate_keys", "SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(t: Tables):
    """Keys that occur more than once."""
    return hl.duplicate_keys(t.events.withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz")), ["user_id", "hour"])


@query(
    "data_checks",
    f"""WITH {_DIRTY_SQL} SELECT count(*) FILTER (WHERE user_id IS NULL) AS null_key, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-25') AS future_time,
      count(*) FILTER (WHERE pm25 < 0) AS negative_value, count(*) FILTER (WHERE pm25 > 1500) AS impossible_value FROM dirty""",
)
def data_checks(t: Tables):
    """Null keys, future times and impossible values in one pass."""
    return hl.data_checks(
        dirty(t),
        {
            "null_key": F.col("user_id").isNull(),
            "future_time": F.col("ts") > F.lit("2024-01-25").cast("timestamp_ntz"),
            "negative_value": F.col("pm25") < 0,
            "impossible_value": F.col("pm25") > 1500,
        },
    )


@query(
    "file_duplicates",
    """WITH r AS (SELECT event_type AS file, user_id, date_trunc('day', ts) AS ts, floor(value / 50)::BIGINT AS v FROM events), f AS (SELECT file, user_id, ts, v, count(*) AS n FROM r GROUP BY ALL),
      k AS (SELECT file, user_id, ts, sum(n) AS n FROM f GROUP BY ALL)
    SELECT file, rows, full_duplicates, key_duplicates FROM (SELECT file, sum(n)::BIGINT AS rows, sum(n - 1)::BIGINT AS full_duplicates FROM f GROUP BY 1) JOIN
      (SELECT file, sum(n - 1)::BIGINT AS key_duplicates FROM k GROUP BY 1) USING (file)""",
)
def file_duplicates(t: Tables):
    """Repeated whole rows and repeated keys per file."""
    r = t.events.select(F.col("event_type").alias("file"), "user_id", F.to_date("ts").alias("ts"), F.floor(F.col("value") / 50).alias("v"))
    return hl.file_duplicates(r, "file", ["user_id", "ts"], ["user_id", "ts", "v"])


@query(
    "numeric_profile",
    f"""WITH {_DIRTY_SQL}, l AS (SELECT 'pm25' AS measure, pm25 AS v FROM dirty UNION ALL SELECT 'rh_pct', CASE WHEN event_id % 4 <> 0 THEN rh_pct END FROM dirty)
    SELECT measure, count(*) AS total, count(v) AS present, 100.0 * (count(*) - count(v)) / count(*) AS missing_pct, count(*) FILTER (WHERE v = 0) AS zeros, count(*) FILTER (WHERE v < 0) AS negatives,
      count(*) FILTER (WHERE v IN (-9999, 9999, -999)) AS sentinels, min(v) AS minimum, max(v) AS maximum, avg(v) AS mean, quantile_cont(v, 0.5) AS median FROM l GROUP BY 1""",
    "missing_pct minimum maximum mean median",
)
def numeric_profile(t: Tables):
    """Zeros, negatives, sentinels, missing share and exact median per column."""
    d = dirty(t).withColumn("rh_pct", F.when(F.col("event_id") % 4 != 0, F.col("rh_pct")))
    return hl.numeric_profile(d, ["pm25", "rh_pct"])


@query(
    "schema_differences",
    """WITH f AS (SELECT DISTINCT event_type AS file, 'c' || (user_id % 7) AS col FROM events WHERE NOT (event_type = 'click' AND user_id % 7 = 3) AND NOT (event_type <> 'view' AND user_id % 7 = 5)),
      r AS (SELECT col FROM f WHERE file = 'click'), o AS (SELECT DISTINCT file FROM f WHERE file <> 'click')
    SELECT file, col, 'added' AS change FROM f WHERE file <> 'click' AND col NOT IN (SELECT col FROM r)
    UNION ALL SELECT o.file, r.col, 'removed' FROM o, r WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.file = o.file AND f.col = r.col)""",
)
def schema_differences(t: Tables):
    """Columns added to or removed from each file against a reference file."""
    e = t.events.where("NOT (event_type = 'click' AND user_id % 7 = 3) AND NOT (event_type <> 'view' AND user_id % 7 = 5)")
    pairs = e.select(F.col("event_type").alias("file"), F.concat(F.lit("c"), (F.col("user_id") % 7).cast("string")).alias("col")).distinct()
    return hl.schema_differences(pairs, "file", "col", "click")


@query("entity_files", "SELECT user_id // 50 AS entity, count(DISTINCT event_type) AS files, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1")
def entity_files(t: Tables):
    """Files and time span per station."""
    return hl.entity_files(b.station_events(t), "entity", "event_type", "ts")


@query(
    "load_statistics",
    f"""WITH {_DIRTY_SQL}, r AS (SELECT event_type AS file, ts, {_PM} AS p, {_RH} AS h FROM dirty)
    SELECT file, count(*) AS raw_rows, count(*) FILTER (WHERE p = 'SENTINEL') + count(*) FILTER (WHERE h = 'SENTINEL') AS sentinel_replacements, count(*) FILTER (WHERE p LIKE 'OOB%') + count(*) FILTER (WHERE h LIKE 'OOB%') AS out_of_bounds_replacements,
      count(*) FILTER (WHERE p IS NOT NULL OR h IS NOT NULL) AS qc_flagged_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM r GROUP BY GROUPING SETS ((file), ())""",
)
def load_statistics(t: Tables):
    """Load counters per file and overall, counted from the data."""
    return hl.load_statistics(c.clean_cells(dirty(t), ["pm25", "rh_pct"]), "event_type", "ts").withColumnRenamed("event_type", "file")
