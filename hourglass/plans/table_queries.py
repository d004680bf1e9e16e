"""Joins, upserts, immutable inserts, registries, set operations and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hours import hour_number
from ..operators import tables as tb
from ..operators.cleaning import latest_by_key
from ..operators.grid import HOUR, with_hour, with_label
from . import bindings as b
from .catalog import Tables, query


@query(
    "fact_dimension_join",
    "SELECT n_name, count(*) AS customers, avg(c_acctbal) AS mean_balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "mean_balance",
    digits=4,
)
def fact_dimension_join(t: Tables):
    """Inner join of facts with their dimension."""
    j = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"), F.avg("c_acctbal").alias("mean_balance"))


@query("reading_index_join", f"WITH {b.JOINED_CTE} SELECT entity, ts, pm25, index_value FROM joined", "pm25 index_value")
def reading_index_join(t: Tables):
    """Left join of readings and index on station and hour."""
    return b.joined_readings(t).select("entity", "ts", "pm25", "index_value")


@query("orphan_rows", "SELECT doc_id, source FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def orphan_rows(t: Tables):
    """Documents without a label."""
    return tb.orphans(t.documents.select("doc_id", "source"), t.labels, "doc_id")


@query(
    "offset_join",
    f"""WITH {b.READINGS_CTE}, l AS (SELECT unnest([-1, 0, 1]) AS lag)
    SELECT l.lag, a.entity, count(*) AS pairs, avg(a.pm25 - p.pm25) AS bias FROM readings a, l JOIN readings p ON p.entity = a.entity AND p.ts = a.ts + to_hours(l.lag) GROUP BY ALL""",
    "bias",
)
def offset_join(t: Tables):
    """Rows paired at hour S and S + lag for three lags."""
    r = b.readings(t)
    pairs = tb.offset_pairs(r, r, b.BY, (-1, 0, 1), ["pm25"])
    return pairs.groupBy("lag", "entity").agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.col("pm25_s") - F.col("pm25_p")).alias("bias"))


@query(
    "common_keys",
    f"WITH {b.READINGS_CTE} SELECT entity, ts FROM readings WHERE pm10 IS NOT NULL AND no2 IS NOT NULL AND o3 IS NOT NULL",
)
def common_keys(t: Tables):
    """Keys present in every scenario frame."""
    r = b.readings(t)
    frames = [r.where(f"{c} IS NOT NULL") for c in ("pm10", "no2", "o3")]
    return with_label(tb.common_keys(frames, ["entity", HOUR])).select("entity", "ts")


FORECASTS_CTE = f"""{b.INDEX_CTE}, {b.forecast_cte(6)}, fl AS (
  SELECT entity, ts, 'aqi' AS target, y_pred AS y_hat, y_curr AS y_persistence FROM fc UNION ALL
  SELECT entity, ts, 'pm25', y_pred / 2, y_curr / 2 FROM fc),
forecasts AS (SELECT *, ts + INTERVAL 6 HOUR AS target_time, hash FROM (SELECT *, entity * 10000000 + date_diff('hour', TIMESTAMP '1970-01-01', ts) * 2 + (target = 'pm25')::INT AS hash FROM fl))"""


def forecasts(t: Tables):
    """Stored forecasts: one row per station, issue hour and target."""
    f = b.forecast_frame(t, 6)
    rows = F.array(
        F.struct(F.lit("aqi").alias("target"), F.col("y_pred").alias("y_hat"), F.col("y_curr").alias("y_persistence")),
        F.struct(F.lit("pm25").alias("target"), (F.col("y_pred") / 2).alias("y_hat"), (F.col("y_curr") / 2).alias("y_persistence")),
    )
    long = f.select("entity", HOUR, F.inline(rows))
    fid = F.col("entity") * 10000000 + F.col(HOUR) * 2 + (F.col("target") == "pm25").cast("int")
    return long.select("entity", HOUR, "target", "y_hat", "y_persistence", fid.alias("forecast_id"), (F.col(HOUR) + 6).alias("target_hour"))


MATURED_CTE = f"""{FORECASTS_CTE}, due AS (SELECT * FROM forecasts WHERE hash % 5 <> 0 AND target_time + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-28 12:00:00'),
  matured AS (SELECT d.*, CASE WHEN target = 'aqi' THEN i.index_value ELSE r.pm25 END AS actual FROM due d
    LEFT JOIN idx i ON target = 'aqi' AND i.entity = d.entity AND i.ts = d.target_time LEFT JOIN readings r ON target = 'pm25' AND r.entity = d.entity AND r.ts = d.target_time)"""


def matured(t: Tables):
    f = forecasts(t)
    scored = f.where("forecast_id % 5 = 0").select("forecast_id")
    now = hour_number(F.lit("2024-01-28 12:00:00").cast("timestamp_ntz"))
    return tb.matured(f, scored, {"aqi": (b.index(t), "index_value"), "pm25": (b.readings(t), "pm25")}, now)


@query(
    "matured_forecasts",
    f"WITH {MATURED_CTE} SELECT hash AS forecast_id, entity, target, y_hat, y_persistence, actual FROM matured WHERE actual IS NOT NULL",
    "y_hat y_persistence actual",
)
def matured_forecasts(t: Tables):
    """Unscored forecasts past their target hour with the actual of their target."""
    return matured(t).select("forecast_id", "entity", "target", "y_hat", "y_persistence", "actual")


@query(
    "score_replay_join",
    f"""WITH {FORECASTS_CTE} SELECT f.target, count(*) AS forecasts, count(a.pm25) AS scored, avg(abs(y_hat - a.pm25)) AS mae FROM forecasts f
      LEFT JOIN readings a ON f.target = 'pm25' AND a.entity = f.entity AND a.ts = f.target_time GROUP BY 1""",
    "mae",
)
def score_replay_join(t: Tables):
    """Left join of forecasts with stored actuals; unmatched ones stay unscored."""
    actual = b.readings(t).select("entity", F.col(HOUR).alias("target_hour"), F.lit("pm25").alias("target"), "pm25")
    j = forecasts(t).join(actual, ["entity", "target_hour", "target"], "left")
    return j.groupBy("target").agg(F.count(F.lit(1)).alias("forecasts"), F.count("pm25").alias("scored"), F.avg(F.abs(F.col("y_hat") - F.col("pm25"))).alias("mae"))


@query(
    "as_of_reading",
    """SELECT e.event_id, p.ts AS as_of, p.value AS price FROM events e ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase') p
      ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type = 'view'""",
    "price",
)
def as_of_reading(t: Tables):
    """Newest purchase of the same user at or before every view."""
    e = t.events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    views = e.where("event_type = 'view'").select("event_id", "user_id", "us")
    buys = e.where("event_type = 'purchase'").select("user_id", F.col("us").alias("at"), F.col("value").alias("price"), "ts")
    out = tb.as_of(views, buys, ["user_id"], "us", "at", ["price", "ts"])
    return out.select("event_id", F.col("ts").alias("as_of"), "price")


@query(
    "latest_reading_per_entity",
    f"WITH {b.READINGS_CTE} SELECT entity, max(ts) AS ts, arg_max(pm25, ts) AS pm25 FROM readings WHERE ts <= TIMESTAMP '2024-01-20 06:00:00' GROUP BY 1",
    "pm25",
)
def latest_reading_per_entity(t: Tables):
    """Newest row per key up to an issue hour."""
    r = b.readings_ts(t).where(F.col("ts") <= F.lit("2024-01-20 06:00:00").cast("timestamp_ntz")).select("entity", "ts", "pm25")
    return latest_by_key(r, ["entity"], "ts")


@query(
    "history_window",
    f"""WITH {b.READINGS_CTE}, i AS (SELECT entity, ts AS issue FROM readings WHERE hour(ts) = 6)
    SELECT i.entity, i.issue, count(*) AS rows, avg(r.pm25) AS mean_pm25 FROM i JOIN readings r ON r.entity = i.entity AND r.ts > i.issue - INTERVAL 48 HOUR AND r.ts <= i.issue GROUP BY ALL""",
    "mean_pm25",
)
def history_window(t: Tables):
    """History of 48 hours for many issue hours at once."""
    r = b.readings(t)
    issues = with_label(r).where(F.hour("ts") == 6).select("entity", F.col(HOUR).alias("issue_hour"))
    h = tb.history_window(r.select("entity", HOUR, "pm25"), issues, ["entity"], 48)
    out = h.groupBy("entity", "issue_hour").agg(F.count(F.lit(1)).alias("rows"), F.avg("pm25").alias("mean_pm25"))
    return with_label(out.withColumnRenamed("issue_hour", HOUR), "issue").drop(HOUR)


@query(
    "grid_spine",
    f"""WITH {b.READINGS_CTE}, s AS (SELECT entity, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM readings GROUP BY 1)
    SELECT entity, count(*) AS hours, count(r.ts) AS present FROM s LEFT JOIN readings r USING (entity, ts) GROUP BY 1""",
)
def grid_spine(t: Tables):
    """Readings re-indexed to the full hourly grid."""
    from ..operators.grid import fill_grid

    g = fill_grid(b.readings(t).withColumn("has", F.lit(1)), b.BY)
    return g.groupBy("entity").agg(F.count(F.lit(1)).alias("hours"), F.count("has").alias("present"))


# ------------------------------------------------------------------------------------------------------------ upserts
_OLD = "old AS (SELECT o_orderkey, o_custkey, o_totalprice AS price, CASE WHEN o_orderkey % 3 = 0 THEN 'csv' ELSE 'live' END AS source FROM orders WHERE o_orderkey % 4 <> 0)"
_NEW = "new AS (SELECT o_orderkey, o_custkey, o_totalprice * 2 AS price, CASE WHEN o_orderkey % 2 = 0 THEN 'csv' ELSE 'live' END AS source FROM orders WHERE o_orderkey % 3 <> 1)"


def stored(t: Tables):
    tag = F.when(F.col("o_orderkey") % 3 == 0, "csv").otherwise("live")
    return t.orders.where("o_orderkey % 4 <> 0").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("price"), tag.alias("source"))


def arriving(t: Tables):
    tag = F.when(F.col("o_orderkey") % 2 == 0, "csv").otherwise("live")
    return t.orders.where("o_orderkey % 3 <> 1").select("o_orderkey", "o_custkey", (F.col("o_totalprice") * 2).alias("price"), tag.alias("source"))


_CASES = "SELECT o_orderkey, coalesce(old.o_custkey, new.o_custkey) AS o_custkey, CASE WHEN {take} THEN new.price ELSE old.price END AS price, CASE WHEN {take} THEN new.source ELSE old.source END AS source FROM old FULL JOIN new USING (o_orderkey)"


@query("upsert_latest", f"WITH {_OLD}, {_NEW} " + _CASES.format(take="new.price IS NOT NULL"), "price", digits=3)
def upsert_latest(t: Tables):
    """Last write wins."""
    return tb.upsert_latest(stored(t), arriving(t), ["o_orderkey"])


@query("upsert_same_source", f"WITH {_OLD}, {_NEW} " + _CASES.format(take="(old.price IS NULL OR (new.price IS NOT NULL AND old.source = new.source))"), "price", digits=3)
def upsert_same_source(t: Tables):
    """Only the same source may refresh a row."""
    return tb.upsert_same_source(stored(t), arriving(t), ["o_orderkey"])


@query("upsert_replaceable", f"WITH {_OLD}, {_NEW} " + _CASES.format(take="(old.price IS NULL OR (new.price IS NOT NULL AND old.source IN ('csv')))"), "price", digits=3)
def upsert_replaceable(t: Tables):
    """Only rows of listed sources may be refreshed."""
    return tb.upsert_replaceable(stored(t), arriving(t), ["o_orderkey"], ["csv"])


@query("insert_absent", f"WITH {_OLD}, {_NEW} SELECT new.* FROM new ANTI JOIN old USING (o_orderkey)", "price", digits=3)
def insert_absent(t: Tables):
    """Immutable facts: only unseen keys are inserted."""
    return tb.insert_absent(stored(t), arriving(t), ["o_orderkey"])


@query(
    "get_or_create_keys",
    "SELECT c_mktsegment, n_name, CASE WHEN n_regionkey < 2 THEN 'known' ELSE 'created' END AS origin FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL",
)
def get_or_create_keys(t: Tables):
    """Registry of (segment, nation) pairs extended by the unseen ones."""
    j = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    pairs = j.select("c_mktsegment", "n_name", "n_regionkey").distinct()
    known = pairs.where("n_regionkey < 2").select("c_mktsegment", "n_name", F.lit(1).cast("long").alias("id"))
    out = tb.get_or_create(known, j, ["c_mktsegment", "n_name"], "id")
    return out.select("c_mktsegment", "n_name", F.when(F.col("id") == 1, "known").otherwise("created").alias("origin"))


@query(
    "backfill_summary",
    f"""WITH {b.READINGS_CTE}, u AS (SELECT entity, ts, pm25, 'csv' AS source FROM readings WHERE ts < TIMESTAMP '2024-01-15' UNION ALL SELECT entity, ts, pm10, 'feed' FROM readings WHERE ts >= TIMESTAMP '2024-01-13')
    SELECT source, count(*) AS rows, count(DISTINCT entity) AS entities, min(ts) AS first_ts, max(ts) AS last_ts FROM u GROUP BY 1""",
)
def backfill_summary(t: Tables):
    """Tagged union of sources and its summary per source."""
    from ..sources.backfill import summarize_sources, tag_sources

    r = b.readings_ts(t)
    parts = {"csv": r.where("ts < TIMESTAMP_NTZ '2024-01-15 00:00:00'").select("entity", "ts", "pm25"), "feed": r.where("ts >= TIMESTAMP_NTZ '2024-01-13 00:00:00'").select("entity", "ts", "pm10")}
    return summarize_sources(tag_sources(parts), "entity", "ts")


# ------------------------------------------------------------------------------------------------------- sets, limits
@query("ordered_top_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", "o_totalprice", digits=3)
def ordered_top_rows(t: Tables):
    """Top report: total order with ties broken, then a limit (per-task heads are merged, not a full sort)."""
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25)


@query(
    "top_per_group",
    "SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 10",
    "o_totalprice",
    digits=3,
)
def top_per_group(t: Tables):
    """Ten largest orders per priority."""
    o = t.orders.select("o_orderpriority", "o_orderkey", "o_totalprice")
    return tb.top_k(o, ["o_orderpriority"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 10)


@query("custom_order", "SELECT o_orderpriority, count(*) AS n, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 9 END AS position FROM orders GROUP BY 1 ORDER BY position, 1")
def custom_order(t: Tables):
    """Rows in a hand-given order."""
    p = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(9)
    return t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).withColumn("position", p).orderBy("position", "o_orderpriority")


@query(
    "stratified_hour_sample",
    f"""WITH {b.READINGS_CTE}, h AS (SELECT DISTINCT entity, ts, (epoch(ts) // 3600)::BIGINT AS hour_no FROM readings),
      r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY md5('7:' || hour_no), hour_no) AS k, min(ts) OVER (PARTITION BY entity) AS lo, max(ts) OVER (PARTITION BY entity) AS hi FROM h)
    SELECT entity, ts FROM r WHERE k <= 20 OR ts = lo OR ts = hi""",
)
def stratified_hour_sample(t: Tables):
    """Repeatable sample of issue hours per station: digest order plus both edges."""
    return with_label(tb.stratified_hours(b.readings(t), "entity", HOUR, 20, seed=7)).select("entity", "ts")


@query("union_of_sources", "SELECT 'c' AS kind, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 's', s_nationkey, s_acctbal, NULL FROM supplier", "balance", digits=3)
def union_of_sources(t: Tables):
    """UNION ALL by name with a column one side lacks."""
    c = t.customer.select(F.lit("c").alias("kind"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = t.supplier.select(F.lit("s").alias("kind"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s, allowMissingColumns=True)


@query("key_intersection", "SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW'")
def key_intersection(t: Tables):
    """Keys that pass in both sets."""
    pick = lambda p: t.orders.where(F.col("o_orderpriority") == p).select("o_custkey")
    return pick("1-URGENT").intersect(pick("5-LOW"))


@query("row_difference", "SELECT l_returnflag, l_linenumber FROM lineitem EXCEPT ALL SELECT l_returnflag, l_linenumber FROM lineitem WHERE l_quantity > 10")
def row_difference(t: Tables):
    """Multiset difference."""
    l = t.lineitem
    return tb.difference(l.select("l_returnflag", "l_linenumber"), l.where("l_quantity > 10").select("l_returnflag", "l_linenumber"))


__all__ = ["with_hour"]
