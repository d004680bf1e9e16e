"""Index, category, unit and calendar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal, piecewise as pw, sql_functions
from ..functions.hours import age_hours
from ..operators import index as ix
from ..operators.grid import with_label
from . import bindings as b
from .catalog import Tables, query

_SUBS = {p: f"s_{p}" for p in b.MEASURED}


@query(
    "sub_indices",
    f"WITH {b.READINGS_CTE} SELECT entity, ts, {', '.join(f'{b.sub_index_sql(p, p)} AS s_{p}' for p in b.MEASURED)} FROM readings",
    " ".join(_SUBS.values()),
)
def sub_indices(t: Tables):
    """Piecewise sub-index of every measured concentration."""
    return b.readings_ts(t).select("entity", "ts", *[pw.sub_index(p, p).alias(n) for p, n in _SUBS.items()])


_US = ("pm25", "pm10", "no2", "co", "o3")


def _us_sql(p: str, x: str) -> str:
    f = pw._us_unit_factor(p)
    return f"least(floor({b.interpolation_sql(f'{x} * {f!r}', pw.US_CONCENTRATION_KNOTS[p], pw.US_INDEX_KNOTS)} + 0.5), 500)"


def _us_back_sql(p: str, i: str) -> str:
    return f"({b.interpolation_sql(i, pw.US_INDEX_KNOTS, pw.US_CONCENTRATION_KNOTS[p])} / {pw._us_unit_factor(p)!r})"


@query(
    "us_index_round_trip",
    f"""WITH {b.READINGS_CTE}, r9 AS (SELECT {', '.join(f'round({p}, 9) AS {p}' for p in _US)} FROM readings), long AS ({' UNION ALL '.join(f"SELECT '{p}' AS pollutant, {p} AS x, {_us_sql(p, p)} AS us FROM r9" for p in _US)}),
    back AS (SELECT *, CASE pollutant {' '.join(f"WHEN '{p}' THEN {_us_back_sql(p, 'us')}" for p in _US)} END AS got FROM long WHERE x IS NOT NULL)
    SELECT pollutant, count(*) AS n, avg(us) AS mean_us_index, avg(x) AS mean_true, avg(abs(got - x)) AS mae,
           100 * avg(abs(got - x)) / avg(x) AS mae_pct_of_mean, avg(got - x) AS bias FROM back GROUP BY pollutant""",
    "mean_us_index mean_true mae mae_pct_of_mean bias",
)
def us_index_round_trip(t: Tables):
    """Concentration -> integer US index -> concentration, with the input error it causes.

    Means are cut to nine decimals first, so a value on a rounding edge does not depend on the order of summation.
    """
    r = b.readings(t).select(*[F.round(p, 9).alias(p) for p in _US])
    cells = F.array(
        *[
            F.struct(
                F.lit(p).alias("pollutant"),
                F.col(p).alias("x"),
                pw.to_us_index(p, p).alias("us"),
                pw.us_round_trip(p, p).alias("got"),
            )
            for p in _US
        ]
    )
    long = r.select(F.inline(cells)).where("x IS NOT NULL")
    err = F.col("got") - F.col("x")
    return long.groupBy("pollutant").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("us").alias("mean_us_index"),
        F.avg("x").alias("mean_true"),
        F.avg(F.abs(err)).alias("mae"),
        (100 * F.avg(F.abs(err)) / F.avg("x")).alias("mae_pct_of_mean"),
        F.avg(err).alias("bias"),
    )


@query("hourly_index", f"WITH {b.INDEX_CTE} SELECT entity, ts, hourly_index FROM hourly", "hourly_index")
def hourly_index(t: Tables):
    """Maximum sub-index per grid hour with the three-pollutant rule."""
    return with_label(b.hourly(t)).select("entity", "ts", "hourly_index")


@query("trailing_index", f"WITH {b.INDEX_CTE} SELECT entity, ts, index_value FROM idx", "index_value")
def trailing_index(t: Tables):
    """24-hour mean of the hourly index on the gap-free grid."""
    return b.index_ts(t).select("entity", "ts", "index_value")


_MEANS = ", ".join(
    f"CASE WHEN count({p}) OVER w{n} >= {k} THEN avg({p}) OVER w{n} END AS m_{p}"
    for p in b.MEASURED
    for n, k in [((8, 6) if p in pw.EIGHT_HOUR_POLLUTANTS else (24, 16))]
)


@query(
    "concentration_mean_index",
    f"""WITH {b.INDEX_CTE}, means AS (SELECT entity, ts, {_MEANS} FROM grid
      WINDOW w8 AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN 7 PRECEDING AND CURRENT ROW),
             w24 AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
    ms AS (SELECT entity, ts, {', '.join(f"{b.sub_index_sql(p, 'm_' + p)} AS s_{p}" for p in b.MEASURED)} FROM means)
    SELECT entity, ts, CASE WHEN {b._present(b.MEASURED)} >= 3 AND (s_pm25 IS NOT NULL OR s_pm10 IS NOT NULL)
      THEN greatest({', '.join(_SUBS.values())}) END AS index_value FROM ms""",
    "index_value",
)
def concentration_mean_index(t: Tables):
    """Alternative convention: average the concentrations first."""
    return with_label(ix.index_of_means(b.readings(t), b.BY)).select("entity", "ts", "index_value")


@query(
    "nowcast",
    f"""WITH {b.INDEX_CTE}, rng AS (SELECT entity, ts, min(pm25) OVER w AS lo, max(pm25) OVER w AS hi FROM grid
        WINDOW w AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
    pairs AS (SELECT a.entity, a.ts, CASE WHEN a.hi > 0 THEN greatest(0.5, least(a.lo / a.hi, 1)) ELSE 1 END AS w,
        g.pm25 AS x, date_diff('hour', g.ts, a.ts) AS age FROM rng a JOIN grid g ON g.entity = a.entity
        AND g.ts BETWEEN a.ts - INTERVAL 11 HOUR AND a.ts)
    SELECT entity, ts, CASE WHEN count(x) FILTER (WHERE age < 3) >= 2 THEN sum(x * power(w, age)) / sum(power(w, age)) FILTER (WHERE x IS NOT NULL) END AS nowcast
    FROM pairs GROUP BY entity, ts""",
    "nowcast",
)
def nowcast(t: Tables):
    """Stability-weighted 12-hour mean of one pollutant."""
    from ..operators.grid import fill_grid

    grid = fill_grid(b.readings(t), b.BY)
    return with_label(ix.nowcast(grid, b.BY, "pm25", "nowcast")).select("entity", "ts", "nowcast")


_CAT = "CASE WHEN v <= 50 THEN 'Good' WHEN v <= 100 THEN 'Satisfactory' WHEN v <= 200 THEN 'Moderate' WHEN v <= 300 THEN 'Poor' WHEN v <= 400 THEN 'Very Poor' ELSE 'Severe' END"


@query(
    "index_categories",
    f"""WITH {b.INDEX_CTE}, v AS (SELECT ts, hourly_index AS v FROM hourly WHERE hourly_index IS NOT NULL)
    SELECT ts::DATE AS day, {_CAT} AS category, (v >= 51)::INT + (v >= 101)::INT + (v >= 201)::INT + (v >= 301)::INT + (v >= 401)::INT AS ordinal_class,
      CASE WHEN v > 450 THEN 4 WHEN v >= 401 THEN 3 WHEN v >= 301 THEN 2 WHEN v >= 201 THEN 1 ELSE 0 END AS stage_number,
      CASE WHEN floor(v) >= 451 THEN 'IV' WHEN floor(v) >= 401 THEN 'III' WHEN floor(v) >= 301 THEN 'II' WHEN floor(v) >= 201 THEN 'I' END AS stage_label,
      count(*) AS hours FROM v GROUP BY ALL""",
)
def index_categories(t: Tables):
    """Hours per day in each category, ordinal class and stage."""
    v = with_label(b.hourly(t)).where("hourly_index IS NOT NULL").withColumnRenamed("hourly_index", "v")
    return v.groupBy(
        F.to_date("ts").alias("day"),
        pw.category("v").alias("category"),
        pw.ordinal_class("v").alias("ordinal_class"),
        pw.stage_number("v").alias("stage_number"),
        pw.stage_label("v").alias("stage_label"),
    ).agg(F.count(F.lit(1)).alias("hours"))


@query(
    "sql_index_functions",
    f"""WITH {b.INDEX_CTE}, v AS (SELECT ts::DATE AS day, {b.sub_index_sql('pm25', 'pm25')} AS v FROM readings WHERE pm25 IS NOT NULL)
    SELECT day, {_CAT} AS category, (v >= 51)::INT + (v >= 101)::INT + (v >= 201)::INT + (v >= 301)::INT + (v >= 401)::INT AS ordinal_class,
      CASE WHEN v > 450 THEN 4 WHEN v >= 401 THEN 3 WHEN v >= 301 THEN 2 WHEN v >= 201 THEN 1 ELSE 0 END AS stage_number,
      CASE WHEN floor(v) >= 451 THEN 'IV' WHEN floor(v) >= 401 THEN 'III' WHEN floor(v) >= 301 THEN 'II' WHEN floor(v) >= 201 THEN 'I' END AS stage_label,
      count(*) AS hours FROM v GROUP BY ALL""",
)
def sql_index_functions(t: Tables):
    """Sub-index, category, class and stage of every reading through the functions that SQL text can call."""
    sql_functions.register(t.spark)
    v = b.readings_ts(t).where("pm25 IS NOT NULL").selectExpr("to_date(ts) AS day", "sub_index_pm25(pm25) AS v")
    return v.selectExpr("day", "index_category(v) AS category", "index_class(v) AS ordinal_class", "stage_number(v) AS stage_number", "stage_label(v) AS stage_label").groupBy("day", "category", "ordinal_class", "stage_number", "stage_label").agg(F.count(F.lit(1)).alias("hours"))


@query(
    "daily_category_hours",
    f"""WITH {b.INDEX_CTE}, v AS (SELECT ts, index_value AS v FROM idx WHERE index_value IS NOT NULL)
    SELECT ts::DATE AS day, {_CAT} AS category, count(*) AS hours, avg(v) AS mean_index, max(v) AS max_index FROM v GROUP BY ALL""",
    "mean_index max_index",
)
def daily_category_hours(t: Tables):
    """Flagship: readings -> hourly index -> 24 h index -> hours per category and day."""
    v = b.index_ts(t).where("index_value IS NOT NULL")
    return v.groupBy(F.to_date("ts").alias("day"), pw.category("index_value").alias("category")).agg(
        F.count(F.lit(1)).alias("hours"), F.avg("index_value").alias("mean_index"), F.max("index_value").alias("max_index")
    )


@query(
    "unit_conversion",
    f"""SELECT user_id // 50 AS entity, {', '.join(f"avg(value * {m} / 24.45{' / 1000' if p == 'co' else ''}) AS {p}_mass" for p, m in pw.MOLAR_MASS.items())},
        avg(value) AS pm25_mass FROM events GROUP BY 1""",
    "no2_mass so2_mass o3_mass co_mass pm25_mass",
)
def unit_conversion(t: Tables):
    """Gas volumes in ppb as mass concentrations."""
    e = b.station_events(t)
    return e.groupBy("entity").agg(*[F.avg(pw.ppb_to_mass(p, "value")).alias(f"{p}_mass") for p in (*pw.MOLAR_MASS, "pm25")])


_WAVES = "sin_hour cos_hour sin_dow cos_dow sin_month cos_month sin_doy cos_doy"


@query(
    "calendar_fields",
    """WITH d AS (SELECT date_trunc('hour', ts) AS ts, count(*) AS n FROM events GROUP BY 1)
    SELECT ts, n, hour(ts)::INT AS hour, (isodow(ts) - 1)::INT AS day_of_week, month(ts)::INT AS month, dayofyear(ts)::INT AS day_of_year,
      (isodow(ts) >= 6)::INT AS is_weekend, sin(2 * pi() * hour(ts) / 24) AS sin_hour, cos(2 * pi() * hour(ts) / 24) AS cos_hour,
      sin(2 * pi() * (isodow(ts) - 1) / 7) AS sin_dow, cos(2 * pi() * (isodow(ts) - 1) / 7) AS cos_dow,
      sin(2 * pi() * (month(ts) - 1) / 12) AS sin_month, cos(2 * pi() * (month(ts) - 1) / 12) AS cos_month,
      sin(2 * pi() * (dayofyear(ts) - 1) / 365.25) AS sin_doy, cos(2 * pi() * (dayofyear(ts) - 1) / 365.25) AS cos_doy,
      (month(ts) IN (12, 1, 2))::INT AS is_winter, (month(ts) IN (3, 4, 5))::INT AS is_summer,
      (month(ts) IN (6, 7, 8, 9))::INT AS is_monsoon, (month(ts) IN (10, 11))::INT AS is_post_monsoon FROM d""",
    _WAVES,
)
def calendar_fields(t: Tables):
    """Calendar, cyclical and season fields of every hour with events."""
    d = t.events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.count(F.lit(1)).alias("n"))
    return d.select("ts", "n", *[c.alias(n) for n, c in cal.calendar_columns("ts").items()])


@query(
    "season_names",
    """SELECT CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'Winter' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'Summer'
        WHEN month(o_orderdate) IN (6, 7, 8, 9) THEN 'Monsoon' ELSE 'Post-Monsoon' END AS season,
      CASE WHEN month(o_orderdate) IN (11, 12, 1, 2) THEN 'Winter' WHEN month(o_orderdate) IN (3, 4, 5, 6) THEN 'Summer'
        WHEN month(o_orderdate) IN (7, 8, 9) THEN 'Monsoon' ELSE 'Post-Monsoon' END AS chart_season,
      count(*) AS n, avg(o_totalprice) AS mean_price FROM orders GROUP BY ALL""",
    "mean_price",
    digits=4,
)
def season_names(t: Tables):
    """Both month-to-season splits over the order calendar."""
    return t.orders.groupBy(
        cal.season("o_orderdate").alias("season"), cal.season("o_orderdate", cal.CHART_SEASONS).alias("chart_season")
    ).agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean_price"))


_REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


@query(
    "entity_one_hot",
    f"""SELECT n_nationkey, r_name, {', '.join(f"(r_name = '{r}')::DOUBLE AS station_{r.replace(' ', '_').lower()}" for r in _REGIONS)}
    FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def entity_one_hot(t: Tables):
    """One 0/1 column per entity name, spaces replaced."""
    from ..operators.cleaning import one_hot

    # 5 regions, 25 nations in every scale: a fixed-size dimension
    named = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    return one_hot(named, "r_name", _REGIONS, prefix="station_", lower=True)


@query(
    "freshness_age",
    f"""WITH {b.READINGS_CTE}, now AS (SELECT max(ts) + INTERVAL 3 HOUR AS now FROM events)
    SELECT entity, max(r.ts) AS newest, date_diff('second', max(r.ts), min(now)) / 3600.0 - 1 AS age_hours FROM readings r, now GROUP BY entity""",
    "age_hours",
    digits=3,
)
def freshness_age(t: Tables):
    """Age of the newest reading per station, from the end of its hour, three hours after the last event."""
    newest_event = t.events.agg(F.max("ts").alias("m")).scalar()
    now = F.date_trunc("second", newest_event + F.expr("INTERVAL 3 HOURS")).cast("timestamp_ntz")
    newest = b.readings_ts(t).groupBy("entity").agg(F.max("ts").alias("newest"))
    return newest.select("entity", "newest", age_hours("newest", now).alias("age_hours"))


@query(
    "scaled_daily_profile",
    f"""WITH {b.READINGS_CTE}, p AS (SELECT entity, hour(ts)::INT AS hour, avg(pm25) AS m FROM readings GROUP BY ALL)
    SELECT entity, hour, (m - min(m) OVER w) / (max(m) OVER w - min(m) OVER w) AS scaled FROM p WINDOW w AS (PARTITION BY entity)""",
    "scaled",
)
def scaled_daily_profile(t: Tables):
    """Hour-of-day profile scaled to 0..1 per station (24 rows per group)."""
    from ..operators.profiles import min_max_scale

    p = b.readings_ts(t).groupBy("entity", F.hour("ts").alias("hour")).agg(F.avg("pm25").alias("m"))
    return min_max_scale(p, ["entity"], "m", "scaled").select("entity", "hour", "scaled")


_WU = " ".join(f"window_update_{h}h" for h in (1, 6, 24))


def _wu_sql(h: int) -> str:
    keep = 24 - h
    if keep == 0:
        return f"CASE WHEN hourly_index IS NOT NULL THEN hourly_index END AS window_update_{h}h"
    frame = f"OVER (PARTITION BY entity ORDER BY ts ROWS BETWEEN {keep - 1} PRECEDING AND CURRENT ROW)"
    return f"""CASE WHEN hourly_index IS NOT NULL AND count(hourly_index) {frame} + {h} >= 16
      THEN (coalesce(sum(hourly_index) {frame}, 0) + {h} * hourly_index) / (count(hourly_index) {frame} + {h}) END AS window_update_{h}h"""


WU_CTE = f"wu AS (SELECT entity, ts, {', '.join(_wu_sql(h) for h in (1, 6, 24))} FROM hourly)"


@query("window_update_rule", f"WITH {b.INDEX_CTE}, {WU_CTE} SELECT * FROM wu", _WU)
def window_update_rule(t: Tables):
    """Rule forecasts at 1, 6 and 24 hours from the hours that stay in the window."""
    return with_label(ix.window_update(b.hourly(t), b.BY)).select("entity", "ts", *_WU.split())


@query(
    "window_update_references",
    f"""WITH {b.INDEX_CTE}, {WU_CTE}, st AS (SELECT entity, ts, index_value + CASE WHEN hour(ts) = 7 THEN 1 ELSE 0 END AS stored_index, index_value AS rebuilt
      FROM idx WHERE index_value IS NOT NULL),
    r AS (SELECT st.entity, st.ts, stored_index, window_update_1h, window_update_6h, window_update_24h,
      CASE WHEN window_update_1h IS NULL THEN 'no valid current hourly index or too few valid hours'
           WHEN rebuilt IS NULL OR abs(rebuilt - stored_index) > 0.01 THEN 'rebuilt index disagrees with the stored index' END AS reason
      FROM st JOIN wu USING (entity, ts))
    SELECT entity, ts, stored_index, CASE WHEN reason IS NULL THEN window_update_1h END AS window_update_1h, CASE WHEN reason IS NULL THEN window_update_6h END AS window_update_6h,
      CASE WHEN reason IS NULL THEN window_update_24h END AS window_update_24h, reason FROM r""",
    "stored_index " + _WU,
)
def window_update_references(t: Tables):
    """References per issue hour with a consistency check; stored values at hour 7 are made to disagree."""
    idx = b.index_ts(t).where("index_value IS NOT NULL")
    bump = F.when(F.hour("ts") == 7, 1.0).otherwise(0.0)
    stored = idx.select("entity", "hour_no", (F.col("index_value") + bump).alias("stored_index"))
    return with_label(ix.window_update_references(b.hourly(t), stored, b.BY)).drop("hour_no")
