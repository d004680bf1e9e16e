"""The station data model bound to the shared test tables, in Spark and in SQL.

A station (entity) is a block of 50 users, so the number of stations grows with the data while each stays dense
enough for the trailing rules. Readings are hourly means of scaled event values, with measures missing by event type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.piecewise import CONCENTRATION_KNOTS, EIGHT_HOUR_POLLUTANTS, INDEX_KNOTS, POLLUTANTS
from ..operators.grid import HOUR, hourly_means, with_label
from ..operators.index import hourly_index, trailing_index
from .catalog import Tables

USERS_PER_STATION = 50
BY = ["entity"]
MEASURED = ("pm25", "pm10", "no2", "co", "o3")


def entity_of(users: str = "user_id") -> Column:
    return F.floor(F.col(users) / USERS_PER_STATION)


def station_events(t: Tables) -> DataFrame:
    return t.events.withColumn("entity", entity_of())


def readings(t: Tables) -> DataFrame:
    """Hourly readings per station: (entity, hour_no, pm25, pm10, no2, co, o3)."""
    v, kind = F.col("value"), F.col("event_type")
    measures = {
        "pm25": v * 2.5,
        "pm10": F.when(kind != "error", v * 4.5),
        "no2": F.when(kind.isin("click", "view", "purchase"), v / 3),
        "co": F.when(kind != "view", v / 100),
        "o3": F.when(kind != "signup", v / 4),
    }
    return hourly_means(station_events(t), BY, "ts", measures)


def readings_ts(t: Tables) -> DataFrame:
    """The same with an hour label ``ts``."""
    return with_label(readings(t))


def hourly(t: Tables) -> DataFrame:
    return hourly_index(readings(t), BY)


def index(t: Tables) -> DataFrame:
    """Gap-free grid with the measures, ``hourly_index`` and ``index_value``."""
    return trailing_index(hourly(t), BY)


def index_ts(t: Tables) -> DataFrame:
    return with_label(index(t))


def joined_readings(t: Tables) -> DataFrame:
    """Reading rows with their index (left join on the two keys): the analysis frame of the statistical reports."""
    idx = index(t).where(F.col("index_value").isNotNull()).select(*BY, HOUR, "index_value")
    return with_label(readings(t).join(idx, [*BY, HOUR], "left"))


def forecast_frame(t: Tables, horizon: int = 6) -> DataFrame:
    """Forecast stand-in: truth = index at t + h, persistence = index at t, model = half index, half its 24 h mean."""
    from ..operators.ordered import with_frames

    framed = with_frames(
        index(t),
        BY,
        HOUR,
        lambda f: {"y_true": f.at("index_value", horizon), "roll24": f.mean("index_value", 24, 12)},
        behind=24,
        ahead=horizon,
    )
    y = F.col("index_value")
    cols = [*BY, HOUR, y.alias("y_curr"), "y_true", (0.5 * y + 0.5 * F.col("roll24")).alias("y_pred")]
    return with_label(framed.select(*cols)).where("y_curr IS NOT NULL AND y_true IS NOT NULL AND y_pred IS NOT NULL")


# ---------------------------------------------------------------------------------------------------------------- SQL
READINGS_CTE = f"""readings AS (
  SELECT user_id // {USERS_PER_STATION} AS entity, date_trunc('hour', ts) AS ts,
         avg(value * 2.5) AS pm25,
         avg(value * 4.5) FILTER (WHERE event_type <> 'error') AS pm10,
         avg(value / 3) FILTER (WHERE event_type IN ('click', 'view', 'purchase')) AS no2,
         avg(value / 100) FILTER (WHERE event_type <> 'view') AS co,
         avg(value / 4) FILTER (WHERE event_type <> 'signup') AS o3
  FROM events GROUP BY ALL)"""


def interpolation_sql(x: str, xs, ys) -> str:
    """Piecewise-linear map of ``x`` as one CASE expression."""
    arms = [f"WHEN ({x}) IS NULL THEN NULL", f"WHEN ({x}) <= {xs[0]} THEN {ys[0]}::DOUBLE"]
    for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:], strict=False):
        arms.append(f"WHEN ({x}) < {x1} THEN {(y1 - y0) / (x1 - x0)!r}::DOUBLE * (({x}) - {float(x0)!r}::DOUBLE) + {float(y0)!r}::DOUBLE")
    return f"(CASE {' '.join(arms)} ELSE {ys[-1]}::DOUBLE END)"


def sub_index_sql(pollutant: str, x: str) -> str:
    return interpolation_sql(x, CONCENTRATION_KNOTS[pollutant], INDEX_KNOTS)


def _present(names) -> str:
    return " + ".join(f"(s_{p} IS NOT NULL)::INT" for p in names)


def index_ctes(source: str = "readings", prefix: str = "") -> str:
    """CTEs spine -> gas means -> sub-indices -> hourly -> trailing index, ending in ``<prefix>idx``."""
    plain = [p for p in MEASURED if p not in EIGHT_HOUR_POLLUTANTS]
    subs = ", ".join([f"{sub_index_sql(p, p)} AS s_{p}" for p in plain] + [f"{sub_index_sql(p, p + '_8h')} AS s_{p}" for p in EIGHT_HOUR_POLLUTANTS])
    gases = ", ".join(f"CASE WHEN count({p}) OVER w >= 6 THEN avg({p}) OVER w END AS {p}_8h" for p in EIGHT_HOUR_POLLUTANTS)
    ms = ", ".join(f"r.{p}" for p in MEASURED)
    p = prefix
    return f"""{p}spine AS (SELECT entity, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM {source} GROUP BY entity),
{p}grid AS (SELECT s.entity, s.ts, {ms} FROM {p}spine s LEFT JOIN {source} r ON r.entity = s.entity AND r.ts = s.ts),
{p}gas AS (SELECT *, {gases} FROM {p}grid WINDOW w AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
{p}subs AS (SELECT *, {subs} FROM {p}gas),
{p}hourly AS (SELECT *, CASE WHEN {_present(MEASURED)} >= 3 AND (s_pm25 IS NOT NULL OR s_pm10 IS NOT NULL)
    THEN greatest({", ".join("s_" + m for m in MEASURED)}) END AS hourly_index FROM {p}subs),
{p}idx AS (SELECT *, CASE WHEN count(hourly_index) OVER w >= 16 THEN avg(hourly_index) OVER w END AS index_value
    FROM {p}hourly WINDOW w AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))"""


INDEX_CTE = f"{READINGS_CTE}, {index_ctes()}"
JOINED_CTE = (
    f"{INDEX_CTE}, joined AS (SELECT r.*, i.index_value FROM readings r "
    "LEFT JOIN (SELECT entity, ts, index_value FROM idx WHERE index_value IS NOT NULL) i USING (entity, ts))"
)


def forecast_cte(horizon: int = 6, name: str = "fc") -> str:
    return f"""{name}_all AS (SELECT entity, ts, index_value AS y_curr, lead(index_value, {horizon}) OVER o AS y_true,
    CASE WHEN count(index_value) OVER w >= 12 THEN 0.5 * index_value + 0.5 * avg(index_value) OVER w END AS y_pred
  FROM idx WINDOW o AS (PARTITION BY entity ORDER BY ts),
    w AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
{name} AS (SELECT * FROM {name}_all WHERE y_curr IS NOT NULL AND y_true IS NOT NULL AND y_pred IS NOT NULL)"""


FORECAST_CTE = f"{INDEX_CTE}, {forecast_cte()}"
__all__ = [n for n in dir() if not n.startswith("_")]
POLLUTANT_ORDER = POLLUTANTS
