"""Read-side roll-ups and run verdicts: what is fresh, what was issued, what is missing and why."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.piecewise import STAGE_LABELS, STAGE_LOWER, category, stage_label
from .grid import HOUR

STALE_HOURS = 3.0
# Published products (target, horizon in hours).
PRODUCTS = (("aqi", 1), ("aqi", 6), ("aqi", 24), ("pm25", 1), ("pm25", 6))


def age_of(hour: Column, now_hour: Column) -> Column:
    """Hours from the end of the hour label to now."""
    return (now_hour - hour - 1).cast("double")


def entity_overview(stations: DataFrame, index: DataFrame, readings: DataFrame, entity: str, now_hour: Column, *, stale_after: float = STALE_HOURS) -> DataFrame:
    """Latest index, latest reading time and latest non-null PM2.5 per station, with a stale flag."""
    idx = index.groupBy(entity).agg(F.max(HOUR).alias("index_hour"), F.max_by("index_value", HOUR).alias("index_now"))
    seen = readings.groupBy(entity).agg(F.max(HOUR).alias("reading_hour"), F.max_by("pm25", F.when(F.col("pm25").isNotNull(), F.col(HOUR))).alias("pm25_now"))
    joined = stations.join(idx, entity, "left").join(seen, entity, "left")
    stale = F.coalesce(age_of(F.col("index_hour"), now_hour) > stale_after, F.lit(True))
    return joined.select(*stations.columns, "index_now", category("index_now").alias("category_now"), "pm25_now", "index_hour", "reading_hour", stale.alias("stale"))


def network_overview(overview: DataFrame) -> DataFrame:
    """Fresh stations, total, mean of the fresh index values and its category."""
    fresh = F.when(~F.col("stale"), F.col("index_now"))
    m = overview.agg(F.count(fresh).alias("stations_with_data"), F.count(F.lit(1)).alias("stations_total"), F.avg(fresh).alias("mean_index_now"))
    return m.withColumn("category_now", category("mean_index_now"))


def stage_counts(values: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Stations per stage for several value columns (output -> column); every stage is listed."""
    cells = F.array(*[F.struct(F.lit(o).alias("what"), stage_label(c).alias("stage")) for o, c in columns.items()])
    counted = values.select(F.inline(cells)).groupBy("stage").agg(*[F.count_if(F.col("what") == o).alias(o) for o in columns])
    names = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(n).alias("label"), F.lit(STAGE_LOWER[s]).alias("lowest")) for s, n in STAGE_LABELS.items()])
    every = values.sparkSession.range(1).select(F.inline(names))
    return every.join(counted, "stage", "left").select("stage", "label", "lowest", *[F.coalesce(o, F.lit(0)).alias(o) for o in columns])


def presence_grid(stations: DataFrame, readings: DataFrame, entity: str, now_hour: Column, *, slots: int = 24) -> DataFrame:
    """Whether each station reported in each of the last complete hours."""
    asked = stations.select(entity, F.explode(F.sequence(now_hour - slots, now_hour - 1)).alias(HOUR))
    have = readings.where((F.col(HOUR) >= now_hour - slots) & (F.col(HOUR) < now_hour)).select(entity, HOUR).distinct().withColumn("__has", F.lit(True))
    return asked.join(have, [entity, HOUR], "left").select(entity, HOUR, F.coalesce("__has", F.lit(False)).alias("present"))


def forecast_coverage(stations: DataFrame, forecasts: DataFrame, entity: str, now_hour: Column, *, hours: int = 24) -> DataFrame:
    """Distinct (issue, station) pairs of the last hours over the possible ones, at most 1."""
    possible = stations.agg(F.count(F.lit(1)) * hours).scalar()
    recent = forecasts.where(F.col(HOUR) > now_hour - hours)
    issued = recent.agg(F.count_distinct(F.struct(HOUR, entity)).alias("issued"))
    return issued.select("issued", F.least(F.lit(1.0), F.col("issued") / possible).alias("coverage"))


def source_lag(runs: DataFrame, started: str, ages: str) -> DataFrame:
    """Per day: median of the run medians, largest age and number of runs. ``ages`` is a map of station to age.

    A run's median comes from the sorted values of its own map; the day's runs are as many as the schedule allows.
    """
    values = F.array_sort(F.filter(F.map_values(ages), lambda v: v.isNotNull()))
    sized = runs.select(F.to_date(started).alias("day"), values.alias("v")).where(F.size("v") > 0)
    half = F.floor(F.size("v") / 2).cast("int")
    median = F.when(F.size("v") % 2 == 1, F.element_at("v", half + 1)).otherwise((F.element_at("v", half) + F.element_at("v", half + 1)) / 2)
    per_run = sized.select("day", median.alias("m"), F.element_at("v", -1).alias("x"))
    from .ranks import quantiles

    base = per_run.groupBy("day").agg(F.max("x").alias("max_hours"), F.count(F.lit(1)).alias("runs"))
    return base.join(quantiles(per_run, ["day"], "m", {"median_hours": 0.5}), "day")


def history_series(values: DataFrame, entity: str, who, value: str, now_hour: Column, *, hours: int = 72) -> DataFrame:
    """Recent series of one station in time order."""
    return values.where((F.col(entity) == who) & (F.col(HOUR) > now_hour - hours) & F.col(value).isNotNull()).select(HOUR, value).orderBy(HOUR)


def latest_measures(readings: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Non-null measures of the newest reading per station, one row each."""
    newest = readings.groupBy(*by).agg(F.max_by(F.struct(*columns), F.col(HOUR)).alias("r"))
    cells = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(f"r.{c}").alias("value")) for c in columns])
    return newest.select(*by, F.inline(cells)).where("value IS NOT NULL")


def skill_series(history: DataFrame, *, days: int = 30) -> DataFrame:
    """Series per product over the last ``days`` daily windows, and its last value; a series holds one row per day."""
    last = history.agg(F.max("window_end")).scalar()
    recent = history.where(F.col("window_end") > F.date_sub(last, days))
    point = F.struct("window_end", "skill_mae", "skill_vs_window_update")
    return recent.groupBy("target", "horizon").agg(
        F.sort_array(F.collect_list(point)).alias("series"), F.max_by("skill_mae", "window_end").alias("current_vs_persistence"), F.max_by("skill_vs_window_update", "window_end").alias("current_vs_window_update"),
        F.max_by("n", "window_end").alias("n"),
    )


def product_status(
    stations: DataFrame, forecasts: DataFrame, reasons: DataFrame, entity: str, now_hour: Column, *, lookback: int = 12, past_days: int = 30, stale_after: float = STALE_HOURS, products: Sequence[tuple[str, int]] = PRODUCTS
) -> DataFrame:
    """Status of every (station, product).

    ok when the newest forecast of the look-back belongs to the current run; otherwise unavailable, with the reason
    recorded for the product or the station. When no run is recent enough, all are unavailable and the newest forecast
    of the last ``past_days`` is shown as history. ``reasons`` holds (entity, target, horizon or NULL, reason).
    """
    keys = [entity, "target", "horizon"]
    wanted = F.array(*[F.struct(F.lit(a).alias("target"), F.lit(h).alias("horizon")) for a, h in products])
    asked = stations.select(entity, F.inline(wanted))
    recent = forecasts.where((F.col(HOUR) > now_hour - past_days * 24) & (F.col(HOUR) <= now_hour))
    newest = recent.groupBy(*keys).agg(F.max(HOUR).alias("issue"), F.max_by("y_hat", HOUR).alias("value"))
    current = forecasts.where((F.col(HOUR) > now_hour - lookback) & (F.col(HOUR) <= now_hour)).agg(F.max(HOUR)).scalar()
    of_product = reasons.where(F.col("horizon").isNotNull()).groupBy(*keys).agg(F.min("reason").alias("__r1"))
    of_station = reasons.where(F.col("horizon").isNull()).groupBy(entity).agg(F.min("reason").alias("__r2"))
    j = asked.join(newest, keys, "left").join(of_product, keys, "left").join(of_station, entity, "left").withColumn("__current", current)
    stale = F.col("__current").isNull() | (now_hour - F.col("__current") > stale_after + 1)
    ok = ~stale & F.coalesce(F.col("issue") == F.col("__current"), F.lit(False))
    why = F.when(stale, "the forecast job has not run recently").when(~ok, F.coalesce("__r1", "__r2", F.lit("no forecast for this hour")))
    return j.select(*keys, F.when(ok, "ok").otherwise("unavailable").alias("status"), why.alias("reason"), F.when(ok, F.col("value")).alias("value"), F.when(stale, F.col("issue")).alias("last_issue"))


# ----------------------------------------------------------------------------------------------------- run verdicts
def station_verdicts(
    rows: DataFrame, entity: str, *, required: Mapping[str, str], issue_hour: Column, stale_after: float = STALE_HOURS, min_history: int = 169, max_missing: float = 0.1
) -> DataFrame:
    """Whether each station may be forecast at the issue hour; the first failing rule gives the reason.

    ``rows`` has one row per station: latest_hour, current, history_rows, missing_share and, per required group, a
    boolean column that is true when the group has any value (``required``: group -> column).
    """
    age = (issue_hour - F.col("latest_hour")).cast("double")
    absent = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(c), F.lit(False)), F.lit(g)) for g, c in required.items()]))
    reason = (
        F.when(F.col("latest_hour").isNull(), "no readings")
        .when(age > stale_after, "stale")
        .when(F.col("current").isNull(), "current index missing")
        .when(F.size(absent) > 0, F.concat(F.lit("required group missing: "), F.element_at(absent, 1)))
        .when(F.col("history_rows") < min_history, "insufficient history")
        .when(F.col("missing_share") > max_missing, "core features missing")
    )
    return rows.select(entity, reason.isNull().alias("ok"), reason.alias("reason"))


def run_status(verdicts: DataFrame, *, dropped: bool | Column = False, data_reasons: Sequence[str] = ("stale", "insufficient history")) -> DataFrame:
    """success / partial / stale / failed of a run, and the stations skipped per reason."""
    lost = F.lit(dropped) if isinstance(dropped, bool) else dropped
    by_data = F.coalesce(F.col("reason").isin(*data_reasons), F.lit(False))
    m = verdicts.agg(F.count_if("ok").alias("done"), F.count(F.lit(1)).alias("stations"), F.count_if(by_data).alias("__data"), F.max(lost).alias("__lost"))
    status = F.when(F.col("done") == 0, F.when((F.col("stations") > 0) & (F.col("__data") == F.col("stations")), "stale").otherwise("failed"))
    status = status.when((F.col("done") == F.col("stations")) & ~F.coalesce("__lost", F.lit(False)), "success").otherwise("partial")
    return m.select("done", "stations", status.alias("status"))


def skip_reasons(verdicts: DataFrame) -> DataFrame:
    return verdicts.where(~F.col("ok")).groupBy("reason").agg(F.count(F.lit(1)).alias("stations"))


def freshness(readings: DataFrame, stations: DataFrame, entity: str, now_hour: Column, *, stale_after: float = STALE_HOURS) -> DataFrame:
    """Age and state of every known station; without a reading the age is NULL and the state stale."""
    newest = readings.groupBy(entity).agg(F.max(HOUR).alias("newest"))
    age = age_of(F.col("newest"), now_hour)
    return stations.select(entity).join(newest, entity, "left").select(entity, age.alias("age_hours"), F.coalesce(age <= stale_after, F.lit(False)).alias("fresh"))


def feed_status(fresh: DataFrame) -> DataFrame:
    """stale when no station is fresh, success when all are, else partial."""
    m = fresh.agg(F.count_if("fresh").alias("fresh_stations"), F.count(F.lit(1)).alias("stations"))
    return m.withColumn("status", F.when(F.col("fresh_stations") == 0, "stale").when(F.col("fresh_stations") == F.col("stations"), "success").otherwise("partial"))


def replay_coverage(forecasts: DataFrame, scored: DataFrame, possible: Column) -> DataFrame:
    """Forecast and scored station-hours per product against the possible ones."""
    done = scored.groupBy("target", "horizon").agg(F.count(F.lit(1)).alias("scored"))
    made = forecasts.groupBy("target", "horizon").agg(F.count(F.lit(1)).alias("forecast"))
    share = F.col("forecast") / F.col("station_hours")
    return made.withColumn("station_hours", possible).join(done, ["target", "horizon"], "left").select(
        "target", "horizon", "station_hours", "forecast", share.alias("forecast_share"), F.coalesce("scored", F.lit(0)).alias("scored")
    )


def assemble_forecasts(rows: DataFrame, entity: str, products: Sequence[tuple[str, int, str, str, str | None]]) -> tuple[DataFrame, DataFrame]:
    """Forecast rows per (station, product) and the dropped ones with a reason.

    ``products`` lists (target, horizon, forecast column, persistence column, rule column or None). A missing rule value
    falls back to persistence for the index; a row without a forecast or a persistence value is dropped.
    """
    none = F.lit(None).cast("double")
    cells = F.array(
        *[
            F.struct(
                F.lit(target).alias("target"), F.lit(h).alias("horizon"), F.col(hat).cast("double").alias("y_hat"), F.col(pers).cast("double").alias("y_persistence"),
                (F.coalesce(F.col(rule), F.col(pers)).cast("double") if rule else none).alias("y_window_update"),
            )
            for target, h, hat, pers, rule in products
        ]
    )
    long = rows.select(entity, HOUR, F.inline(cells)).withColumn("target_hour", F.col(HOUR) + F.col("horizon"))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    kept = long.where(finite("y_hat") & finite("y_persistence"))
    why = F.when(~finite("y_persistence"), F.concat(F.lit("no current "), "target", F.lit(" value at the issue hour"))).otherwise("the model returned no value")
    dropped = long.where(~(finite("y_hat") & finite("y_persistence"))).select(entity, HOUR, "target", "horizon", why.alias("reason"))
    return kept, dropped


def family_share(gains: DataFrame, feature: str, gain: str, family: Column) -> DataFrame:
    """Share of a gain table per feature family."""
    total = gains.agg(F.sum(gain)).scalar()
    return gains.groupBy(family.alias("family")).agg(F.count(F.lit(1)).alias("features"), (F.sum(gain) / total).alias("share"))
