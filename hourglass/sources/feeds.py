"""Feed payloads to hourly rows, and stored rows to model inputs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.piecewise import US_CONCENTRATION_KNOTS, from_us_index, ppb_to_mass
from ..operators.cleaning import map_aliases

# Pollutant codes of the long feed, unit labels of the array feed.
FEED_CODES = {"PM2.5": "pm25", "PM10": "pm10", "NO2": "no2", "NH3": "nh3", "SO2": "so2", "CO": "co", "OZONE": "o3"}
FEED_UNITS = {
    "pm25": "MICROGRAMS_PER_CUBIC_METER",
    "pm10": "MICROGRAMS_PER_CUBIC_METER",
    "no2": "PARTS_PER_BILLION",
    "so2": "PARTS_PER_BILLION",
    "o3": "PARTS_PER_BILLION",
    "co": "PARTS_PER_BILLION",
}


def to_model_inputs(df: DataFrame, names: Mapping[str, str], ts: str, zone: str, *, absent: Sequence[str] = ()) -> DataFrame:
    """Rename, shift the UTC stamp to local wall-clock time and add columns the source lacks."""
    local = F.from_utc_timestamp(F.col(ts).cast("timestamp"), zone).cast("timestamp_ntz").alias("timestamp")
    return df.select(local, *[F.col(s).alias(n) for s, n in names.items()], *[F.lit(None).cast("double").alias(c) for c in absent])


def long_feed_rows(records: DataFrame, aliases: DataFrame, *, seq: str = "seq") -> DataFrame:
    """One record per station and pollutant to one row per station and hour, the last value per cell.

    ``records``: station, pollutant_id, pollutant_avg (text, may be ``NA``), last_update, and an arrival number. The
    stamp ends its hour, so the label is the floored stamp less one hour. Unknown stations and stamps are dropped; the
    pivot is one grouped pass of conditional aggregates over the known codes.
    """
    stamp = F.try_to_timestamp("last_update", F.lit("dd-MM-yyyy HH:mm:ss"))
    code = F.upper(F.trim("pollutant_id"))
    named = map_aliases(records, "station", aliases, out="station_name")
    rows = named.select(
        "station_name", (F.date_trunc("hour", stamp) - F.expr("INTERVAL 1 HOUR")).cast("timestamp_ntz").alias("hour"), code.alias("code"), F.col("pollutant_avg").try_cast("double").alias("v"), F.col(seq).alias("__seq")
    ).where(F.col("station_name").isNotNull() & F.col("hour").isNotNull() & F.col("code").isin(*FEED_CODES))
    cells = [F.max_by(F.when(F.col("code") == c, F.col("v")), F.when((F.col("code") == c) & F.col("v").isNotNull(), F.col("__seq"))).alias(name) for c, name in FEED_CODES.items()]
    return rows.groupBy("station_name", "hour").agg(*cells)


def index_feed_rows(payloads: DataFrame, payload: str, *, zone: str, keep: Sequence[str] = ()) -> DataFrame:
    """Nested feed ``{"time": {"iso"}, "iaqi": {code: {"v"}}}``: floored local hour, sub-indices converted back."""
    parsed = payloads.select(*keep, F.from_json(payload, "time struct<iso:string>, iaqi map<string,struct<v:double>>").alias("p"))
    local = F.from_utc_timestamp(F.to_timestamp("p.time.iso"), zone)
    value = lambda c: F.try_element_at(F.col("p.iaqi"), F.lit(c))["v"]
    return parsed.select(*keep, F.date_trunc("hour", local).cast("timestamp_ntz").alias("ts"), *[from_us_index(c, value(c)).alias(c) for c in US_CONCENTRATION_KNOTS])


def array_feed_rows(payloads: DataFrame, payload: str, *, zone: str, keep: Sequence[str] = (), units: Mapping[str, str] = FEED_UNITS) -> DataFrame:
    """Array feed with ``indexes`` and ``pollutants``: concentrations in stored units, both index scales kept apart.

    A pollutant whose unit label changed is not converted; its code is listed in ``unit_changed`` for quarantine.
    """
    schema = "dateTime string, indexes array<struct<code:string,aqi:double>>, pollutants array<struct<code:string,concentration:struct<value:double,units:string>>>"
    p = payloads.select(*keep, F.from_json(payload, schema).alias("p"))
    index = lambda code: F.try_element_at(F.filter("p.indexes", lambda x: x["code"] == code), F.lit(1))["aqi"]
    found = lambda code: F.try_element_at(F.filter("p.pollutants", lambda x: (x["code"] == code) & x["concentration"]["value"].isNotNull()), F.lit(1))["concentration"]
    good = {c: F.when(found(c)["units"] == u, found(c)["value"]) for c, u in units.items()}
    wrong = F.array_compact(F.array(*[F.when(found(c)["value"].isNotNull() & ~found(c)["units"].eqNullSafe(F.lit(u)), F.lit(c)) for c, u in units.items()]))
    local = F.from_utc_timestamp(F.to_timestamp("p.dateTime"), zone)
    return p.select(
        *keep, F.date_trunc("hour", local).cast("timestamp_ntz").alias("ts"), index("ind_cpcb").alias("national_index"), index("uaqi").alias("universal_index"),
        *[ppb_to_mass(c, v).alias(c) for c, v in good.items()], wrong.alias("unit_changed"),
    )


def require_units(rows: DataFrame) -> DataFrame:
    """Strict form: fail the job on the first row whose unit label changed."""
    message = F.concat(F.lit("unit label changed: "), F.array_join("unit_changed", ","))
    ok = F.when(F.size("unit_changed") > 0, F.raise_error(message)).otherwise(F.lit(True))
    return rows.where(ok.cast("boolean"))
