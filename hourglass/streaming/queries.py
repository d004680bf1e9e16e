"""Structured Streaming forms: hours from slots, sliding index, episodes, freshness, maturing forecasts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

LOOKBACK = "192 hours"


def stream_table(spark: SparkSession, path: str, schema, ts: str, *, watermark: str | None = LOOKBACK, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files as a stream; the event time is cast to an instant because watermarks need one."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    stream = reader.parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))
    return stream.withWatermark(ts, watermark) if watermark else stream


def slot_hours(stream: DataFrame, by: Sequence[str], ts: str, value: str, arrival: str, out: str, *, offset_minutes: int = 0, factor: float = 1.0) -> DataFrame:
    """Hours from quarter-hour slots: each slot keeps its last delivery, an hour needs all four.

    One aggregation holds the four slots of an hour, so a late or repeated slot simply updates its cell.
    """
    start = F.window(ts, "1 hour", startTime=f"{offset_minutes % 60} minutes")
    slot = F.floor(F.pmod(F.minute(ts) - F.lit(offset_minutes), F.lit(60)) / 15)
    last = [F.max_by(F.when(slot == k, F.col(value)), F.when(slot == k, F.col(arrival))).alias(f"__s{k}") for k in range(4)]
    cells = [F.col(f"__s{k}") for k in range(4)]
    total = cells[0] + cells[1] + cells[2] + cells[3]
    label = F.col("window.start") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(offset_minutes), F.lit(0))
    return stream.groupBy(*by, start).agg(*last).select(*by, label.alias("hour"), (total / 4 * F.lit(factor)).alias(out))


def sliding_index(hours: DataFrame, by: Sequence[str], ts: str, value: str, out: str, *, width: int = 24, min_valid: int = 16) -> DataFrame:
    """Trailing mean at every hour label from hour values: 24-hour windows sliding by one hour, labelled by their last hour."""
    w = F.window(ts, f"{width} hours", "1 hour")
    grouped = hours.groupBy(*by, w).agg(F.count(value).alias("__n"), F.avg(value).alias("__m"))
    label = F.col("window.end") - F.expr("INTERVAL 1 HOUR")
    return grouped.where(F.col("__n") >= min_valid).select(*by, label.alias("ts"), F.col("__m").alias(out))


def episode_sessions(hours: DataFrame, by: Sequence[str], ts: str, value: str, threshold: float, *, bridge_hours: int = 3) -> DataFrame:
    """Episodes as session windows over exceeding hours: hours at most ``bridge + 1`` apart belong together."""
    high = hours.where(F.col(value) >= threshold)
    grouped = high.groupBy(*by, F.session_window(ts, f"{bridge_hours + 1} hours 1 second")).agg(F.min(ts).alias("start_time"), F.max(ts).alias("end_time"), F.max(value).alias("peak"), F.count(F.lit(1)).alias("hours_above"))
    return grouped.drop("session_window")


def newest_hours(stream: DataFrame, by: Sequence[str], ts: str) -> DataFrame:
    """Newest stamp per entity; the age is taken when the result is read."""
    return stream.groupBy(*by).agg(F.max(ts).alias("newest"))


def matured_stream(forecasts: DataFrame, actuals: DataFrame, by: Sequence[str], *, wait: str = "1 hour") -> DataFrame:
    """Forecasts joined with the actual of their target hour as either side arrives.

    ``forecasts`` carries target_time, ``actuals`` actual_time, both with watermarks; the time bound lets old state go.
    """
    renamed = actuals.withColumnsRenamed({c: f"__{c}" for c in by})
    on = F.col("target_time") == F.col("actual_time")
    for c in by:
        on = on & (F.col(c) == F.col(f"__{c}"))
    bound = (F.col("actual_time") >= F.col("target_time")) & (F.col("actual_time") <= F.col("target_time") + F.expr(f"INTERVAL {wait}"))
    return forecasts.join(renamed, on & bound, "inner").drop(*[f"__{c}" for c in by])


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], folder: str, *, mode: str = "update") -> None:
    """Drive a stream over everything that has arrived, handing each micro-batch to an idempotent sink."""
    query: StreamingQuery = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def batch_sink(folder: str) -> Callable[[DataFrame, int], None]:
    """Each micro-batch overwrites its own folder, so a repeated batch changes nothing."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/data/batch_id={batch_id}")

    return write


def read_latest(spark: SparkSession, folder: str, keys: Sequence[str]) -> DataFrame:
    """Result of an update-mode stream: the newest emission per key."""
    from ..operators.cleaning import dedupe

    return dedupe(spark.read.parquet(f"{folder}/data"), keys, ["batch_id"]).drop("batch_id")


def newest_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Result of a complete-mode stream: its newest emission holds everything, open groups too."""
    rows = spark.read.parquet(f"{folder}/data")
    return rows.where(F.col("batch_id") == rows.agg(F.max("batch_id")).scalar()).drop("batch_id")


def append_result(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/data").drop("batch_id")


