"""Data health: missingness, gaps, coverage, duplicates, file and schema reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hours import hour_label
from ..functions.quality import SENTINELS
from .grid import HOUR
from .ordered import previous_row
from .ranks import quantiles


def flag_reasons(df: DataFrame, flags: str, by: Sequence[str] = ()) -> DataFrame:
    """Flag maps exploded and counted by column and reason, over all rows."""
    cells = df.select(*by, F.explode(flags).alias("measure", "reason"))
    return cells.groupBy(*by, "measure", "reason").agg(F.count(F.lit(1)).alias("cells"))


def null_counts(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """Rows and missing cells per column, per entity and in total, in one pass."""
    n = F.count(F.lit(1))
    aggs = [n.alias("total"), *[(n - F.count(c)).alias(f"{c}_missing") for c in columns]]
    return df.groupingSets([[F.col(by)], []], F.col(by)).agg(*aggs)


def _steps(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return previous_row(df.select(*by, HOUR), by, HOUR, {HOUR: "__prev"}).where(F.col("__prev").isNotNull())


def gap_list(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Previous and next reading around every gap, and the hours missing between them."""
    missing = F.col(HOUR) - F.col("__prev") - 1
    return _steps(df, by).where(missing > 0).select(
        *by, hour_label("__prev").alias("gap_start"), hour_label(HOUR).alias("gap_end"), missing.alias("missing_hours")
    )


def coverage(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Span, observed / expected / missing hours and gap summary per entity."""
    span = df.groupBy(*by).agg(F.min(HOUR).alias("__lo"), F.max(HOUR).alias("__hi"), F.count(F.lit(1)).alias("observed"))
    gaps = gap_list(df, by).groupBy(*by).agg(F.count(F.lit(1)).alias("gaps"), F.max("missing_hours").alias("longest_gap"))
    expected = F.col("__hi") - F.col("__lo") + 1
    return span.join(gaps, list(by), "left").select(
        *by,
        hour_label("__lo").alias("first_ts"),
        hour_label("__hi").alias("last_ts"),
        "observed",
        expected.alias("expected"),
        (expected - F.col("observed")).alias("missing"),
        F.coalesce("gaps", F.lit(0)).alias("gaps"),
        F.coalesce("longest_gap", F.lit(0)).alias("longest_gap"),
        (100.0 * F.col("observed") / expected).alias("coverage_pct"),
    )


def gap_statistics(df: DataFrame, by: Sequence[str], *, expected: float, factor: float = 1.5) -> DataFrame:
    """Intervals between readings: how many exceed ``factor`` times the expected step, extremes and exact median."""
    steps = _steps(df, by).select(*by, (F.col(HOUR) - F.col("__prev")).cast("double").alias("h"))
    summary = steps.groupBy(*by).agg(
        F.count_if(F.col("h") > factor * expected).alias("gaps"), F.max("h").alias("max_interval"), F.min("h").alias("min_interval")
    )
    return summary.join(quantiles(steps, by, "h", {"median_interval": 0.5}), list(by))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def data_checks(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Rows that break each named condition, all in one aggregation."""
    return df.agg(*[F.count_if(cond).alias(name) for name, cond in checks.items()])


def file_duplicates(df: DataFrame, file: str, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows, repeated whole rows and repeated keys per file; whole rows are counted first and reused for the keys."""
    whole = df.groupBy(file, *columns).agg(F.count(F.lit(1)).alias("n"))
    by_key = whole.groupBy(file, *keys).agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("again"))
    return by_key.groupBy(file).agg(
        F.sum("n").alias("rows"), F.sum("again").alias("full_duplicates"), F.sum(F.col("n") - 1).alias("key_duplicates")
    )


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: counts of present, zero, negative and sentinel values, range, mean and exact median."""
    cells = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in columns])
    long = df.select(F.inline(cells))
    n = F.count(F.lit(1))
    summary = long.groupBy("measure").agg(
        n.alias("total"),
        F.count("v").alias("present"),
        (100.0 * (n - F.count("v")) / n).alias("missing_pct"),
        F.count_if(F.col("v") == 0).alias("zeros"),
        F.count_if(F.col("v") < 0).alias("negatives"),
        F.count_if(F.col("v").isin(*[float(s) for s in SENTINELS])).alias("sentinels"),
        F.min("v").alias("minimum"),
        F.max("v").alias("maximum"),
        F.avg("v").alias("mean"),
    )
    return summary.join(quantiles(long, ["measure"], "v", {"median": 0.5}), "measure", "left")


def schema_differences(pairs: DataFrame, file: str, column: str, reference: str) -> DataFrame:
    """Columns each file adds to or lacks from the reference file; ``pairs`` holds distinct (file, column).

    Files are never paired: each file's header is one array, compared with the reference header as a scalar.
    """
    wanted = pairs.where(F.col(file) == reference).select(column)
    others = pairs.where(F.col(file) != reference)
    added = others.join(wanted, column, "left_anti").select(file, column, F.lit("added").alias("change"))
    header = wanted.agg(F.sort_array(F.collect_set(column)).alias("__want"))
    held = others.groupBy(file).agg(F.collect_set(column).alias("__have"))
    lacking = held.select(file, F.explode(F.array_except(header.scalar(), F.col("__have"))).alias(column))
    return added.unionByName(lacking.withColumn("change", F.lit("removed")))


def entity_files(df: DataFrame, entity: str, file: str, ts: str) -> DataFrame:
    """Number of files and the time span per entity."""
    per_file = df.groupBy(entity, file).agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    return per_file.groupBy(entity).agg(
        F.count(F.lit(1)).alias("files"), F.min("lo").alias("first_ts"), F.max("hi").alias("last_ts")
    )


def load_statistics(df: DataFrame, file: str, ts: str, flags: str = "qc_flags") -> DataFrame:
    """Rows, replacements, flagged rows and time span per file and overall."""
    reasons = F.coalesce(F.map_values(flags), F.array().cast("array<string>"))
    hits = lambda p: F.sum(F.size(F.filter(reasons, lambda r: r.startswith(p)))).cast("long")
    return df.groupingSets([[F.col(file)], []], F.col(file)).agg(
        F.count(F.lit(1)).alias("raw_rows"),
        hits("SENTINEL_").alias("sentinel_replacements"),
        hits("OOB_").alias("out_of_bounds_replacements"),
        F.count_if(F.col(flags).isNotNull()).alias("qc_flagged_rows"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
    )
