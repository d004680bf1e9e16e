"""Chronological splits, embargo, folds and target statistics per split."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .ranks import quantiles


def assign_split(ts: Column | str, windows: Mapping[str, tuple[str, str]], *, default: str = "train") -> Column:
    """Label by inclusive local time windows; everything outside them is the default."""
    c = F.col(ts) if isinstance(ts, str) else ts
    expr = None
    for name, (first, last) in windows.items():
        inside = c.between(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz"))
        expr = (F if expr is None else expr).when(inside, name)
    return F.lit(default) if expr is None else expr.otherwise(default)


def purge_tail(df: DataFrame, ts: str, window_start: str, hours: int) -> DataFrame:
    """Rows issued early enough that no label reaches the window: strictly before its start less the embargo."""
    return df.where(F.col(ts) < F.lit(window_start).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(hours)} HOURS"))


def training_rows(df: DataFrame, ts: str, val_start: str, *, split: str = "split", embargo: int = 24) -> DataFrame:
    return purge_tail(df.where(F.col(split) == "train"), ts, val_start, embargo)


def strict_rows(df: DataFrame, ts: str, horizon: int, window_end: str) -> DataFrame:
    """Rows whose label also lies inside the window."""
    return df.where(F.col(ts) + F.expr(f"INTERVAL {int(horizon)} HOURS") <= F.lit(window_end).cast("timestamp_ntz"))


def fold_rows(df: DataFrame, ts: str, folds: Sequence[tuple[str, str, str]], *, embargo: int = 24) -> DataFrame:
    """Rolling-origin copies: per fold (name, test start, test end) an expanding train part and the fixed test part.

    A row is copied once per fold it serves, so all folds are scored in one grouped pass.
    """
    tests = []
    for name, first, last in folds:
        start, end = (F.lit(x).cast("timestamp_ntz") for x in (first, last))
        is_train = F.col(ts) < start - F.expr(f"INTERVAL {int(embargo)} HOURS")
        part = F.when(is_train, "train").when(F.col(ts).between(start, end), "test")
        tests.append(F.struct(F.lit(name).alias("fold"), part.alias("part")))
    return df.select("*", F.inline(F.array(*tests))).where("part IS NOT NULL")


def target_statistics(df: DataFrame, split: str, target: str, *, extreme: float = 300.0) -> DataFrame:
    """Count, moments, exact quartiles and p95, extremes per split and in total."""
    tagged = df.where(F.col(target).isNotNull()).select(F.explode(F.array(F.col(split), F.lit("total"))).alias(split), F.col(target).cast("double").alias("v"))
    n = F.count(F.lit(1))
    high = F.count_if(F.col("v") >= extreme)
    base = tagged.groupBy(split).agg(
        n.alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("minimum"), F.max("v").alias("maximum"), high.alias("extreme"), (100.0 * high / n).alias("extreme_pct")
    )
    return base.join(quantiles(tagged, [split], "v", {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}), split)


