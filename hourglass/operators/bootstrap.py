"""Day-block bootstrap intervals on day sums.

Rows are reduced to one row of sums per (group, day) first. Each draw picks a day by integer arithmetic on (seed, draw,
position), so draws are the same on every run and need no driver-side table; the draws are joined to the day sums by day number and
added up, which touches draws x days rows of a group, never draws x rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


DRAWS = 1000
SEED = 42
PRIME = 2147483647


def day_sums(df: DataFrame, by: Sequence[str], day: Column, sums: Mapping[str, Column]) -> DataFrame:
    """One row per (by, day): row count and the named sums."""
    keyed = df.select(*by, day.alias("day"), *[c.alias(n) for n, c in sums.items()])
    return keyed.groupBy(*by, "day").agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(n).alias(n) for n in sums])


def portable_pick(draw: Column, position: Column, days: Column, seed: int) -> Column:
    """Day number 0..days-1 for one position of one draw: two squarings modulo a prime, plain integer arithmetic."""
    prime = F.lit(PRIME)
    a = (F.lit(seed).cast("long") + (draw + 1) * 7919 + (position + 1) * 104729) % prime
    b = (a * a + 48271) % prime
    return ((b * b + a) % prime) % days


def resample(
    sums: DataFrame, by: Sequence[str], names: Sequence[str], *, draws: int = DRAWS, seed: int = SEED,
    pick: Callable[[Column, Column, Column, int], Column] = portable_pick,
) -> DataFrame:
    """Totals of every draw: (by, draw, n, names...). A group has one row per day, so its days are numbered in a window.

    A draw depends only on the number of days, so the multiplicities (draw, day number) are made once per distinct
    number of days, not once per group, and stay a small table next to the day sums.
    """
    whole = Window.partitionBy(*by)
    numbered = sums.select(
        "*", (F.row_number().over(whole.orderBy("day")) - 1).cast("long").alias("__no"), F.count(F.lit(1)).over(whole).alias("__days")
    )
    lengths = numbered.select("__days").distinct()
    opened = lengths.select("__days", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    opened = opened.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__days") - 1)).alias("__pos"))
    picked = opened.select("__days", "draw", pick(F.col("draw"), F.col("__pos"), F.col("__days"), seed).alias("__no"))
    times = picked.groupBy("__days", "draw", "__no").agg(F.count(F.lit(1)).alias("__times"))
    joined = numbered.drop("day").join(times, ["__days", "__no"])
    return joined.groupBy(*by, "draw").agg(*[F.sum(F.col(c) * F.col("__times")).alias(c) for c in ("n", *names)])


def intervals(
    draws: DataFrame, by: Sequence[str], statistics: Mapping[str, Column], *, level: float = 0.95
) -> DataFrame:
    """Percentile interval of each statistic over the draws, as ``<name>_lo`` and ``<name>_hi``.

    A group holds exactly the number of draws, so the built-in exact percentile is bounded.
    """
    edge = (1 - level) / 2
    cols = draws.select(*by, *[c.alias(n) for n, c in statistics.items()])
    aggs = [F.percentile(n, F.lit(p)).alias(f"{n}_{tag}") for n in statistics for tag, p in (("lo", edge), ("hi", 1 - edge))]
    return cols.groupBy(*by).agg(*aggs) if by else cols.agg(*aggs)


def skill(model: Column, reference: Column) -> Column:
    """1 - model / reference; NULL when the reference error is not positive."""
    return F.when(reference > 0, 1 - model / reference)
