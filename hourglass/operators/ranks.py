"""Exact order statistics from distinct-value counts.

A group is first reduced to (value, count) with map-side combine. The distinct values are then laid into buckets by a
monotone function of the value alone (equal widths between the group's minimum and maximum, plus equal ratios), so a
re-run after a lost executor lays them out identically. Cumulative counts are a prefix over buckets plus a pass inside
each bucket. Percentiles, average-tie ranks, ranking areas and conformal picks all read the same table, and no group is
ever gathered into a single hash map or sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .lineage import cut_lineage

WIDTHS = 512
PER_OCTAVE = 32
SMALLEST = 1e-9
ACCURACY = 10_000  # of the sketch: a rank is off by at most a ten-thousandth of the rows
MANY, SOME = 20_000, 1_000  # rows of a group from which it is thinned tightly, loosely; smaller groups are kept whole
MARGINS = (4 / ACCURACY, 0.01)


def _bucket(value: Column, low: Column, high: Column, widths: int) -> Column:
    """Non-decreasing in ``value``: cells of equal width plus cells of equal ratio, so neither a long tail nor a
    narrow band crowds one bucket."""
    x = value.cast("double")
    span = (high - low).cast("double")
    linear = F.when(span > 0, F.floor((x - low) / span * widths)).otherwise(F.lit(0))
    octave = F.floor(F.log2(F.greatest(F.abs(x) / SMALLEST, F.lit(1.0))) * PER_OCTAVE)
    return linear + F.signum(x).cast("long") * octave


def value_counts(
    df: DataFrame, by: Sequence[str], value: str, totals: dict[str, Column] | None = None, *, weight: Column | None = None,
    widths: int = WIDTHS
) -> DataFrame:
    """One row per (by, value) with its count ``n`` (or summed ``weight``), the rows ``below`` it and the group ``total``.

    ``totals`` adds further sums accumulated the same way: for ``pos`` the columns ``pos``, ``pos_below``, ``pos_total``.
    """
    extra = dict(totals or {})
    sums = ["n", *extra]
    distinct = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"), *[F.sum(c).alias(name) for name, c in extra.items()])
    )
    laid = _lay_out(distinct, by, value, widths)
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = (
        laid.groupBy(*by, "__bucket")
        .agg(*[F.sum(s).alias(s) for s in sums])
        .select(
            *by,
            "__bucket",
            *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"__{s}_offset") for s in sums],
            *[F.sum(s).over(whole).alias("total" if s == "n" else f"{s}_total") for s in sums],
        )
    )
    inside = Window.partitionBy(*by, "__bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    below = [
        (F.col(f"__{s}_offset") + F.coalesce(F.sum(s).over(inside), F.lit(0))).alias("below" if s == "n" else f"{s}_below")
        for s in sums
    ]
    return laid.join(offsets, [*by, "__bucket"]).select(
        *by, value, *sums, *below, *["total" if s == "n" else f"{s}_total" for s in sums]
    )


def _lay_out(distinct: DataFrame, by: Sequence[str], value: str, widths: int) -> DataFrame:
    """Attach the bucket number; the group's range is one row per group, or two scalars without a group."""
    low, high = F.min(value), F.max(value)
    if not by:
        ends = distinct.agg(low.alias("__low")).scalar(), distinct.agg(high.alias("__high")).scalar()
        return distinct.withColumn("__bucket", _bucket(F.col(value), *ends, widths))
    span = distinct.groupBy(*by).agg(low.alias("__low"), high.alias("__high"))
    bucket = _bucket(F.col(value), F.col("__low"), F.col("__high"), widths)
    return distinct.join(span, list(by)).withColumn("__bucket", bucket).drop("__low", "__high")


def pick_quantiles(
    counts: DataFrame, by: Sequence[str], value: str, probs: dict[str, float], *, interpolate: bool = True
) -> DataFrame:
    """Quantiles (linear interpolation between the two neighbouring ranks) from a ``value_counts`` table."""

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("below") <= rank) & (rank < F.col("below") + F.col("n")), F.col(value)))

    aggs = []
    for name, p in probs.items():
        rank = F.lit(float(p)) * (F.col("total") - 1)
        aggs += [at(F.floor(rank)).alias(f"__lo_{name}"), at(F.ceil(rank)).alias(f"__hi_{name}")]
    picked = counts.groupBy(*by).agg(F.max("total").alias("__total"), *aggs)
    out = []
    for name, p in probs.items():
        rank = F.lit(float(p)) * (F.col("__total") - 1)
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        out.append((lo + (hi - lo) * (rank - F.floor(rank)) if interpolate else lo).alias(name))
    return picked.select(*by, *out)


def thinned(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Rows (by, value, n, gap) from which the quantiles at ``probs`` can be read exactly, without a shuffle of all values.

    A mergeable sketch brackets every wanted rank. Its brackets depend on the order in which partial sketches arrive, so they are
    settled: no later pass, nor a re-run after a lost executor, sees others. In a second pass only values inside a bracket stay
    apart; those between two brackets are counted together, before anything is shuffled (``gap`` 1, with their smallest value
    standing for all). Of a large group about a thousandth per probability is left, ties counted once; a value that a large share
    of rows have is one row.
    """
    v = F.col(value).cast("double")
    rows = df.where(F.col(value).isNotNull()).select(*by, value)
    shares = sorted({s for p in probs for m in MARGINS for s in (p - m, p + m) if 0 < s < 1})
    found = {s: F.get("__s", F.lit(i)) for i, s in enumerate(shares)}
    everything = {-1: F.lit(float("-inf")), 1: F.lit(float("inf"))}

    def end(p: float, side: int) -> Column:
        chosen = [found.get(p + side * m, everything[side]) for m in MARGINS]
        return F.when(F.col("__n") >= MANY, chosen[0]).when(F.col("__n") >= SOME, chosen[1]).otherwise(everything[side])

    sketch = F.percentile_approx(v, shares, ACCURACY) if shares else F.array().cast("array<double>")
    sketched = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), sketch.alias("__s"))
    ends = cut_lineage(sketched.select(*by, F.array(*[end(p, side) for p in probs for side in (-1, 1)]).alias("__e")))
    joined = rows.join(ends, list(by)) if by else rows.withColumn("__e", ends.scalar())
    above = [v >= F.get("__e", F.lit(2 * i)) for i in range(len(probs))]
    beyond = [v > F.get("__e", F.lit(2 * i + 1)) for i in range(len(probs))]
    passed = sum((c.cast("int") for c in [*above, *beyond]), F.lit(0))
    inside = F.lit(False)
    for a, o in zip(above, beyond, strict=True):
        inside = inside | (a & ~o)
    cells = joined.select(*by, value, passed.alias("__passed"), F.when(inside, F.col(value)).alias("__kept"))
    counted = cells.groupBy(*by, "__passed", "__kept").agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("__least"))
    return counted.select(*by, F.coalesce("__kept", "__least").alias(value), "n", F.col("__kept").isNull().cast("int").alias("gap"))


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float], *, widths: int = WIDTHS) -> DataFrame:
    """Exact continuous percentiles per group, one column per entry of ``probs``.

    The input is read twice (sketch, counts around the wanted ranks); callers settle an input that is dear. Should a rank ever lie
    outside its bracket, the query fails (without groups: gives NULL) rather than give a neighbour's value.
    """
    few = cut_lineage(thinned(df, by, value, list(dict.fromkeys(probs.values()))))  # the ranges, the offsets and the pick read one table
    counts = value_counts(few, by, value, {"gap": F.col("gap")}, weight=F.col("n"), widths=widths)
    picked = pick_quantiles(counts.withColumn(value, F.when(F.col("gap") == 0, F.col(value))), by, value, probs)
    sure = [F.coalesce(name, F.raise_error(F.lit("a rank lies outside its bracket")).cast("double")).alias(name) for name in probs]
    return picked.select(*by, *sure) if by else picked


def wide_quantiles(df: DataFrame, by: Sequence[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Exact percentiles of several columns at once: ``wanted`` maps an output name to (column, probability).

    The columns are unpivoted inside the row and share one distinct-value table, then return to one row per group.
    """
    sources = list(dict.fromkeys(s for s, _ in wanted.values()))
    cells = F.array(*[F.struct(F.lit(s).alias("__measure"), F.col(s).cast("double").alias("__value")) for s in sources])
    long = df.select(*by, F.inline(cells))
    probs = sorted({p for _, p in wanted.values()})
    names = {p: f"__p{i}" for i, p in enumerate(probs)}
    keys = [*by, "__measure"]
    picked = quantiles(long, keys, "__value", {n: p for p, n in names.items()})
    return picked.groupBy(*by).agg(*[F.max(F.when(F.col("__measure") == s, F.col(names[p]))).alias(o) for o, (s, p) in wanted.items()])


def average_ranks(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Rank 1..n with ties averaged, joined to every row with a value."""
    counts = value_counts(df, by, value)
    ranks = counts.select(*by, value, (F.col("below") + (F.col("n") + 1) / 2.0).alias(out))
    return df.join(ranks, [*by, value])
