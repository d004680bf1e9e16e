"""Monotone least-squares fit by pooling in value ranges, then across their edges.

Distinct values with their weights are cut into ranges at sampled quantiles. Inside a range neighbours that fall are pooled in one
pass. Then edges between ranges are mended in rounds: where the last block of a range lies above the first of the next one, a few
blocks move over and the range is pooled again. Of neighbouring edges every other one is mended in a round, so a long falling stretch
closes in logarithmically many rounds. No task sorts all values, and the driver sees two blocks per range.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from .lineage import cut_lineage

BLOCKS = "range_no int, low double, high double, weight double, total double"
MOVED = 64  # blocks that go over an edge in the first round; twice as many in each further one


def pooled(blocks: list[tuple[float, float, float, float]]) -> list[tuple[float, float, float, float]]:
    """Neighbouring (low, high, weight, total) with falling or equal means pooled, in ascending order of values."""
    out: list[tuple[float, float, float, float]] = []
    for low, high, weight, total in blocks:
        while out and out[-1][3] * weight >= total * out[-1][2]:
            low, _, w, t = out.pop()
            weight, total = weight + w, total + t
        out.append((low, high, weight, total))
    return out


def _pool_ranges(blocks: DataFrame) -> DataFrame:
    """Every range pooled; a task walks through its sorted ranges and holds the pooled blocks of one."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = None, []

        def done() -> pa.RecordBatch:
            low, high, weight, total = (pa.array(c, pa.float64()) for c in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([number] * len(held), pa.int32()), low, high, weight, total], names=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            rows = list(zip(*[c.to_pylist() for c in batch.columns], strict=True))
            at = 0
            while at < len(rows):
                if rows[at][0] != number:
                    if held:
                        yield done()
                    number, held = rows[at][0], []
                end = at
                while end < len(rows) and rows[end][0] == number:
                    end += 1
                held = pooled(held + [r[1:] for r in rows[at:end]])
                at = end
        if held:
            yield done()

    return blocks.sortWithinPartitions("range_no", "low").mapInArrow(run, BLOCKS)


def _edges(blocks: DataFrame) -> list:
    """First and last block of every range that has any, in order (as many rows as ranges)."""
    first, last = (f(F.struct("low", (F.col("total") / F.col("weight")).alias("mean"))) for f in (F.min, F.max))
    return blocks.groupBy("range_no").agg(first.alias("first"), last.alias("last")).orderBy("range_no").collect()


def _mend(edges: list) -> dict[int, int]:
    """Falling edges as range -> range before it; no two of them are neighbours."""
    chosen: dict[int, int] = {}
    for left, right in zip(edges, edges[1:], strict=False):
        if left["last"]["mean"] >= right["first"]["mean"] and left.range_no not in chosen:
            chosen[right.range_no] = left.range_no
    return chosen


def _range_of(value: Column, cuts: Sequence[float]) -> Column:
    """Number of ascending ``cuts`` that are not above ``value``, by bisection."""
    if not cuts:
        return F.lit(0)
    edges = F.array(*[F.lit(float(c)) for c in cuts])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(cuts)) & (F.get(edges, at + s - 1) <= value), at + s).otherwise(at))


class IsotonicFit(NamedTuple):
    """``blocks``: (range_no, low, high, weight, value), values rising from block to block. ``edges``: (range_no, low, value) of the first
    block of every range, in order."""

    blocks: DataFrame
    edges: list[tuple[int, float, float]]

    def apply(self, df: DataFrame, feature: str, out: str) -> DataFrame:
        """The rows with the fitted value: constant inside a block, linear between two, constant beyond both ends.

        Distinct values look up their block (one pass over each range in order), rows then join their value; NULL, NaN and an empty
        fit give NULL.
        """
        rows = df.withColumn("__x", F.col(feature).cast("double") + 0.0)
        if not self.edges:
            return rows.withColumn(out, F.lit(None).cast("double")).drop("__x")
        numbers, lows, values = zip(*self.edges, strict=True)
        wanted = rows.where(F.col("__x").isNotNull() & ~F.isnan("__x")).select("__x").distinct()
        place = F.greatest(_range_of(F.col("__x"), lows) - 1, F.lit(0))
        following = {n: i + 1 for i, n in enumerate(numbers)}
        index = F.create_map(*[F.lit(v) for n, i in following.items() for v in (n, i - 1)])
        in_range = Window.partitionBy("place").orderBy("low")
        after = F.struct(F.get(F.array(*[F.lit(v) for v in lows]), F.col("place") + 1).alias("low"), F.get(F.array(*[F.lit(v) for v in values]), F.col("place") + 1).alias("value"))
        chain = self.blocks.withColumn("place", index[F.col("range_no")]).select(
            "place", F.col("low").alias("__x"), F.struct("low", "high", "value", F.coalesce(F.lead("low").over(in_range), after["low"]).alias("next_low"), F.coalesce(F.lead("value").over(in_range), after["value"]).alias("next_value")).alias("b")
        )
        points = chain.select("place", "__x", "b", F.lit(False).alias("asked")).unionByName(wanted.select(place.alias("place"), "__x", F.lit(None).cast(chain.schema["b"].dataType).alias("b"), F.lit(True).alias("asked")))
        walk = Window.partitionBy("place").orderBy("__x", "asked").rowsBetween(Window.unboundedPreceding, 0)
        found = points.withColumn("b", F.last("b", ignorenulls=True).over(walk)).where("asked")
        b = F.col("b")
        between = b["value"] + (b["next_value"] - b["value"]) * (F.col("__x") - b["high"]) / (b["next_low"] - b["high"])
        fitted = F.when(b.isNull(), F.lit(values[0])).when((F.col("__x") <= b["high"]) | b["next_low"].isNull(), b["value"]).otherwise(between)
        return rows.join(found.select("__x", fitted.alias(out)), "__x", "left").drop("__x")


def isotonic_fit(pairs: DataFrame, feature: str, label: str, *, ranges: int | None = None) -> IsotonicFit:
    """The non-decreasing least-squares fit of ``label`` on ``feature``.

    NULL or NaN features and labels are left out; equal features are one value with their mean and count, after map-side combine,
    however many rows have it; no rows give no blocks.
    """
    x, y = F.col(feature).cast("double"), F.col(label).cast("double")
    rows = pairs.where(x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)).select((x + 0.0).alias("x"), y.alias("y"))
    cells = cut_lineage(rows.groupBy("x").agg(F.count(F.lit(1)).cast("double").alias("weight"), F.sum("y").alias("total")))
    count = ranges or 2 * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / count for i in range(1, count)]
    cuts = sorted(set(cells.agg(F.percentile_approx("x", shares, 20 * count)).first()[0] or [])) if shares else []
    laid = cells.select(_range_of(F.col("x"), cuts).alias("range_no"), F.col("x").alias("low"), F.col("x").alias("high"), "weight", "total")
    blocks = cut_lineage(_pool_ranges(laid.repartition("range_no")))
    moved = MOVED
    while chosen := _mend(edges := _edges(blocks)):
        touched = sorted({*chosen, *chosen.values()})
        to = F.create_map(*[F.lit(v) for pair in chosen.items() for v in pair])
        order = F.row_number().over(Window.partitionBy("range_no").orderBy("low"))
        busy = blocks.where(F.col("range_no").isin(touched)).withColumn("place", order)
        goes = F.col("range_no").isin(sorted(chosen)) & (F.col("place") <= moved)
        shifted = busy.select(F.when(goes, to[F.col("range_no")]).otherwise(F.col("range_no")).alias("range_no"), "low", "high", "weight", "total")
        blocks = cut_lineage(blocks.where(~F.col("range_no").isin(touched)).unionByName(_pool_ranges(shifted.repartition("range_no"))))
        moved *= 2
    value = (F.col("total") / F.col("weight")).alias("value")
    return IsotonicFit(blocks.select("range_no", "low", "high", "weight", value), [(e.range_no, e["first"]["low"], e["first"]["mean"]) for e in edges])
