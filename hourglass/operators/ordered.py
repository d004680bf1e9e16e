"""Ordered computations that never put a whole entity into one task.

Three notions of "n rows back" are kept apart by name: clock hours (an hour number on the grid), rows (a running
row number) and observed rows (a row number taken after dropping NULLs). Finite frames run over
(entity, block) partitions with a halo of copied rows; unbounded ones are split into per-block totals, a prefix
over the few blocks of an entity, and a second pass inside the block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

BLOCK_HOURS = 24 * 28
BLOCK_ROWS = 4096
_BLOCK = "__block"
_HOME = "__home"


class Frames:
    """Frames around the current position, ordered by an integer position column."""

    def __init__(self, window: WindowSpec):
        self._window = window

    def trailing(self, width: int) -> WindowSpec:
        """The current position and the ``width - 1`` before it."""
        return self._window.rangeBetween(-(width - 1), 0)

    def between(self, start: int, end: int) -> WindowSpec:
        return self._window.rangeBetween(start, end)

    def at(self, name: str | Column, offset: int) -> Column:
        """Value at exactly ``offset`` positions away (negative = earlier); NULL when that position is absent."""
        value = F.col(name) if isinstance(name, str) else name
        return F.max(value).over(self._window.rangeBetween(offset, offset))

    def _guarded(self, agg: Column, name: str | Column, frame: WindowSpec, min_periods: int) -> Column:
        return F.when(F.count(F.col(name) if isinstance(name, str) else name).over(frame) >= min_periods, agg.over(frame))

    def mean(self, name: str | Column, width: int, min_periods: int) -> Column:
        return self._guarded(F.avg(name), name, self.trailing(width), min_periods)

    def std(self, name: str | Column, width: int, min_periods: int) -> Column:
        return self._guarded(F.stddev_samp(name), name, self.trailing(width), min_periods)

    def min(self, name: str | Column, width: int, min_periods: int) -> Column:
        return self._guarded(F.min(name), name, self.trailing(width), min_periods)

    def max(self, name: str | Column, width: int, min_periods: int) -> Column:
        return self._guarded(F.max(name), name, self.trailing(width), min_periods)


def with_frames(
    df: DataFrame,
    by: Sequence[str],
    position: str,
    build: Callable[[Frames], dict[str, Column]],
    *,
    behind: int = 0,
    ahead: int = 0,
    block: int | None = BLOCK_HOURS,
    keep: Column | None = None,
    spread: bool = False,
) -> DataFrame:
    """Add frame expressions that look at most ``behind`` positions back and ``ahead`` positions forward.

    Rows near a block edge are copied into the neighbouring blocks, the frames run inside (by, block), and only
    the home copy of a row is kept, so a single long entity is spread over its blocks. The copies cost about
    (behind + ahead) / block extra rows. ``block=None`` runs one partition per key. ``keep`` filters after the frames.
    ``spread`` keeps all shuffle partitions where many frames make few bytes expensive: an explicit partition number is
    not merged by adaptive execution, and the hash layout is the one the window needs anyway.
    """
    if block is None:
        framed = Frames(Window.partitionBy(*by).orderBy(position))
        out = df.select("*", *[c.alias(n) for n, c in build(framed).items()])
        return out if keep is None else out.where(keep)
    first = F.floor((F.col(position) - ahead) / block)
    last = F.floor((F.col(position) + behind) / block)
    copies = df.select("*", F.floor(F.col(position) / block).alias(_HOME), F.explode(F.sequence(first, last)).alias(_BLOCK))
    if spread:
        copies = copies.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, _BLOCK)
    framed = Frames(Window.partitionBy(*by, _BLOCK).orderBy(position))
    out = copies.select("*", *[c.alias(n) for n, c in build(framed).items()]).where(F.col(_HOME) == F.col(_BLOCK))
    return (out if keep is None else out.where(keep)).drop(_HOME, _BLOCK)


def row_blocks(df: DataFrame, by: Sequence[str], position: str, out: str, *, rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of about ``rows`` rows per key, however dense its positions are, numbered in position order.

    A mergeable sketch gives each key its cuts, at most two per shuffle partition. A cut position is a block of its own (odd
    numbers), the open range between two cuts another (even numbers): rows that share one position can then be told apart from
    those that need an order. Rows without a position get a NULL block, rows without a key are dropped.
    """
    parts = max(2, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = df.groupBy(*by).agg(
        F.percentile_approx(position, [i / parts for i in range(1, parts)], 20 * parts).alias("__all"), F.count(position).alias("__n")
    )
    step = F.greatest(F.lit(1), F.floor(parts / F.greatest(F.lit(1), F.ceil(F.col("__n") / rows))))
    kept = F.filter("__all", lambda _, i: (i + 1) % step == 0)
    placed = df.join(found.select(*by, F.array_distinct(kept).alias("__cuts")), list(by))
    cuts, at = F.col("__cuts"), F.col(position)

    def halve(a: Column, _: Column) -> Column:
        mid = F.floor((a.lo + a.hi) / 2).cast("int")
        right = (a.lo < a.hi) & (F.get(cuts, mid) < at)
        return F.struct(F.when(right, mid + 1).otherwise(a.lo).alias("lo"), F.when(right | (a.lo >= a.hi), a.hi).otherwise(mid).alias("hi"))

    bounds = F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi"))
    below = F.aggregate(F.sequence(F.lit(0), F.lit(parts.bit_length())), bounds, halve, lambda a: a.lo)
    number = F.when(at.isNotNull(), 2 * below + F.coalesce(F.get(cuts, below) == at, F.lit(False)).cast("int"))
    return placed.withColumn(out, number.cast("long")).drop("__cuts")


def _blocked(df: DataFrame, position: str, block: int) -> DataFrame:
    return df.withColumn(_BLOCK, F.floor(F.col(position) / block))


def running_total(
    df: DataFrame, by: Sequence[str], position: str, value: Column | str, out: str, *, block: int = BLOCK_HOURS
) -> DataFrame:
    """Inclusive running sum of ``value`` per key in position order (positions unique per key)."""
    amount = (F.col(value) if isinstance(value, str) else value).cast("long")
    rows = _blocked(df.withColumn("__amount", F.coalesce(amount, F.lit(0))), position, block)
    earlier = Window.partitionBy(*by).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*by, _BLOCK)
        .agg(F.sum("__amount").alias("__sum"))
        .select(*by, _BLOCK, F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    )
    inside = Window.partitionBy(*by, _BLOCK).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(offsets, [*by, _BLOCK])
    return joined.withColumn(out, F.col("__before") + F.sum("__amount").over(inside)).drop("__amount", "__before", _BLOCK)


def row_index(
    df: DataFrame, by: Sequence[str], position: str, out: str = "row_no", *, block: int = BLOCK_HOURS
) -> DataFrame:
    """1-based row number per key in position order, without a per-key sort in one task."""
    return running_total(df, by, position, F.lit(1), out, block=block)


def fill_from_neighbours(
    df: DataFrame, by: Sequence[str], position: str, value: str, out: str, *, block: int = BLOCK_HOURS
) -> DataFrame:
    """Forward fill, then backward fill, of ``value`` per key."""
    rows = _blocked(df, position, block)
    per_block = rows.where(F.col(value).isNotNull()).groupBy(*by, _BLOCK).agg(
        F.max_by(value, position).alias("__last"), F.min_by(value, position).alias("__first")
    )
    edges = rows.select(*by, _BLOCK).distinct().join(per_block, [*by, _BLOCK], "left")
    w = Window.partitionBy(*by).orderBy(_BLOCK)
    edges = edges.select(
        *by,
        _BLOCK,
        F.last("__last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"),
        F.first("__first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("__after"),
    )
    inside = Window.partitionBy(*by, _BLOCK).orderBy(position)
    past = F.last(value, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    future = F.first(value, ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing))
    filled = F.coalesce(past, F.col("__before"), future, F.col("__after"))
    return rows.join(edges, [*by, _BLOCK]).withColumn(out, filled).drop("__before", "__after", _BLOCK)


def previous_row(
    df: DataFrame, by: Sequence[str], position: str, columns: dict[str, str], *, block: int = BLOCK_HOURS
) -> DataFrame:
    """Values of the previous row of the key (``columns``: source -> output name), however far back it lies."""
    rows = _blocked(df, position, block)
    names = list(dict.fromkeys(columns))
    last = rows.groupBy(*by, _BLOCK).agg(F.max_by(F.struct(*names), F.col(position)).alias("__edge"))
    w = Window.partitionBy(*by).orderBy(_BLOCK)
    edges = last.select(*by, _BLOCK, F.lag("__edge").over(w).alias("__edge"))
    inside = Window.partitionBy(*by, _BLOCK).orderBy(position)
    first = F.row_number().over(inside) == 1
    picked = [
        F.when(first, F.col("__edge")[src]).otherwise(F.lag(src).over(inside)).alias(dst) for src, dst in columns.items()
    ]
    return rows.join(edges, [*by, _BLOCK]).select(*df.columns, *picked)
