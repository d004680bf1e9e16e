"""Quarter-hour slots to complete hours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hours import hour_number
from .grid import HOUR

SLOT_MINUTES = 15
SLOTS = 4


def minute_number(ts: Column | str) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return hour_number(c) * 60 + F.minute(c)


def slots_to_hours(
    slots: DataFrame, by: Sequence[str], start: str, value: str, out: str, *, arrival: str | None = None, offsets: Sequence[int] = (0,), factor: float = 1.0
) -> DataFrame:
    """Mean of the four slots that start at T + offset, for hours where all four are present.

    A slot delivered twice keeps its last value by ``arrival``. Several offsets (minutes, multiples of 15) are evaluated
    in one pass by copying each slot once per offset.
    """
    minute = minute_number(start)
    pick = F.max_by(value, arrival) if arrival else F.max(value)
    clean = slots.groupBy(*by, minute.alias("__m")).agg(pick.alias("__v")).where(F.col("__v").isNotNull())
    moved = clean.select(*by, "__m", "__v", F.explode(F.array(*[F.lit(o) for o in offsets])).alias("offset"))
    moved = moved.where(F.pmod(F.col("__m") - F.col("offset"), F.lit(SLOT_MINUTES)) == 0)
    hours = moved.groupBy(*by, "offset", F.floor((F.col("__m") - F.col("offset")) / 60).alias(HOUR)).agg(
        F.count(F.lit(1)).alias("__n"), (F.avg("__v") * F.lit(factor)).alias(out)
    )
    full = hours.where(F.col("__n") == SLOTS).drop("__n")
    return full if len(offsets) > 1 else full.drop("offset")
