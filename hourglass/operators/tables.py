"""Joins, upserts, immutable inserts, key registries, set operations and samples over whole tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .cleaning import dedupe
from .grid import HOUR
from .ordered import BLOCK_ROWS, row_blocks


# ------------------------------------------------------------------------------------------------------------ upserts
def upsert_latest(stored: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Last write wins: a new row replaces the stored row of its key.

    Of several new rows of a key the last by ``order`` wins, then the one with the larger values, so a re-run agrees."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys and c not in order and c != "__new" and not both.schema[c].dataType.typeName().startswith("map")]
    return dedupe(both, keys, ["__new", *order, *rest]).drop("__new")


def _merge(stored: DataFrame, new: DataFrame, keys: Sequence[str], replace: Column) -> DataFrame:
    """Full outer merge; ``replace`` sees the structs ``__old`` and ``__fresh`` and decides where both exist."""
    names = stored.columns
    old = stored.select(*keys, F.struct(*names).alias("__old"))
    fresh = new.select(*keys, F.struct(*names).alias("__fresh"))
    joined = old.join(fresh, list(keys), "full_outer")
    take_new = F.col("__old").isNull() | (F.col("__fresh").isNotNull() & replace)
    return joined.select(F.when(take_new, F.col("__fresh")).otherwise(F.col("__old")).alias("__row")).select("__row.*")


def upsert_same_source(stored: DataFrame, new: DataFrame, keys: Sequence[str], source: str = "source") -> DataFrame:
    """Refresh a stored row only from its own source; across sources the first writer keeps the key."""
    return _merge(stored, new, keys, F.col(f"__old.{source}").eqNullSafe(F.col(f"__fresh.{source}")))


def upsert_replaceable(stored: DataFrame, new: DataFrame, keys: Sequence[str], sources: Sequence[str], source: str = "source") -> DataFrame:
    """Refresh only stored rows whose source is in ``sources``."""
    return _merge(stored, new, keys, F.coalesce(F.col(f"__old.{source}").isin(*sources), F.lit(False)))


def insert_absent(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key is not stored yet, one per key."""
    fresh = new.join(stored.select(*keys).distinct(), list(keys), "left_anti")
    rest = [c for c in new.columns if c not in keys]
    return dedupe(fresh, keys, rest, keep="first") if rest else fresh.distinct()


def get_or_create(registry: DataFrame, rows: DataFrame, key: Sequence[str], id_column: str) -> DataFrame:
    """Registry extended by unseen keys; an id is a hash of its key, so re-runs and parallel tasks agree on it."""
    unseen = rows.select(*key).distinct().join(registry.select(*key), list(key), "left_anti")
    return registry.unionByName(unseen.withColumn(id_column, F.xxhash64(*key)).select(*registry.columns))


# -------------------------------------------------------------------------------------------------------------- joins
def orphans(fact: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Fact rows without a dimension row."""
    return fact.join(dim.select(key).distinct(), key, "left_anti")


def offset_pairs(left: DataFrame, right: DataFrame, by: Sequence[str], lags: Sequence[int], values: Sequence[str], *, suffixes: tuple[str, str] = ("_s", "_p")) -> DataFrame:
    """Left row at hour S with the right row of the same entity at S + lag, for every lag.

    The right side is copied once per lag with its key shifted, so it stays one equi join.
    """
    shifts = F.array(*[F.struct(F.lit(k).alias("lag")) for k in lags])
    moved = right.select(*by, HOUR, *[F.col(v).alias(v + suffixes[1]) for v in values], F.inline(shifts))
    moved = moved.withColumn(HOUR, F.col(HOUR) - F.col("lag"))
    own = left.select(*by, HOUR, *[F.col(v).alias(v + suffixes[0]) for v in values])
    return own.join(moved, [*by, HOUR])


def common_keys(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Keys present in every frame, in one grouped pass."""
    tagged = None
    for i, frame in enumerate(frames):
        part = frame.select(*keys, F.lit(1 << i).alias("__bit"))
        tagged = part if tagged is None else tagged.unionByName(part)
    seen = tagged.groupBy(*keys).agg(F.bit_or("__bit").alias("__seen"))
    return seen.where(F.col("__seen") == (1 << len(frames)) - 1).select(*keys)


def matured(forecasts: DataFrame, scores: DataFrame, actuals: Mapping[str, tuple[DataFrame, str]], now_hour: Column, *, by: Sequence[str] = ("entity",)) -> DataFrame:
    """Unscored forecasts whose target hour is over, with the actual of their own target.

    ``actuals`` maps a target name to (table, value column); each branch joins only the rows of its target.
    """
    due = forecasts.join(scores.select("forecast_id").distinct(), "forecast_id", "left_anti").where(F.col("target_hour") + 1 <= now_hour)
    out = None
    for target, (table, value) in actuals.items():
        side = table.select(*by, F.col(HOUR).alias("target_hour"), F.col(value).alias("actual")).where(F.col("actual").isNotNull())
        part = due.where(F.col("target") == target).join(side, [*by, "target_hour"])
        out = part if out is None else out.unionByName(part)
    return out


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], left_pos: str, right_pos: str, values: Sequence[str], *, block: float | None = None, rows: int = BLOCK_ROWS, include_equal: bool | str = True) -> DataFrame:
    """Newest right row at or before each left row of the same key; of right rows at one position the one with the largest values.

    Both sides are merged into one ordered stream; the last right value is carried inside a block of positions and the
    blocks of a key are linked through their last rows, so a hot key is spread over its blocks. Blocks hold about ``rows``
    rows each, or are ``block`` wide where that is given. Left positions may repeat: a position that many rows share is a
    block that needs no order, so its rows are spread too. Left rows without key or position are dropped.
    ``include_equal`` may name a boolean left column that says per row whether an equal position counts.
    """
    inclusive = F.col(include_equal) if isinstance(include_equal, str) else F.lit(include_equal)
    payload = F.struct(F.col(right_pos).alias("__at"), *values)
    r = right.select(*by, F.col(right_pos).alias("__pos"), F.lit(1).alias("__side"), payload.alias("__val"), F.lit(None).alias("__row"))
    lrow = F.struct(*left.columns)
    l = left.select(*by, F.col(left_pos).alias("__pos"), F.when(inclusive, 2).otherwise(0).alias("__side"), F.lit(None).alias("__val"), lrow.alias("__row"))
    both = r.unionByName(l)
    if block is None:
        both = row_blocks(both, by, "__pos", "__blk", rows=rows)
        spot = F.col("__blk") % 2 == 1
    else:
        both = both.withColumn("__blk", F.floor(F.col("__pos") / block))
        spot = F.lit(False)
    last = both.groupBy(*by, "__blk").agg(F.max("__val").alias("__own"))
    w = Window.partitionBy(*by).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    edges = last.select(*by, "__blk", "__own", F.last("__own", ignorenulls=True).over(w).alias("__edge"))
    salts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    needed = both.where(~spot | F.col("__row").isNotNull()).withColumn("__salt", F.when(spot, F.pmod(F.xxhash64("__row"), F.lit(salts))).otherwise(0))
    inside = Window.partitionBy(*by, "__blk", "__salt").orderBy("__pos", "__side", "__val").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(spot, F.when(F.col("__side") == 2, F.col("__own"))).otherwise(F.last("__val", ignorenulls=True).over(inside))
    joined = needed.join(edges, [*by, "__blk"]).withColumn("__hit", F.coalesce(own, F.col("__edge"))).where(F.col("__row").isNotNull())
    return joined.select("__row.*", *[F.col("__hit")[v].alias(v) for v in values], F.col("__hit")["__at"].alias("as_of"))


def history_window(history: DataFrame, issues: DataFrame, by: Sequence[str], hours: int, *, issue: str = "issue_hour") -> DataFrame:
    """Rows in (issue - hours, issue] for many issue hours at once: an equi join on day buckets, then the exact range."""
    width = hours
    bucket = lambda c: F.floor(c / width)
    asked = issues.select(*by, issue, F.explode(F.sequence(bucket(F.col(issue) - (hours - 1)), bucket(F.col(issue)))).alias("__b"))
    rows = history.withColumn("__b", bucket(F.col(HOUR)))
    inside = (F.col(HOUR) > F.col(issue) - hours) & (F.col(HOUR) <= F.col(issue))
    return asked.join(rows, [*by, "__b"]).where(inside).drop("__b")


# ------------------------------------------------------------------------------------------------------- sets, samples
def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows per group. Spark cuts each map partition to k per group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def stratified_hours(df: DataFrame, stratum: str, hour: str, k: int, *, seed: int = 0) -> DataFrame:
    """A repeatable sample of hours: ``k`` per stratum in the order of a digest that any engine has, plus the first and last hour of each."""
    hours = df.select(stratum, hour).distinct()
    picked = top_k(hours, [stratum], [F.md5(F.concat(F.lit(f"{seed}:"), F.col(hour).cast("string"))), F.col(hour)], k)
    edges = hours.groupBy(stratum).agg(F.array(F.min(hour), F.max(hour)).alias("__e")).select(stratum, F.explode("__e").alias(hour))
    return picked.union(edges).distinct()


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` that ``right`` does not hold, duplicates kept."""
    return left.exceptAll(right)
