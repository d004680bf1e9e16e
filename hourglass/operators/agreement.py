"""Agreement between two sources of the same quantity, and between rebuilt and stored results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .grid import HOUR
from .lineage import cut_lineage
from .slots import slots_to_hours
from .tables import offset_pairs

LAGS = (-1, 0, 1)
LAG_PREFERENCE = (0, -1, 1)
MIN_PAIRS = 12


@dataclass(frozen=True)
class Gate:
    """Limits of the agreement gate."""

    min_overlap_days: float = 7
    min_pairs_pooled: int = 150
    min_stations: int = 5
    min_pairs_station: int = 24
    min_corr: float = 0.9
    max_abs_bias_share: float = 0.10
    max_mae_share: float = 0.20


def paired_values(shadow: DataFrame, primary: DataFrame, entity: str, measures: Sequence[str], lags: Sequence[int] = LAGS) -> DataFrame:
    """Long pairs (measure, lag, entity, shadow hour, s, p) with both values present."""
    wide = offset_pairs(shadow, primary, [entity], lags, measures)
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"{m}_s").alias("s"), F.col(f"{m}_p").alias("p")) for m in measures])
    return wide.select(entity, HOUR, "lag", F.inline(cells)).where("s IS NOT NULL AND p IS NOT NULL")


def _pair_stats() -> list[Column]:
    d = F.col("s") - F.col("p")
    mean_p = F.avg("p")
    r = F.corr("s", "p")
    defined = (F.stddev_pop("s") > 0) & (F.stddev_pop("p") > 0) & (F.count(F.lit(1)) > 2)
    return [
        F.count(F.lit(1)).alias("pairs"),
        F.avg(d).alias("bias"),
        F.avg(F.abs(d)).alias("mae"),
        F.when(mean_p > 0, F.avg(d) / mean_p).alias("bias_share"),
        F.when(mean_p > 0, F.avg(F.abs(d)) / mean_p).alias("mae_share"),
        F.when(defined, r).alias("corr"),
    ]


def agreement(shadow: DataFrame, primary: DataFrame, entity: str, measures: Sequence[str], *, lags: Sequence[int] = LAGS, min_pairs: int = MIN_PAIRS) -> DataFrame:
    """Pairs, bias, MAE, relative MAE and correlation per (measure, lag)."""
    stats = paired_values(shadow, primary, entity, measures, lags).groupBy("measure", "lag").agg(*_pair_stats())
    return stats.where(F.col("pairs") >= min_pairs)


def best_lag(table: DataFrame) -> DataFrame:
    """Lag with the smallest relative error per measure."""
    rest = [c for c in table.columns if c != "measure"]
    best = table.groupBy("measure").agg(F.min_by(F.struct(*rest), F.struct(F.col("mae_share"), F.col("lag"))).alias("b"))
    return best.select("measure", "b.*")


def _preference() -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LAG_PREFERENCE]), F.col("lag"))


def gate_evidence(shadow: DataFrame, primary: DataFrame, entity: str, measures: Sequence[str], limits: Gate = Gate()) -> DataFrame:
    """Evidence rows (measure, lag, scope, entity, stats, passes) of the gate.

    The offset is chosen on the first half of the overlap, the judgement is made on the second half per station; the
    ``pooled`` scope covers the stations that pass alone, ``pooled_all`` every station.
    """
    # every statistic below branches from the pairs: their two sides are made once
    shadow, primary = (cut_lineage(side.select(entity, HOUR, *[m for m in measures if m in side.columns])) for side in (shadow, primary))
    pairs = paired_values(shadow, primary, entity, measures)
    # the overlap holds one element per calendar hour, so its sorted hours fit one array
    hours = pairs.agg(F.sort_array(F.collect_set(HOUR)).alias("h"))
    split = hours.select(F.element_at("h", (F.floor(F.size("h") / 2) + 1).cast("int"))).scalar()
    halves = pairs.withColumn("__second", F.col(HOUR) >= split)
    first = halves.where(~F.col("__second")).groupBy("measure", "lag").agg(F.count(F.lit(1)).alias("n"), (F.avg(F.abs(F.col("s") - F.col("p"))) / F.avg("p")).alias("share"))
    chosen = first.where(F.col("n") >= MIN_PAIRS).groupBy("measure").agg(F.min_by("lag", F.struct(F.round("share", 4), _preference())).alias("lag"))
    second = halves.where(F.col("__second")).join(chosen, ["measure", "lag"])
    station = second.groupBy("measure", "lag", entity).agg(*_pair_stats())
    station = station.withColumn("passes", _passes(limits, limits.min_pairs_station))
    good = station.where("passes").select("measure", entity)
    pooled = second.join(good, ["measure", entity], "left_semi").groupBy("measure", "lag").agg(*_pair_stats())
    pooled = pooled.withColumn("passes", _passes(limits, limits.min_pairs_pooled))
    every = second.groupBy("measure", "lag").agg(*_pair_stats()).withColumn("passes", F.lit(None).cast("boolean"))
    none = F.lit(None).cast(shadow.schema[entity].dataType)
    names = ["measure", "lag", "scope", entity, "pairs", "bias", "mae", "bias_share", "mae_share", "corr", "passes"]
    parts = [
        station.withColumn("scope", F.lit("station")),
        pooled.withColumn("scope", F.lit("pooled")).withColumn(entity, none),
        every.withColumn("scope", F.lit("pooled_all")).withColumn(entity, none),
    ]
    return parts[0].select(*names).unionByName(parts[1].select(*names)).unionByName(parts[2].select(*names))


def _passes(limits: Gate, min_pairs: int) -> Column:
    ok = (
        (F.col("pairs") >= min_pairs)
        & (F.col("corr") >= limits.min_corr)
        & (F.abs(F.col("bias_share")) < limits.max_abs_bias_share)
        & (F.col("mae_share") < limits.max_mae_share)
    )
    return F.coalesce(ok, F.lit(False))


def gate_verdicts(evidence: DataFrame, entity: str, measures: Sequence[str], limits: Gate = Gate()) -> DataFrame:
    """One row per measure: passing stations, pooled result, verdict and reason words; absent measures fail."""
    judged = evidence.groupBy("measure").agg(
        F.max("lag").alias("lag"),
        F.count_if((F.col("scope") == "station") & F.col("passes")).alias("stations_passing"),
        F.max(F.when(F.col("scope") == "pooled", F.col("pairs"))).alias("pooled_pairs"),
        F.coalesce(F.bool_or(F.when(F.col("scope") == "pooled", F.col("passes"))), F.lit(False)).alias("pooled_ok"),
    )
    wanted = evidence.sparkSession.range(1).select(F.explode(F.array(*[F.lit(m) for m in measures])).alias("measure"))
    rows = wanted.join(judged, "measure", "left")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("lag").isNull(), F.lit("too few pairs to choose the offset")),
            F.when(F.col("lag").isNotNull() & ~F.col("pooled_ok"), F.lit("pooled agreement")),
            F.when(F.col("lag").isNotNull() & (F.col("stations_passing") < limits.min_stations), F.lit("stations passing")),
        )
    )
    out = rows.select("measure", "lag", F.coalesce("stations_passing", F.lit(0)).alias("stations_passing"), F.coalesce("pooled_pairs", F.lit(0)).alias("pooled_pairs"), F.concat_ws("; ", reasons).alias("reasons"))
    return out.withColumn("passed", F.col("reasons") == "")


def usable_stations(evidence: DataFrame, verdicts: DataFrame, entity: str, members: Sequence[str]) -> DataFrame:
    """Stations that pass every member measure, provided every member passed as a network."""
    good = evidence.where((F.col("scope") == "station") & F.col("passes") & F.col("measure").isin(*members))
    passed = verdicts.where(F.col("passed") & F.col("measure").isin(*members)).select("measure")
    kept = good.join(passed, "measure", "left_semi")
    return kept.groupBy(entity).agg(F.count_distinct("measure").alias("n")).where(F.col("n") == len(members)).select(entity)


# Slot offsets of the overlap scan, in minutes, and its relative tolerance.
SCAN_OFFSETS = tuple(range(-75, 76, 15))
EXACT_TOLERANCE = 0.005


def overlap_scan(slots: DataFrame, reference: DataFrame, entity: str, start: str, value: str, ref: str, *, offsets: Sequence[int] = SCAN_OFFSETS, min_pairs: int = 20) -> DataFrame:
    """Agreement of quarter-hour slots with a reference hour series at each offset, per station."""
    hours = slots_to_hours(slots, [entity], start, value, "o", offsets=offsets)
    joined = hours.join(reference.select(entity, HOUR, F.col(ref).alias("c")), [entity, HOUR]).where("c IS NOT NULL")
    d = F.abs(F.col("o") - F.col("c"))
    stats = joined.groupBy(entity, "offset").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(d).alias("mae"),
        (100 * F.avg(d) / F.greatest(F.avg(F.abs("c")), F.lit(1e-9))).alias("mae_pct"),
        F.avg((d <= EXACT_TOLERANCE * F.greatest(F.abs("c"), F.lit(1e-6))).cast("double")).alias("exact_share"),
        F.corr("o", "c").alias("corr"),
        (F.sum(F.col("o") * F.col("c")) / F.greatest(F.sum(F.col("o") * F.col("o")), F.lit(1e-12))).alias("slope"),
    )
    return stats.where(F.col("n") >= min_pairs)


def pooled_scan(scan: DataFrame) -> DataFrame:
    """Relative error per offset, weighted by pairs."""
    return scan.groupBy("offset").agg(F.count(F.lit(1)).alias("stations"), F.sum("n").alias("pairs"), (F.sum(F.col("mae_pct") * F.col("n")) / F.sum("n")).alias("pooled_mae_pct"))


def plausibility(live: DataFrame, history: DataFrame, by: Sequence[str], value: str, ref: str) -> DataFrame:
    """Percentile position of live values in a reference distribution, with its 10th, 50th and 90th percentile.

    ``live`` has one row per key. Counting below the live value is a plain aggregate over the joined reference.
    """
    joined = history.where(F.col(ref).isNotNull()).join(live.select(*by, F.col(value).alias("__live")), list(by))
    share = joined.groupBy(*by).agg(F.first("__live").alias(value), F.avg((F.col(ref) < F.col("__live")).cast("double")).alias("position"))
    from .ranks import quantiles

    return share.join(quantiles(joined, by, ref, {"p10": 0.1, "p50": 0.5, "p90": 0.9}), list(by))


# --------------------------------------------------------------------------------------------------- parity, fidelity
def parity_summary(df: DataFrame, by: Sequence[str], issue: str, left: str, right: str, *, tolerance: float = 1e-6) -> DataFrame:
    """Issue hours, rows, compared rows, largest and mean difference, rows over tolerance."""
    d = F.abs(F.col(left) - F.col(right))
    return df.groupBy(*by).agg(
        F.count_distinct(issue).alias("issue_hours"), F.count(F.lit(1)).alias("rows"), F.count(d).alias("compared"), F.max(d).alias("max_abs_diff"), F.avg(d).alias("mean_abs_diff"),
        F.count_if(d > tolerance).alias("rows_over_tolerance"),
    )


def fidelity(rebuilt: DataFrame, stored: DataFrame, keys: Sequence[str], columns: Sequence[str], *, rtol: float = 1e-6, atol: float = 1e-6) -> DataFrame:
    """Share of cells equal within tolerance on the common keys; two missing cells are equal."""
    other = stored.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = rebuilt.select(*keys, *columns).join(other, list(keys))

    def close(c: str) -> Column:
        a, b = F.col(c), F.col(f"__{c}")
        return F.coalesce(F.abs(a - b) <= atol + rtol * F.abs(b), a.isNull() & b.isNull()).cast("double")

    share = sum((F.avg(close(c)) for c in columns), F.lit(0.0)) / len(columns)
    return joined.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(columns)).alias("columns"), share.alias("share_of_cells_equal"))


def scenario_error(base: DataFrame, scenarios: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Error of each scenario's index against the baseline on the keys both have; ``scenarios`` carries ``scenario``."""
    joined = scenarios.join(base.select(*keys, F.col(value).alias("__base")), list(keys)).where(F.col(value).isNotNull() & F.col("__base").isNotNull())
    d = F.col(value) - F.col("__base")
    return joined.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias"))


def row_set_reconciliation(df: DataFrame, actual: str, model: str, persistence: str, sets: Mapping[str, Column]) -> DataFrame:
    """MAE and skill of one model on several (overlapping) row sets in one pass."""
    tags = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in sets.items()]))
    rows = df.select(F.abs(F.col(model) - F.col(actual)).alias("m"), F.abs(F.col(persistence) - F.col(actual)).alias("p"), F.explode(tags).alias("row_set"))
    return rows.groupBy("row_set").agg(F.count(F.lit(1)).alias("n"), F.avg("m").alias("model_mae"), F.avg("p").alias("persistence_mae"), (1 - F.avg("m") / F.avg("p")).alias("skill_mae"))


