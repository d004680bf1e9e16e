"""Classification views of a forecast: confusion, ranking areas, threshold sweeps, calibration, intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.piecewise import ordinal_class
from .lineage import cut_lineage
from .ranks import quantiles, value_counts
from .tables import as_of

CLASSES = 6


# ---------------------------------------------------------------------------------------------------------- confusion
def confusion_cells(df: DataFrame, by: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """Counts per (true class, predicted class); at most 36 rows per group."""
    both = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    return both.groupBy(*by, ordinal_class(actual).alias("t"), ordinal_class(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Macro / weighted scores, quadratic kappa, ordinal MAE, binary counts and critical misses from confusion cells.

    Classes that neither occur nor are predicted stay out of the macro means. The quadratic kappa needs only the first
    two moments of both margins.
    """
    t, p, n = F.col("t"), F.col("p"), F.col("n")
    total = lambda cond: F.sum(F.when(cond, n).otherwise(0))
    aggs = [F.sum(n).alias("n")]
    for c in range(CLASSES):
        aggs += [total((t == c) & (p == c)).alias(f"tp{c}"), total(t == c).alias(f"act{c}"), total(p == c).alias(f"prd{c}")]
    for name, x in (("st", t), ("sp", p), ("stt", t * t), ("spp", p * p), ("sdd", (t - p) * (t - p)), ("sad", F.abs(t - p))):
        aggs.append(F.sum(x * n).alias(name))
    hi_t, hi_p = t >= 4, p >= 4
    aggs += [
        total(hi_t & hi_p).alias("vpoor_plus_tp"), total(~hi_t & hi_p).alias("vpoor_plus_fp"), total(hi_t & ~hi_p).alias("vpoor_plus_fn"),
        total((t == 5) & (p <= 2)).alias("critical"),
    ]
    m = cells.groupBy(*by).agg(*aggs) if by else cells.agg(*aggs)
    col = F.col
    n = col("n").cast("double")

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    seen = [(col(f"act{c}") + col(f"prd{c}")) > 0 for c in range(CLASSES)]
    f1 = [ratio(2 * col(f"tp{c}"), col(f"act{c}") + col(f"prd{c}")) for c in range(CLASSES)]
    precision = [ratio(col(f"tp{c}"), col(f"prd{c}")) for c in range(CLASSES)]
    recall = [ratio(col(f"tp{c}"), col(f"act{c}")) for c in range(CLASSES)]
    present = sum((s.cast("int") for s in seen), F.lit(0))
    macro = lambda xs: sum((F.when(s, x).otherwise(0.0) for s, x in zip(seen, xs, strict=True)), F.lit(0.0)) / present
    weighted = sum((col(f"act{c}") * f1[c] for c in range(CLASSES)), F.lit(0.0)) / n
    expected = (col("stt") + col("spp")) / n - 2 * col("st") * col("sp") / (n * n)
    kappa = F.when(expected == 0, F.when(col("sdd") == 0, 1.0).otherwise(0.0)).otherwise(1 - (col("sdd") / n) / expected)
    severe = lambda x: F.when(seen[5], x)
    vtp, vfp, vfn = col("vpoor_plus_tp"), col("vpoor_plus_fp"), col("vpoor_plus_fn")
    return m.select(
        *by,
        col("n"),
        macro(f1).alias("macro_f1"),
        weighted.alias("weighted_f1"),
        macro(precision).alias("macro_precision"),
        macro(recall).alias("macro_recall"),
        kappa.alias("weighted_kappa"),
        (col("sad") / n).alias("ordinal_mae"),
        severe(f1[5]).alias("severe_f1"),
        severe(recall[5]).alias("severe_recall"),
        severe(precision[5]).alias("severe_precision"),
        col("tp5").alias("severe_tp"),
        (col("prd5") - col("tp5")).alias("severe_fp"),
        (col("act5") - col("tp5")).alias("severe_fn"),
        vtp,
        vfp,
        vfn,
        ratio(vtp, vtp + vfn).alias("vpoor_plus_recall"),
        ratio(vtp, vtp + vfp).alias("vpoor_plus_precision"),
        ratio(2 * vtp, 2 * vtp + vfp + vfn).alias("vpoor_plus_f1"),
        F.when(col("act5") > 0, col("critical") / col("act5")).alias("critical_miss_rate"),
    )


# ------------------------------------------------------------------------------------------------------------ ranking
def ranking_areas(df: DataFrame, by: Sequence[str], positive: Column, score: str) -> DataFrame:
    """AUROC (rank sum, ties averaged) and average precision (over distinct scores)."""
    rows = df.where(F.col(score).isNotNull() & positive.isNotNull()).select(*by, F.col(score).alias("score"), positive.cast("long").alias("hit"))
    c = value_counts(rows, by, "score", {"pos": F.col("hit")})
    rank = F.col("below") + (F.col("n") + 1) / 2.0
    tp = (F.col("pos_total") - F.col("pos_below")).cast("double")
    flagged = F.col("total") - F.col("below")
    sums = [
        F.max("pos_total").cast("double").alias("P"),
        F.max("total").cast("double").alias("T"),
        F.sum(rank * F.col("pos")).alias("ranks"),
        F.sum(F.col("pos") * tp / flagged).alias("gain"),
    ]
    a = c.groupBy(*by).agg(*sums) if by else c.agg(*sums)
    positives, negatives = F.col("P"), F.col("T") - F.col("P")
    auroc = F.when((positives > 0) & (negatives > 0), (F.col("ranks") - positives * (positives + 1) / 2) / (positives * negatives))
    return a.select(*by, positives.cast("long").alias("positives"), auroc.alias("auroc"), F.when(positives > 0, F.col("gain") / positives).alias("average_precision"))


# ---------------------------------------------------------------------------------------------------- threshold sweep
# Sweep grid, cost ratios of a miss to a false alarm, operating points.
SWEEP = (200.0, 500.0, 0.5)
COST_RATIOS = (1, 2, 3, 5, 10, 20)
OPERATING_POINTS = (401.0, 390.0, 380.0, 360.0, 341.0, 324.0, 300.0)


def _rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(1.0))
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
    fpr = F.when(fp + tn > 0, fp / (fp + tn)).otherwise(F.lit(0.0))
    fnr = F.when(tp + fn > 0, fn / (tp + fn)).otherwise(F.lit(0.0))
    return {"precision": precision, "recall": recall, "f1": f1, "fpr": fpr, "fnr": fnr}


def threshold_sweep(
    df: DataFrame, by: Sequence[str], actual: str, predicted: str, *, severe: float = 401.0, grid: tuple[float, float, float] = SWEEP, ratios: Sequence[int] = COST_RATIOS
) -> DataFrame:
    """Confusion, rates and costs at every threshold of the grid.

    Each score becomes the number of the highest threshold it passes; the rows are counted per number and summed from
    the top, so the table never meets the grid. ``by`` names report groups (split, model).
    """
    low, high, step = grid
    last = int(round((high - low) / step))
    y, s = F.col(actual), F.col(predicted)
    slot = F.greatest(F.lit(-1), F.least(F.lit(last), F.floor((s - low) / step).cast("int")))
    flags = {
        "pos": y >= severe,
        "neg": y < severe,
        "vpoor": y.between(301, 400),
        "poor": y.between(201, 300),
        "better": y <= 200,
    }
    ok = df.where(y.isNotNull() & s.isNotNull())
    counts = ok.groupBy(*by, slot.alias("slot")).agg(*[F.count_if(c).alias(k) for k, c in flags.items()])
    steps = ok.sparkSession.range(0, last + 1).select(F.col("id").cast("int").alias("slot"))
    groups = counts.select(*by).distinct() if by else None
    every = steps if groups is None else groups.select(*by, F.explode(F.sequence(F.lit(0), F.lit(last))).alias("slot"))
    filled = every.unionByName(counts.where("slot < 0").select(*by, "slot")).join(counts, [*by, "slot"], "left")
    down = Window.partitionBy(*by).orderBy(F.col("slot").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    names = list(flags)
    summed = filled.select(
        *by, "slot",
        *[F.coalesce(F.sum(c).over(down), F.lit(0)).alias(c) for c in names],
        *[F.coalesce(F.sum(c).over(whole), F.lit(0)).alias(f"{c}_all") for c in ("pos", "neg")],
    ).where("slot >= 0")
    tp, fp = F.col("pos"), F.col("neg")
    fn, tn = F.col("pos_all") - tp, F.col("neg_all") - fp
    rates = _rates(tp, fp, fn, tn)
    total = F.col("pos_all") + F.col("neg_all")
    costs = []
    for r in ratios:
        costs += [(rates["fpr"] + rates["fnr"] * r).alias(f"cost_rate_{r}x"), ((fp + fn * r) / total).alias(f"cost_sample_{r}x")]
    return summed.select(
        *by, (F.lit(low) + F.col("slot") * F.lit(step)).alias("threshold"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"),
        *[c.alias(k) for k, c in rates.items()], F.col("vpoor").alias("fp_actual_vpoor"), F.col("poor").alias("fp_actual_poor"), F.col("better").alias("fp_actual_mod_better"), *costs,
    )


def cost_optimal(sweep: DataFrame, by: Sequence[str], *, severe: float = 401.0, ratios: Sequence[int] = COST_RATIOS) -> DataFrame:
    """Cheapest threshold per cost ratio (lowest threshold on ties) against the cost at the official threshold."""
    cells = F.array(*[F.struct(F.lit(r).alias("ratio"), F.col(f"cost_rate_{r}x").alias("cost")) for r in ratios])
    long = sweep.select(*by, "threshold", F.inline(cells))
    picked = long.groupBy(*by, "ratio").agg(
        F.min(F.struct(F.round("cost", 12).alias("c"), "threshold", "cost")).alias("best"), F.max(F.when(F.col("threshold") == severe, F.col("cost"))).alias("official_cost")
    )
    best = F.col("best.cost")
    return picked.select(
        *by, "ratio", F.col("best.threshold").alias("optimal_threshold"), (F.col("best.threshold") - severe).alias("shift"), best.alias("cost_rate"), "official_cost",
        F.when(F.col("official_cost") > 0, 100 * (F.col("official_cost") - best) / F.col("official_cost")).alias("reduction_pct"),
    )


def apply_thresholds(chosen: DataFrame, sweep: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Thresholds chosen on one split looked up in the sweep of another (both lie on the same grid)."""
    look = sweep.select(*keys, F.col("threshold").alias("optimal_threshold"), "tp", "fp", "fn", "tn", "precision", "recall", "f1", "fpr", "fnr")
    return chosen.join(look, [*keys, "optimal_threshold"])


def operating_points(sweep: DataFrame, points: Sequence[float] = OPERATING_POINTS) -> DataFrame:
    """Rows of the sweep at the standard thresholds."""
    return sweep.where(F.col("threshold").isin(*[float(p) for p in points]))


# -------------------------------------------------------------------------------------------- intervals, calibration
def interval_scores(df: DataFrame, by: Sequence[str], actual: str, low: str, high: str, *, alpha_low: float = 0.1, alpha_high: float = 0.9) -> DataFrame:
    """Pinball losses of both quantiles, coverage and mean width."""

    def pinball(q: str, alpha: float) -> Column:
        d = F.col(actual) - F.col(q)
        return F.avg(F.greatest(alpha * d, (alpha - 1) * d))

    aggs = [
        F.count(F.lit(1)).alias("n"),
        pinball(low, alpha_low).alias("pinball_low"),
        pinball(high, alpha_high).alias("pinball_high"),
        F.avg(F.col(actual).between(F.col(low), F.col(high)).cast("double")).alias("coverage"),
        F.avg(F.col(high) - F.col(low)).alias("mean_width"),
    ]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def brier(outcome: str, probability: str) -> Column:
    d = F.col(probability) - F.col(outcome).cast("double")
    return F.avg(d * d)


def conformal_pad(df: DataFrame, by: Sequence[str], actual: str, low: str, high: str, level: float) -> DataFrame:
    """k-th smallest conformity score with k = ceil((n + 1) * level), at least 0; infinite when k exceeds n."""
    score = F.greatest(F.col(low) - F.col(actual), F.col(actual) - F.col(high))
    c = value_counts(df.select(*by, score.alias("score")), by, "score")
    k = F.ceil((F.col("total") + 1) * F.lit(level))
    aggs = [
        F.max("total").alias("n"),
        F.max(k).alias("k"),
        F.max(F.when((F.col("below") < k) & (k <= F.col("below") + F.col("n")), F.col("score"))).alias("kth"),
    ]
    a = c.groupBy(*by).agg(*aggs) if by else c.agg(*aggs)
    pad = F.when(F.col("k") > F.col("n"), F.lit(float("inf"))).otherwise(F.greatest(F.col("kth"), F.lit(0.0)))
    return a.select(*by, "n", "k", pad.alias("pad"))


def reliability_table(df: DataFrame, by: Sequence[str], outcome: str, probability: str, *, bins: int = 10) -> DataFrame:
    """Mean probability and observed rate per probability bin; empty bins are absent."""
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col(probability) * bins).cast("int")))
    return df.groupBy(*by, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(probability).alias("mean_predicted"), F.avg(F.col(outcome).cast("double")).alias("observed_rate")
    )


def persistence_band(train: DataFrame, rows: DataFrame, actual: str, current: str, *, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Current value plus the train residual quantiles; the two quantiles enter as scalars."""
    residuals = train.select((F.col(actual) - F.col(current)).alias("residual"))
    picked = cut_lineage(quantiles(residuals, [], "residual", {"low": low, "high": high}))
    pick = lambda name: picked.select(name).scalar()
    return rows.select("*", (F.col(current) + pick("low")).alias("band_low"), (F.col(current) + pick("high")).alias("band_high"))


def neighbourhood_rate(train: DataFrame, rows: DataFrame, value: str, outcome: str, out: str, *, radius: float = 25.0, block: float = 0.25) -> DataFrame:
    """Share of train rows within ``radius`` of the row's value that had the outcome, else the base rate.

    Counts up to any value come from cumulative distinct-value counts, so each distinct value needs two as-of lookups
    (upper edge inclusive, lower edge exclusive) in one ordered pass, not a range join with its neighbours. ``block`` is the width of
    the value ranges the lookups are spread over.
    """
    c = cut_lineage(value_counts(train, [], value, {"hit": F.col(outcome).cast("long")}))
    steps = c.select(F.col(value).alias("__at"), (F.col("below") + F.col("n")).alias("__n"), (F.col("hit_below") + F.col("hit")).alias("__h"))
    edges = F.array(F.struct(F.lit(True).alias("__up"), (F.col(value) + radius).alias("__x")), F.struct(F.lit(False).alias("__up"), (F.col(value) - radius).alias("__x")))
    asked = rows.where(F.col(value).isNotNull()).select(value).distinct().select(value, F.inline(edges))
    found = as_of(asked, steps, [], "__x", "__at", ["__n", "__h"], block=block, include_equal="__up")
    signed = lambda c: F.sum(F.when(F.col("__up"), F.col(c)).otherwise(-F.col(c)))
    near = found.groupBy(value).agg(F.coalesce(signed("__n"), F.lit(0)).alias("__near"), F.coalesce(signed("__h"), F.lit(0)).alias("__hits"))
    base = train.agg(F.avg(F.col(outcome).cast("double"))).scalar()
    rate = near.select(value, F.when(F.col("__near") > 0, F.col("__hits") / F.col("__near")).otherwise(base).alias(out))
    return rows.join(rate, value, "left")


def gate_level(df: DataFrame, value: str, *, percentile: float = 0.99) -> DataFrame:
    """Percentile of a share rounded up to two decimals."""
    picked = quantiles(df, [], value, {"raw": percentile})
    return picked.select("raw", (F.ceil(F.col("raw") * 100) / 100).alias("gate"))


def missing_share(columns: Sequence[str]) -> Column:
    """Share of the core columns that are missing in a row."""
    return sum((F.col(c).isNull().cast("double") for c in columns), F.lit(0.0)) / len(columns)


