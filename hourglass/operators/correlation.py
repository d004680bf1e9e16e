"""Correlations: measure pairs, station pairs, autocorrelation, distribution summaries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .grid import HOUR
from .lineage import cut_lineage
from .ordered import BLOCK_ROWS, row_index, with_frames
from .ranks import quantiles, value_counts

PAIR = ["left", "right"]


def measure_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Complete pairs (left, right, x, y), exploded inside the row; the number of pairs is a list of column names."""
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
            for a, b in pairs
        ]
    )
    return df.select(F.inline(cells)).where("x IS NOT NULL AND y IS NOT NULL")


def _corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation with an undefined value as NULL."""
    r = F.corr(x, y)
    return F.when(~F.isnan(r), r)


def pearson(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pearson correlation over pairwise complete rows."""
    return measure_pairs(df, pairs).groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"), _corr("x", "y").alias("pearson"))


def spearman(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Spearman correlation with average-tie ranks over pairwise complete rows.

    Equal (x, y) cells are counted first, so a value repeated by a third of the rows is one weighted cell per partner.
    """
    cells = measure_pairs(df, pairs).groupBy(*PAIR, "x", "y").agg(F.count(F.lit(1)).alias("w"))

    def ranks(value: str) -> DataFrame:
        counted = value_counts(cells, PAIR, value, weight=F.col("w"))
        centred = F.col("below") + (F.col("n") + 1) / 2.0 - (F.col("total") + 1) / 2.0
        return counted.select(*PAIR, value, centred.alias(f"r{value}"))

    ranked = cells.join(ranks("x"), [*PAIR, "x"]).join(ranks("y"), [*PAIR, "y"])
    w, rx, ry = F.col("w"), F.col("rx"), F.col("ry")
    sums = ranked.groupBy(*PAIR).agg(F.sum(w * rx * ry).alias("xy"), F.sum(w * rx * rx).alias("xx"), F.sum(w * ry * ry).alias("yy"))
    defined = (F.col("xx") > 0) & (F.col("yy") > 0)
    return sums.select(*PAIR, F.when(defined, F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).alias("spearman"))


def correlation_table(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Both coefficients per pair of measures."""
    return pearson(df, pairs).join(spearman(df, pairs), PAIR)


def station_correlation(df: DataFrame, entity: str, ts: str, value: str, *, per_block: int = 256) -> DataFrame:
    """Pearson correlation between every two stations over their common hours.

    Stations are hashed into blocks and time into months. A task sees one month of two station blocks as a matrix and
    returns the co-moments of its station pairs, so pairs are formed per month by matrix products, never per hour.
    """
    clean = df.where(F.col(value).isNotNull()).select(F.col(entity).alias("e"), F.col(ts).alias("t"), F.col(value).cast("double").alias("v"))
    mean = clean.agg(F.avg("v").alias("m")).scalar()
    blocks = clean.agg(F.greatest(F.lit(1), F.ceil(F.count_distinct("e") / per_block)).cast("int").alias("n")).scalar()
    rows = clean.select("e", "t", (F.col("v") - mean).alias("v"), F.date_trunc("month", "t").alias("month"), blocks.alias("nb"))
    rows = rows.withColumn("home", F.pmod(F.xxhash64("e"), F.col("nb")).cast("int"))
    spread = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    keyed = spread.select("e", "t", "v", "month", "home", F.least("home", "other").alias("bi"), F.greatest("home", "other").alias("bj"))
    kind = df.schema[entity].dataType.simpleString()
    schema = f"left {kind}, right {kind}, n double, sx double, sy double, sxx double, syy double, sxy double"
    parts = keyed.groupBy("month", "bi", "bj").applyInPandas(_comoments, schema)
    sums = parts.groupBy("left", "right").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    n = F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    vy = F.col("syy") - F.col("sy") * F.col("sy") / n
    return sums.select("left", "right", n.cast("long").alias("hours"), F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)).alias("r"))


def _comoments(pdf: pd.DataFrame) -> pd.DataFrame:
    """Co-moments of the station pairs of one month and two station blocks."""
    wide = pdf.drop_duplicates(["e", "t"]).pivot(index="t", columns="e", values="v").sort_index(axis=1)
    home = pdf.drop_duplicates("e").set_index("e")["home"].reindex(wide.columns).to_numpy()
    bi, bj = int(pdf["bi"].iloc[0]), int(pdf["bj"].iloc[0])
    present = wide.notna().to_numpy(dtype=float)
    x = wide.fillna(0.0).to_numpy(dtype=float)
    x2 = x * x
    pieces = [present.T @ present, x.T @ present, present.T @ x, x2.T @ present, present.T @ x2, x.T @ x]
    i, j = np.triu_indices(len(home), k=1)
    wanted = np.ones(len(i), dtype=bool) if bi == bj else home[i] != home[j]
    i, j = i[wanted & (pieces[0][i, j] > 0)], j[wanted & (pieces[0][i, j] > 0)]
    names = wide.columns.to_numpy()
    out = {"left": names[i], "right": names[j]}
    out.update({c: m[i, j] for c, m in zip(("n", "sx", "sy", "sxx", "syy", "sxy"), pieces, strict=True)})
    return pd.DataFrame(out)


def autocorrelation(df: DataFrame, by: Sequence[str], value: str, lags: Sequence[int], *, block: int = BLOCK_ROWS) -> DataFrame:
    """Correlation of a series with itself ``k`` *observed* rows earlier, per entity and lag."""
    observed = row_index(df.where(F.col(value).isNotNull()).select(*by, HOUR, value), by, HOUR, "__row")
    build = lambda f: {f"__lag{k}": f.at(value, -k) for k in lags}
    framed = with_frames(observed, by, "__row", build, behind=max(lags), block=block)
    cells = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"__lag{k}").alias("past")) for k in lags])
    long = framed.select(*by, value, F.inline(cells)).where("past IS NOT NULL")
    return long.groupBy(*by, "lag").agg(F.count(F.lit(1)).alias("pairs"), _corr(value, "past").alias("autocorrelation"))


def distribution_summary(df: DataFrame, columns: Sequence[str], *, against: dict[str, str] | None = None) -> DataFrame:
    """Count, moments, exact percentiles, bias-corrected skewness and kurtosis per measure, with reference correlations.

    ``against`` maps an output name to a reference column, e.g. {"pm25_corr": "pm25"}.
    """
    refs = dict(against or {})
    cells = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in columns])
    long = df.select(*[F.col(c).cast("double").alias(f"__{o}") for o, c in refs.items()], F.inline(cells)).where("v IS NOT NULL")
    long = cut_lineage(long)  # read by the moments and twice by the percentiles
    n = F.count(F.lit(1))
    skew = F.skewness("v") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis("v") + 6)
    base = long.groupBy("measure").agg(
        n.alias("n"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
        F.min("v").alias("minimum"),
        F.max("v").alias("maximum"),
        skew.alias("skewness"),
        kurt.alias("kurtosis"),
        *[_corr("v", f"__{o}").alias(o) for o in refs],
    )
    probs = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    return base.join(quantiles(long, ["measure"], "v", probs), "measure")


def usability(df: DataFrame, columns: Sequence[str], *, pm25: str, index: str, high: int, never_high: Sequence[str] = ("rainfall",), moderate: Sequence[str] = ("barometric_pressure",)) -> DataFrame:
    """Availability share of each weather column, its four correlations and a label."""
    cells = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("v")) for c in columns])
    n = F.count(F.lit(1))
    df = cut_lineage(df.select(*dict.fromkeys([*columns, pm25, index])))
    avail = df.select(F.inline(cells)).groupBy("measure").agg(F.count("v").alias("available"), (100.0 * F.count("v") / n).alias("available_pct"))
    out = avail
    for ref, tag in ((pm25, "pm25"), (index, "index")):
        pair = correlation_table(df, [(c, ref) for c in columns if c != ref]).select(
            F.col("left").alias("measure"), F.col("pearson").alias(f"{tag}_pearson"), F.col("spearman").alias(f"{tag}_spearman")
        )
        out = out.join(pair, "measure", "left")
    name = F.col("measure")
    label = F.when((F.col("available") > high) & ~name.isin(*never_high), "High").when(name.isin(*moderate), "Moderate").otherwise("Low/Sparse")
    return out.withColumn("usability", label)


