"""Ridge fits from additive cross products: one pass over the rows serves every fold, panel, subset, penalty and horizon.

A row becomes the vector (1, values with 0 for gaps, marks of the gaps, target), and the sums of its products are kept per group of
rows. Such sums add up over groups, so an expanding train set is a prefix sum; a feature subset is a sub-matrix; a penalty
is added to the diagonal; and the medians that fill gaps enter afterwards, since a filled value is the value plus the median times
the mark. What reaches the driver is one matrix per (group, target), whatever the number of rows; solving k x k is all it does.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .ranks import wide_quantiles


class LinearModel(NamedTuple):
    """Coefficients on raw features, and what fills their gaps."""

    features: tuple[str, ...]
    coef: tuple[float, ...]
    intercept: float
    medians: tuple[float, ...]

    def _terms(self) -> Iterator[tuple[str, float, float, Column]]:
        for name, b, m in zip(self.features, self.coef, self.medians, strict=True):
            value = F.col(name).cast("double")
            yield name, b, m, F.coalesce(F.when(~F.isnan(value), value), F.lit(m))

    def expr(self) -> Column:
        """The prediction as a column."""
        return sum((F.lit(b) * value for _, b, _, value in self._terms()), F.lit(self.intercept))

    def change(self, lost: Mapping[str, Column]) -> Column:
        """What the prediction changes by where features are lost and filled like gaps."""
        terms = [F.when(lost[name], F.lit(b) * (F.lit(m) - value)).otherwise(0.0) for name, b, m, value in self._terms() if name in lost]
        return sum(terms, F.lit(0.0))


class CrossProducts(NamedTuple):
    features: tuple[str, ...]
    shift: np.ndarray
    sums: dict[tuple[str, str], np.ndarray]

    def filled(self, groups: Iterable[str], target: str, medians: Sequence[float]) -> np.ndarray:
        """Products of (1, filled and shifted features, target), added up over groups."""
        k = len(self.features)
        total = sum((self.sums[g, target] for g in groups if (g, target) in self.sums), np.zeros((2 * k + 2, 2 * k + 2)))
        put = np.zeros((k + 2, 2 * k + 2))
        put[0, 0] = put[-1, -1] = 1.0
        put[1 : k + 1, 1 : k + 1] = np.eye(k)
        put[1 : k + 1, k + 1 : 2 * k + 1] = np.diag(np.asarray(medians) - self.shift)
        return put @ total @ put.T

    def ridge(self, groups: Iterable[str], target: str, medians: Mapping[str, float], subset: Sequence[str] | None = None, *, alpha: float) -> tuple[LinearModel, int]:
        """Ridge on z-scores (population deviation; constant features count as 0) and the number of rows it was fitted on.

        No rows raise: there is nothing to fit. A feature that is missing in all rows has median 0 and coefficient 0.
        """
        names = list(self.features if subset is None else subset)
        fill = np.array([0.0 if medians.get(c) is None else medians[c] for c in self.features])
        full = self.filled(groups, target, fill)
        n = full[0, 0]
        if n < 1:
            raise ValueError(f"no rows with {target} to fit on")
        at = [1 + self.features.index(c) for c in names]
        mean, ybar = full[0, at] / n, full[0, -1] / n
        cov = full[np.ix_(at, at)] / n - np.outer(mean, mean)
        spread = np.sqrt(np.maximum(np.diag(cov), 0.0))
        scale = np.where(spread > 1e-9 * np.maximum(1.0, np.abs(mean)), spread, np.inf)
        system = n * cov / np.outer(scale, scale) + alpha * np.eye(len(at))
        weights = np.linalg.solve(system, n * (full[at, -1] / n - mean * ybar) / scale)
        coef = weights / scale
        used = np.array([self.features.index(c) for c in names], int)
        intercept = ybar - coef @ (mean + self.shift[used])
        return LinearModel(tuple(names), tuple(coef.tolist()), float(intercept), tuple(fill[used].tolist())), int(round(n))


def medians(rows: DataFrame, by: str, features: Sequence[str]) -> dict[str, dict[str, float]]:
    """Exact medians of the features per value of ``by`` (few): value -> feature -> median."""
    plain = rows.select(by, *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in features])
    found = wide_quantiles(plain, [by], {c: (c, 0.5) for c in features})
    return {r[by]: {c: r[c] for c in features} for r in found.collect()}


def cross_products(rows: DataFrame, features: Sequence[str], targets: Sequence[str], group: Column, shift: Mapping[str, float]) -> CrossProducts:
    """Sums of products per (group, target) in one pass; ``group`` is a string of few values, ``shift`` a typical value per feature.

    Rows without a target (NULL or NaN) do not count for it. Each task adds up its own matrices with one product per batch and
    target; tasks are added up cell by cell with map-side combine.
    """
    import pyarrow as pa

    names, wanted, k = list(features), list(targets), len(features)
    middle = np.array([0.0 if shift.get(c) is None else shift[c] for c in names])
    upper = np.triu_indices(2 * k + 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], np.ndarray] = {}
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(1, batch.num_columns)]
            x = np.column_stack(columns[:k]) if k else np.zeros((batch.num_rows, 0))
            gap = np.isnan(x)
            z = np.column_stack([np.ones(len(x)), np.where(gap, 0.0, x - middle), gap])
            codes = np.array(batch.column(0).to_pylist(), dtype=object)
            for code in set(codes.tolist()):
                for t, y in zip(wanted, columns[k:], strict=True):
                    mine = (codes == code) & ~np.isnan(y)
                    if mine.any():
                        part = np.column_stack([z[mine], y[mine]])
                        held[code, t] = held.get((code, t), 0.0) + part.T @ part
        if held:
            cells = [pa.array([m[upper].tolist() for m in held.values()], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in held]), pa.array([t for _, t in held]), *cells], names=["code", "target", "cells"])

    source = rows.select(group.cast("string").alias("code"), *[F.col(c).cast("double") for c in [*names, *wanted]]).where("code IS NOT NULL")
    parts = source.mapInArrow(run, "code string, target string, cells array<double>")
    added = parts.select("code", "target", F.posexplode("cells").alias("pos", "v")).groupBy("code", "target", "pos").agg(F.sum("v").alias("v"))
    sums: dict[tuple[str, str], np.ndarray] = {}
    for r in added.collect():  # groups x targets x matrix cells, whatever the number of rows
        m = sums.setdefault((r.code, r.target), np.zeros((2 * k + 2, 2 * k + 2)))
        i, j = upper[0][r.pos], upper[1][r.pos]
        m[i, j] = m[j, i] = r.v
    return CrossProducts(tuple(names), middle, sums)
