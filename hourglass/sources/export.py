"""Published datasets: partitioned parquet with statistics, public CSV, and their validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def write_matrix(df: DataFrame, folder: str, *, partition: Sequence[str] = ("split",), sort: Sequence[str] = ()) -> None:
    """Parquet partitioned by split. Rows are spread by a second key so a large split is written by many tasks."""
    rows = df.sortWithinPartitions(*partition, *sort) if sort else df
    rows.write.mode("overwrite").partitionBy(*partition).parquet(folder)


def horizon_dataset(matrix: DataFrame, target: str, groups: Mapping[str, Sequence[str]], *, meta: Sequence[str]) -> DataFrame:
    """Rows with the horizon's target, columns ordered by feature group, the target last."""
    ordered = [c for cols in groups.values() for c in cols]
    return matrix.where(F.col(target).isNotNull()).select(*meta, *ordered, target)


def dataset_manifest(dataset: DataFrame, split: str, target: str, features: int) -> DataFrame:
    """Rows and target range per split, with the number of features."""
    return dataset.groupBy(split).agg(F.count(F.lit(1)).alias("rows"), F.lit(features).alias("features"), F.min(target).alias("target_min"), F.max(target).alias("target_max"))


def public_rows(df: DataFrame, columns: Sequence[str], ts: str, *, flags: str | None = None, zone_suffix: str = "+05:30") -> DataFrame:
    """Public columns only: ISO timestamps with offset, flags as JSON (empty when clean)."""
    iso = F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(zone_suffix)).alias(ts)
    cells = [iso if c == ts else F.coalesce(F.to_json(c), F.lit("")).alias(c) if c == flags else F.col(c) for c in columns]
    return df.select(*cells)


def write_public_csv(rows: DataFrame, folder: str, order: Sequence[str]) -> None:
    """Globally ordered CSV as many part files: range partitions by the order keys, sorted inside each."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(folder)


def validate_export(df: DataFrame, *, rows: int | None = None, columns: Sequence[str] | None = None, keys: Sequence[str] = (), ranges: Mapping[str, tuple[float, float]] | None = None, foreign: Mapping[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """Check table (check, failures): row count, column list, ranges, duplicate keys, foreign keys.

    Ranges and the count are one aggregation; keys and each foreign key are one grouped pass or anti join.
    """
    spark = df.sparkSession
    aggs: dict[str, Column] = {}
    if rows is not None:
        aggs["row_count"] = F.abs(F.count(F.lit(1)) - rows)
    for c, (lo, hi) in (ranges or {}).items():
        aggs[f"range:{c}"] = F.count_if((F.col(c) < lo) | (F.col(c) > hi))
    out = None
    if aggs:
        one = df.agg(*[a.cast("long").alias(n) for n, a in aggs.items()])
        cells = F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"`{n}`").alias("failures")) for n in aggs])
        out = one.select(F.inline(cells))
    parts = []
    if columns is not None:
        wrong = int(list(columns) != df.columns)
        parts.append(spark.range(1).select(F.lit("columns").alias("check"), F.lit(wrong).cast("long").alias("failures")))
    if keys:
        repeated = df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("extra"))
        parts.append(repeated.agg(F.sum("extra").alias("failures")).select(F.lit("duplicate_keys").alias("check"), "failures"))
    for c, (dim, key) in (foreign or {}).items():
        lost = df.where(F.col(c).isNotNull()).join(dim.select(F.col(key).alias(c)).distinct(), c, "left_anti")
        parts.append(lost.agg(F.count(F.lit(1)).alias("failures")).select(F.lit(f"foreign:{c}").alias("check"), "failures"))
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out.withColumn("ok", F.col("failures") == 0)
