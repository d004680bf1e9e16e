"""Registry of bound queries.

A query is a function of ``Tables``; ``sql`` states the same result for any engine reading the same parquet files.
Floating-point columns named in ``rounded`` are rounded on both sides, in the final select only, after a nudge far below
the last kept digit so that an exact half falls the same way whatever the summation order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

NUDGE = 1e-9


@dataclass(frozen=True)
class Tables:
    """Lazy parquet readers for one data folder."""

    spark: SparkSession
    path: str

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None
    rounded: tuple[str, ...]
    digits: int

    def run(self, spark: SparkSession, path: str) -> DataFrame:
        df = self.build(Tables(spark, path))
        if not self.rounded:
            return df
        tidy = {c: F.round(F.col(c).cast("double") + NUDGE, self.digits) for c in self.rounded}
        return df.select(*[tidy[c].alias(c) if c in tidy else F.col(c) for c in df.columns])

    def oracle(self) -> str | None:
        if self.sql is None or not self.rounded:
            return self.sql
        tidy = ", ".join(f"round({c}::DOUBLE + {NUDGE}, {self.digits}) AS {c}" for c in self.rounded)
        return f"SELECT * REPLACE ({tidy}) FROM ({self.sql}) AS q"


CATALOG: dict[str, Query] = {}


def query(name: str, sql: str | None = None, rounded: str = "", digits: int = 6):
    """Register a bound query under ``name``."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in CATALOG:
            raise ValueError(f"query {name} is registered twice")
        CATALOG[name] = Query(name, build, sql, tuple(rounded.split()), digits)
        return build

    return register


def load_all() -> dict[str, Query]:
    """Import every module of bound queries and return the registry."""
    from importlib import import_module

    for module in MODULES:
        import_module(f"hourglass.plans.{module}")
    return CATALOG


MODULES: list[str] = ["index_queries", "feature_queries", "cleaning_queries", "table_queries", "report_queries", "score_queries", "class_queries", "service_queries", "model_queries", "feed_queries"]
