"""Registry of named queries: a Spark plan over the given tables plus its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Session setting for tests and benchmarks: deal text tables that sit in one row group to so many tasks.
SPREAD = "factloom.spread.text.tables"
# Tables whose queries do heavy work per row.
TEXT_TABLES = {"documents", "pages", "conversations", "part"}


class Tables:
    """Lazy access to the parquet tables of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        parts = self.spark.conf.get(SPREAD, None)
        return table.repartition(int(parts)) if parts and name in TEXT_TABLES else table


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a function of :class:`Tables` under ``name`` with its SQL twin."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(lambda spark, sf_dir: fn(Tables(spark, sf_dir)), sql)
        return fn

    return register
