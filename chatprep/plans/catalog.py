"""Registry of queries over the test tables and of the SQL they are checked with."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chatprep.session import INPUT_PARTITIONS

# Tables whose rows cost much more to process than to move.
HEAVY = {"documents", "lineitem"}

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


class Tables:
    """Lazy access to the Parquet tables of a directory."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.tables: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("__"):
            raise AttributeError(name)
        if name not in self.tables:
            df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            parts = self.spark.conf.get(INPUT_PARTITIONS, None)
            self.tables[name] = df.repartition(int(parts)) if parts and name in HEAVY else df
        return self.tables[name]


def query(sql: str | None = None, name: str | None = None):
    """Register ``fn(tables)`` under its name, with the SQL that must agree."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        key = name or fn.__name__
        if key in _QUERIES:
            raise ValueError(f"query {key!r} is registered twice")
        _QUERIES[key] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            _SQL[key] = sql
        return fn

    return wrap


def _load() -> None:
    import chatprep.plans.checks as checks

    for module in pkgutil.iter_modules(checks.__path__):
        importlib.import_module(f"{checks.__name__}.{module.name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
