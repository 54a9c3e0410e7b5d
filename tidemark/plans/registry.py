"""All registered queries of the flood engine: each applies an operator to views of the driver's tables."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.fixtures import Tables, duckdb

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of Tables under a name, with DuckDB SQL for the same rows."""

    def keep(f: Callable[[Tables], DataFrame]) -> Callable:
        _queries[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            _oracles[name] = duckdb(sql)
        return f

    return keep


def _load() -> None:
    import tidemark.plans as plans

    for module in pkgutil.iter_modules(plans.__path__):
        if module.name.startswith("q_"):
            importlib.import_module(f"tidemark.plans.{module.name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)
