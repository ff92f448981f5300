"""One query per operator over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trialgrid.queries import configs, datasets, inventories, logs, parameters, sweeps

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = (sweeps, datasets, parameters, inventories, logs, configs)


def queries() -> dict[str, Query]:
    return {name: query for module in _MODULES for name, (query, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, (_, sql) in module.QUERIES.items() if sql}
