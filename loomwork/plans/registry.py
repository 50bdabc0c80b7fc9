"""Queries by name, each with the SQL that DuckDB runs beside it where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwork.plans.views import Run, sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Callable[[Run], DataFrame]], Callable[[Run], DataFrame]]:
    """Registers a function from a run to a DataFrame under its own name. oracle: SQL over the views of a run."""

    def register(f: Callable[[Run], DataFrame]) -> Callable[[Run], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Run(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = sql(oracle)
        return f

    return register
