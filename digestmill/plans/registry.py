"""Registry of queries: a Spark callable and, where SQL can say it, the same result as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from digestmill.plans.bindings import duck
from digestmill.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query under a name; its oracle may use the bound views."""

    def register(function: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(prepare(spark), sf_dir)

        run.__name__ = name
        run.__doc__ = function.__doc__
        run.__wrapped_module__ = function.__module__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = duck(oracle)
        return function

    return register
