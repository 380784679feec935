"""Where the query modules put their queries and oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    """Registers a function of a table reader: ``f(t)``, where ``t("orders")`` is a table."""

    def put(f):  # noqa: ANN001, ANN202
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return f

    return put
