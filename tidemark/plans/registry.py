"""The queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers fn(t), where t(name) is a table, under the function's name; other queries build on it as query.of(t)."""

    def add(fn) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda name: read(spark, sf_dir, name))

        run.__doc__, run.of = fn.__doc__, fn
        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return run

    return add


def r(x: Column | str, digits: int = 6) -> Column:
    """A double rounded for comparison with other engines."""
    return F.round((F.col(x) if isinstance(x, str) else x).cast("double"), digits)
