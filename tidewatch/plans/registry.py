"""Registering queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Registry:
    def __init__(self):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable:
        def register(f: Callable) -> Callable:
            def run(spark, sf_dir):
                return wide(f(spark, sf_dir))

            run.__doc__, run.__name__ = f.__doc__, f.__name__
            self.queries[f.__name__] = run
            if sql:
                self.sql[f.__name__] = sql
            return run

        return register


def wide(df: DataFrame) -> DataFrame:
    """Integers as long and float as double, so that results have one type in any engine."""
    to = {"int": "long", "smallint": "long", "tinyint": "long", "float": "double"}
    return df.select(*[F.col(f"`{c}`").cast(to[t]).alias(c) if t in to else F.col(f"`{c}`") for c, t in df.dtypes])
