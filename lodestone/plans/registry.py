"""Registry of queries: a Spark callable and, where SQL can say it, the same result as SQL text."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            assert name not in self.queries, name

            @functools.wraps(f)
            def run(spark: SparkSession, root: str) -> DataFrame:
                ship(spark)
                return f(spark, root)

            self.queries[name] = run
            if sql:
                self.sql[name] = sql
            return f

        return put
