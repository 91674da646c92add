"""A small book of queries: the function and, where SQL can express it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cachelens.plans.views import oracle


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, *views: str):  # noqa: ANN201
        """Decorator: register a query; `views` are the carrier views that the SQL reads."""

        def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
            self.queries[name] = f
            if sql is not None:
                self.oracles[name] = oracle(sql, *views)
            return f

        return put
