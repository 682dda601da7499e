"""Registration of queries with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F


class Registry:
    """Queries and oracles of one module."""

    def __init__(self):
        self.queries, self.oracles = {}, {}

    def __call__(self, name: str, oracle: str | None = None):
        def add(query):
            self.queries[name] = query
            if oracle is not None:
                self.oracles[name] = oracle
            return query

        return add


def num(column: str, alias: str | None = None):
    """Number as double."""
    return F.col(column).cast("double").alias(alias or column.split(".")[-1])


def stamp(column: str, alias: str | None = None):
    """Timestamp as text."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(alias or column.split(".")[-1])


def stamp_sql(column: str, alias: str | None = None) -> str:
    """Timestamp as text in the oracle."""
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') AS {alias or column.split('.')[-1]}"


def joined(column: str, alias: str | None = None):
    """Text array as one text."""
    return F.array_join(column, "|").alias(alias or column)
