"""Register of queries: name, Spark function, SQL that gives the same rows."""
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under a name."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is there already")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def stamped(rows: DataFrame, *columns: str) -> DataFrame:
    """Times as text, to the second."""
    return rows.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in columns or ("timestamp",)})


def joined(items: Column, sep: str = "|") -> Column:
    return F.array_join(F.transform(items, lambda x: x.cast("string")), sep)


def load() -> None:
    """Import every module that registers queries."""
    from . import (queries_cases, queries_flows, queries_learning, queries_reads, queries_search,  # noqa: F401
                   queries_streams)
