"""Named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.functions.numeric import rounded

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def report(df: DataFrame, digits: int = 8, special: dict[str, int] | None = None) -> DataFrame:
    """Comparable output: rounded doubles, bigint integers, zone-less timestamps.

    ``special`` holds the digits of columns on another scale (a price has fewer true decimals).
    """
    columns = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("double", "float"):
            c = rounded(c.cast("double"), (special or {}).get(name, digits))
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif kind == "timestamp":
            c = c.cast("timestamp_ntz")
        columns.append(c.alias(name))
    return df.select(*columns)
