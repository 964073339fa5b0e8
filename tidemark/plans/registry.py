"""The list of runnable queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Build
    sql: str | None


QUERIES: dict[str, Query] = {}


# share of the last kept digit added before rounding: averages of cents fall on
# exact decimal halves, which float noise would send to either side
NUDGE = 0.3718281


def _nudge(digits: int) -> float:
    return NUDGE * 10.0**-digits


def _spark_round(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    def cell(c: str):
        return (F.round(F.col(c) + F.lit(_nudge(digits[c])), digits[c]) + 0.0).alias(c)

    return df.select(*[cell(c) if c in digits else F.col(c) for c in df.columns])


def _sql_round(sql: str, digits: dict[str, int]) -> str:
    if not digits:
        return sql
    cells = ", ".join(f"round({c} + CAST({_nudge(d)!r} AS DOUBLE), {d}) + 0.0 AS {c}" for c, d in digits.items())
    return f"SELECT * REPLACE ({cells}) FROM ({sql})"


def query(name: str, sql: str | None = None, digits: dict[str, int] | None = None, six: tuple[str, ...] | list[str] = ()):
    """Register a query.  Both twins round the named double columns for comparison."""
    places = {**{c: 6 for c in six}, **(digits or {})}

    def register(build: Build) -> Build:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return _spark_round(build(spark, sf), places)

        QUERIES[name] = Query(run, _sql_round(sql, places) if sql else None)
        return build

    return register
