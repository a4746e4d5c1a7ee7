"""Registry of named queries with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.plans.views import with_views
from tapeworks.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` names the views it needs, which are put in front of it."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir.rstrip("/"))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = with_views(sql)
        return fn

    return register


def stamp(column: str | Column = "ts") -> Column:
    """Text form of an instant, the same in both engines."""
    column = F.col(column) if isinstance(column, str) else column
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def sql_stamp(column: str = "ts") -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


def rounded(
    columns: dict[str, int] | list[str], digits: int = 4, *, nudge: bool = False
) -> list[Column]:
    """Doubles at a fixed number of places. ``nudge`` lifts exact halves, which a sum in another
    order may place on either side, well above the half in both engines."""
    pairs = columns.items() if isinstance(columns, dict) else [(c, digits) for c in columns]
    # Adding zero turns a rounded -0.0 into 0.0.
    return [
        (
            F.round(F.col(c).cast("double") + F.lit(10.0 ** -(d + 4) if nudge else 0.0), d)
            + F.lit(0.0)
        ).alias(c)
        for c, d in pairs
    ]


def sql_nudged(value: str, digits: int) -> str:
    return f"round({value} + 1e-{digits + 4}::DOUBLE, {digits}) + 0.0::DOUBLE"


def sql_rounded(columns: list[str], digits: int = 4) -> str:
    return ", ".join(
        f"round(CAST({c} AS DOUBLE), {digits}) + 0.0::DOUBLE AS {c}" for c in columns
    )
