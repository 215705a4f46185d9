"""The registered queries: a Spark plan each, and the same question as SQL where SQL can ask it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; NaN becomes NULL and -0.0 becomes 0.0."""
    c = F.col(c) if isinstance(c, str) else c
    c = c.cast("double")
    return F.when(~F.isnan(c), F.round(c, digits) + 0.0)


def rs(expr: str, digits: int = 6) -> str:
    return f"CASE WHEN NOT isnan(({expr})::DOUBLE) THEN round(({expr})::DOUBLE, {digits}) + 0e0 END"


def big(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


def bigs(*names: str) -> str:
    return ", ".join(f"{n}::BIGINT AS {n}" for n in names)
