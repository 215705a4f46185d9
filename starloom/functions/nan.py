"""NaN marks a pixel without data; SQL NULL marks a row that is not there.

Spark's aggregates do not skip NaN, so every aggregate over pixels goes through
:func:`finite`, which turns NaN and infinities into NULL first.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

INF = float("inf")
NAN = float("nan")


def is_finite(v: Column) -> Column:
    return ~F.isnan(v) & (F.abs(v) != F.lit(INF))


def finite(v: Column) -> Column:
    """``v`` where finite, else NULL."""
    return F.when(is_finite(v), v)


def finite_sum(v: Column) -> Column:
    return F.sum(finite(v).cast("double"))


def finite_count(v: Column) -> Column:
    return F.count(finite(v))


def mean_or_nan(total: Column, n: Column) -> Column:
    """float32 mean of an accumulated (sum, count) pair, NaN for an empty block."""
    return F.when(n > 0, total / n).otherwise(F.lit(NAN)).cast("float")
