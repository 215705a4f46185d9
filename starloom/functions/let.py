"""Naming an intermediate value inside an expression.

A Column used twice is two copies of its tree, so formulas built on formulas grow
without bound. ``let`` binds the value once as a lambda variable. Lambdas are evaluated
outside generated code, so it is for nested formulas; a flat one stays plain.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pack(**parts: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in parts.items()])
