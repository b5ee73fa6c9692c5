"""Boolean and comparison functions, with ANSI nulls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

eq = lambda a, b: a == b
neq = lambda a, b: a != b
lt = lambda a, b: a < b
lte = lambda a, b: a <= b
gt = lambda a, b: a > b
gte = lambda a, b: a >= b
logical_and = lambda a, b: a & b
logical_or = lambda a, b: a | b
negation = lambda a: ~a


def cmp(a: Column, b: Column) -> Column:
    """-1, 0 or 1 as ``a`` is less than, equal to or greater than ``b``."""
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0).cast("bigint")


def isnull(a: Column) -> Column:
    return a.isNull()


def if_(condition: Column, yes: Column, no: Column) -> Column:
    return F.when(condition, yes).otherwise(no)
