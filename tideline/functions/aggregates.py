"""Aggregate functions; all run as partial and final aggregation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def count(x: Column | None = None) -> Column:
    """Rows, or rows where ``x`` is not null."""
    return F.count(F.lit(1)) if x is None else F.count(x)


AGGREGATES: dict[str, Callable[..., Column]] = {
    "count": count,
    "count_distinct": F.count_distinct,
    "sum": F.sum,
    "mean": F.avg,
    "avg": F.avg,
    "max": F.max,
    "min": F.min,
    "approx_count_distinct": F.approx_count_distinct,
}


def within_record(name: str, values: Column, whole: bool = False) -> Column:
    """An aggregate over one record's repeated values, without leaving its row; ``whole``: they are integers, and so is their sum."""
    present = F.filter(values, lambda v: v.isNotNull())
    some = F.size(present) > 0
    total = lambda: F.aggregate(F.transform(present, lambda v: v.cast("double")), F.lit(0.0), lambda a, v: a + v)
    if name == "count":
        return F.coalesce(F.size(present), F.lit(0)).cast("bigint")
    if name == "count_distinct":
        return F.size(F.array_distinct(present)).cast("bigint")
    if name in ("mean", "avg"):
        return F.when(some, total() / F.size(present))
    if name == "sum" and whole:
        return F.when(some, F.aggregate(F.transform(present, lambda v: v.cast("bigint")), F.lit(0).cast("bigint"), lambda a, v: a + v))
    return {"sum": F.when(some, total()), "max": F.array_max(present), "min": F.array_min(present)}[name]
