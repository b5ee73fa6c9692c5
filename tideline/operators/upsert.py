"""Rows by primary key: the latest version of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VERSION, SEQUENCE = "_version", "_seq"


def latest(df: DataFrame, key: list[str], version: list[str] | None = None) -> DataFrame:
    """One row per key: the one of the highest version (the last of ``version`` breaks ties).

    Spark keeps the first of each key before the shuffle too, so versions that lie together cost one row there.
    """
    order = [F.col(v).desc_nulls_last() for v in version or [VERSION, SEQUENCE]]
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_rank = 1").drop("_rank")


def merge(base: DataFrame, changes: DataFrame, key: list[str], version: str) -> DataFrame:
    """``base`` with ``changes`` applied; a change of an equal or higher version wins."""
    both = base.withColumn("_late", F.lit(0)).unionByName(changes.withColumn("_late", F.lit(1)))
    return latest(both, key, [version, "_late"]).drop("_late")
