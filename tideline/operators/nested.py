"""Repeated values: rows for them, and aggregates inside a record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def repeated_root(schema: T.StructType, parts: list[str]) -> list[str] | None:
    """The leading part of a path that names a repeated column, if one does."""
    here: T.DataType = schema
    for i, p in enumerate(parts):
        if isinstance(here, T.ArrayType):
            return parts[:i]
        if not isinstance(here, T.StructType):
            return None
        field = next((f for f in here.fields if f.name.lower() == p.lower()), None)
        if field is None:
            return None
        here = field.dataType
    return parts if isinstance(here, T.ArrayType) else None


def explode_paths(df: DataFrame, paths: list[list[str]], names: list[str]) -> DataFrame:
    """A row for each value of the repeated ``paths`` (side by side, by position), under ``names``.

    A record without values keeps one row.
    """
    cols = [F.col(".".join(f"`{p}`" for p in path)) for path in paths]
    if len(cols) == 1:
        return df.withColumn(names[0], F.explode_outer(cols[0]))
    zipped = df.withColumn("_zip", F.explode_outer(F.arrays_zip(*[c.alias(n) for c, n in zip(cols, names, strict=True)])))
    fields = zipped.schema["_zip"].dataType.names
    for n, f in zip(names, fields, strict=True):
        zipped = zipped.withColumn(n, F.col("_zip").getField(f))
    return zipped.drop("_zip")
