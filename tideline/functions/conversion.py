"""Conversions between types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_nil(x: Column) -> Column:
    return F.lit(None)


def to_int64(x: Column, kind: T.DataType) -> Column:
    """Floats are cut, times give microseconds, text its leading digits."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(x)
    return leading_int(x) if isinstance(kind, T.StringType) else x.cast("bigint")


def leading_int(x: Column) -> Column:
    return F.regexp_extract(x, r"^\s*-?\d+", 0).try_cast("bigint")


def to_float(x: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(x).cast("double")
    return F.regexp_extract(x, r"^\s*-?\d*\.?\d+(?:[eE][+-]?\d+)?", 0).try_cast("double") if isinstance(kind, T.StringType) else x.cast("double")


def to_string(x: Column, kind: T.DataType) -> Column:
    """Times print their microseconds; null prints as NULL."""
    text = F.unix_micros(x).cast("string") if isinstance(kind, T.TimestampType) else x.cast("string")
    return F.coalesce(text, F.lit("NULL"))


def to_bool(x: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return F.lower(x).isin("true", "1", "t", "yes")
    return F.unix_micros(x) != 0 if isinstance(kind, T.TimestampType) else x.cast("boolean")


def to_timestamp64(x: Column) -> Column:
    """Microseconds since the epoch as a time."""
    return F.timestamp_micros(x.cast("bigint"))
