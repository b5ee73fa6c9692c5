"""Scalar and aggregate functions as builders of Spark columns."""

from . import aggregates, conversion, datetime, logic, numeric, strings

__all__ = ["aggregates", "conversion", "datetime", "logic", "numeric", "strings"]
