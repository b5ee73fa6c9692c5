"""Arithmetic whose results depend on whether both operands are integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def is_integer(kind: T.DataType) -> bool:
    return isinstance(kind, INTEGERS)


def div(a: Column, b: Column, whole: bool) -> Column:
    """Integers divide without a rest and fail on zero; floats give infinity or NaN there."""
    if whole:
        return F.call_function("div", a.cast("bigint"), b.cast("bigint"))
    x, y = a.cast("double"), b.cast("double")
    by_zero = F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf"))).when(x.isNull(), F.lit(None)).otherwise(F.lit(float("nan")))
    return F.when(y != 0, x / y).when(y == 0, by_zero)


def mod(a: Column, b: Column, whole: bool) -> Column:
    """The rest, with the sign of ``a``; integers fail on zero, floats give NaN."""
    if whole:
        return a % b
    x, y = a.cast("double"), b.cast("double")
    return F.when(y != 0, x % y).when(y == 0, F.lit(float("nan")))


def power(a: Column, b: Column, whole: bool) -> Column:
    """Integers are multiplied out, so that they stay exact, and fail where they overflow; to a negative power they are cut to an integer."""
    out = F.pow(a.cast("double"), b.cast("double"))
    if not whole:
        return out
    x, n = a.cast("bigint"), b.cast("bigint")
    # Beyond 64 factors only 0, 1 and -1 do not overflow, and they repeat every two.
    factors = F.when(n > 64, 64 + n % 2).otherwise(n).cast("int")
    product = F.aggregate(F.array_repeat(x, F.greatest(factors, F.lit(0))), F.lit(1).cast("bigint"), lambda p, y: p * y)
    return F.when(n >= 0, product).when(n < 0, out.cast("bigint"))


def truncate(x: Column, digits: Column | None = None) -> Column:
    """``x`` cut towards zero after some digits."""
    scale = F.pow(F.lit(10.0), digits if digits is not None else F.lit(0))
    return F.signum(x) * F.floor(F.abs(x) * scale) / scale


def round_(x: Column, digits: int = 0) -> Column:
    return F.round(x, digits)
