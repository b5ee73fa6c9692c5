"""String functions; lengths and positions count characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

lower = F.lower
upper = F.upper


def startswith(s: Column, p: Column) -> Column:
    return F.startswith(s, p)


def endswith(s: Column, p: Column) -> Column:
    return F.endswith(s, p)


def ltrim(s: Column) -> Column:
    return F.ltrim(s)


def rtrim(s: Column) -> Column:
    return F.rtrim(s)


def concat(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def substring(s: Column, pos: Column, length: Column | None = None) -> Column:
    """From ``pos`` on, counted from 1, or from the end if negative.

    Position 0, and one before the start, give ''; one past the end gives the
    last character. A length is clamped; a negative one gives ''.
    """
    n = F.length(s)
    pos = pos.cast("int")
    start = F.when(pos < 0, n + pos + 1).otherwise(F.least(pos, n))
    rest = n - start + 1
    take = rest if length is None else F.greatest(F.lit(0), F.least(length.cast("int"), rest))
    empty = (pos == 0) | (n == 0) | ((pos < 0) & (pos + n < 0))
    return F.when(empty, F.lit("")).otherwise(F.substring(s, F.greatest(start, F.lit(1)), take))


def regexp(s: Column, pattern: Column) -> Column:
    """Whether the pattern matches anywhere."""
    return F.rlike(s, pattern)


def like(s: Column, pattern: Column) -> Column:
    return F.like(s, pattern)


def fnv32(s: Column) -> Column:
    """FNV-1a, 32 bits, over the bytes of the text without closing spaces."""
    raw = F.hex(F.rtrim(s).cast("binary"))
    # Offset basis and prime of the 32-bit FNV hash.
    basis, prime, mask = F.lit(2166136261), F.lit(16777619), F.lit(4294967295)
    at = F.when(F.length(raw) > 0, F.sequence(F.lit(1), F.length(raw), F.lit(2))).otherwise(F.array().cast("array<int>"))
    step = lambda h, i: (h.bitwiseXOR(F.conv(F.substring(raw, i, F.lit(2)), 16, 10).cast("bigint")) * prime).bitwiseAND(mask)
    return F.when(s.isNotNull(), F.aggregate(at, basis.cast("bigint"), step))
