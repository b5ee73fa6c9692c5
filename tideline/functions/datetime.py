"""Time functions on microseconds since the epoch, UTC; months are 30 days, years 365."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError

SECOND = 1_000_000
#: Microseconds of each unit, as fixed values, under the names a window may use.
UNITS = {
    **dict.fromkeys(("ms", "msec", "msecs", "millisecond", "milliseconds"), 1_000),
    **dict.fromkeys(("s", "sec", "secs", "second", "seconds"), SECOND),
    **dict.fromkeys(("min", "mins", "minute", "minutes"), 60 * SECOND),
    **dict.fromkeys(("h", "hour", "hours"), 3_600 * SECOND),
    **dict.fromkeys(("d", "day", "days"), 86_400 * SECOND),
    **dict.fromkeys(("w", "week", "weeks"), 7 * 86_400 * SECOND),
    **dict.fromkeys(("month", "months"), 30 * 86_400 * SECOND),
    **dict.fromkeys(("y", "year", "years"), 365 * 86_400 * SECOND),
}
_DAY, _HOUR, _MINUTE = 86_400 * SECOND, 3_600 * SECOND, 60 * SECOND
#: Composite units: pattern of the parts and the microseconds of each.
COMPOSITE = {
    "MINUTE_SECOND": (r"(\d+):(\d+)", (_MINUTE, SECOND)),
    "HOUR_SECOND": (r"(\d+):(\d+):(\d+)", (_HOUR, _MINUTE, SECOND)),
    "HOUR_MINUTE": (r"(\d+):(\d+)", (_HOUR, _MINUTE)),
    "DAY_SECOND": (r"(\d+) (\d+):(\d+):(\d+)", (_DAY, _HOUR, _MINUTE, SECOND)),
    "DAY_MINUTE": (r"(\d+) (\d+):(\d+)", (_DAY, _HOUR, _MINUTE)),
    "DAY_HOUR": (r"(\d+) (\d+)", (_DAY, _HOUR)),
    "YEAR_MONTH": (r"(\d+)-(\d+)", (365 * _DAY, 30 * _DAY)),
}


def window_micros(window: str) -> int:
    """Microseconds of ``[n]unit``."""
    m = re.fullmatch(r"(\d*)([A-Za-z]+)", window.strip())
    if not m or m[2] not in UNITS or m[1] == "0":
        raise QueryError(f"unknown time window: {window}")
    return int(m[1] or 1) * UNITS[m[2]]


def interval_micros(expr: str, unit: str) -> int:
    """Microseconds of an interval such as ('10', 'SECOND') or ('1-2', 'YEAR_MONTH')."""
    unit, text = unit.upper(), str(expr).strip()
    sign = -1 if text.startswith("-") else 1
    text = text.lstrip("+-").strip()
    if unit in COMPOSITE:
        pattern, sizes = COMPOSITE[unit]
        if not (m := re.fullmatch(pattern, text)):
            raise QueryError(f"invalid interval '{expr}' for {unit}")
        return sign * sum(int(x) * s for x, s in zip(m.groups(), sizes, strict=True))
    if unit.lower() not in UNITS:
        raise QueryError(f"unknown time unit: {unit}")
    try:
        return sign * round(float(text) * UNITS[unit.lower()])
    except ValueError:
        raise QueryError(f"invalid interval '{expr}' for {unit}") from None


def now() -> Column:
    return F.current_timestamp()


def from_timestamp(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def date_trunc(window: str, ts: Column) -> Column:
    """``ts`` floored to a multiple of the window since the epoch, so weeks start on Thursday."""
    us, n = F.unix_micros(ts), window_micros(window)
    return F.timestamp_micros(us - F.pmod(us, F.lit(n)))


def date_add(ts: Column, expr: str, unit: str) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + F.lit(interval_micros(expr, unit)))


def date_sub(ts: Column, expr: str, unit: str) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) - F.lit(interval_micros(expr, unit)))


def parse_time(text: str, at: dt.datetime | None = None) -> int | None:
    """Microseconds since the epoch of a time literal; None if it is none.

    'now', '-7days', '7days ago', a unix time in s, ms or µs by its size, ISO or
    civil time; the zero date is the epoch.
    """
    text = text.strip()
    here = round((at or dt.datetime.now(dt.UTC)).timestamp() * SECOND)
    if text.lower() == "now":
        return here
    if m := re.fullmatch(r"(-)?(\d+)\s*([A-Za-z]+)(\s+ago)?", text):
        if m[3].lower() in UNITS and (m[1] or m[4]):
            return here - int(m[2]) * UNITS[m[3].lower()]
        return None
    if re.fullmatch(r"\d+", text):
        n = int(text)
        return n * SECOND if n < 10**11 else n * 1000 if n < 10**14 else n
    if text.startswith("0000-00-00"):
        return 0
    try:
        found = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        return None
    found = found if found.tzinfo else found.replace(tzinfo=dt.UTC)
    return round((found - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) / dt.timedelta(microseconds=1))


def time_at(value: str | Column) -> Column:
    """A time literal as a timestamp; for a column, its unix seconds or civil times."""
    if isinstance(value, str):
        us = parse_time(value)
        if us is None:
            raise QueryError(f"can't convert to a time: '{value}'")
        return F.timestamp_micros(F.lit(us).cast("bigint"))
    n = value.cast("string").try_cast("bigint")
    unix = F.when(n < 10**11, n * SECOND).when(n < 10**14, n * 1000).otherwise(n)
    return F.coalesce(F.timestamp_micros(unix), value.cast("string").try_cast("timestamp"))
