"""Sliding windows over a whole time range, empty ones included.

Windows start at the earliest time and move by ``step`` seconds; there is one
row for each, also where no input falls into it, until all times are covered.
Rows are first aggregated into panes (the greatest common divisor of window and step), so only panes, not
rows, are repeated for each window they belong to.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICRO = 1_000_000
#: Windows of the grid that are laid out at a time.
STRETCH = 65_536
#: Aggregates that panes can be combined by: (in a pane, over panes).
_MERGE = {
    "count": (lambda x: F.count(x), lambda p: F.coalesce(F.sum(p), F.lit(0).cast("bigint"))),
    "sum": (lambda x: F.sum(x), lambda p: F.sum(p)),
    "min": (lambda x: F.min(x), lambda p: F.min(p)),
    "max": (lambda x: F.max(x), lambda p: F.max(p)),
}


def micros(df: DataFrame, time: Column) -> Column:
    return F.unix_micros(time) if dict(df.select(time.alias("t")).dtypes)["t"] in ("timestamp", "timestamp_ntz") else (time * MICRO).cast("bigint")


def time_span(df: DataFrame, time: Column) -> DataFrame:
    """(_from, _to): the first and last time in microseconds, one row; both null without any."""
    us = micros(df, time)
    return df.agg(F.min(us).alias("_from"), F.max(us).alias("_to"))


def sliding_windows(df: DataFrame, time: Column, size: int, step: int, by: dict[str, Column], aggs: dict[str, tuple[str, Column]], time_name: str = "time", span: DataFrame | None = None) -> DataFrame:
    """One row per step (and combination of ``by``): the windows' last step, and the aggregates.

    ``aggs`` maps an output name to (function, argument); count, sum, min, max,
    mean and avg go through panes, any other is computed on repeated rows.
    ``span`` (see :func:`time_span`; several rows are taken together) sets
    where windows begin and end; without it the rows' own times do.
    """
    rows = df.withColumn("_us", micros(df, time)).filter("_us is not null")
    span = (time_span(df, time) if span is None else span).agg(F.min("_from").alias("_from"), F.max("_to").alias("_to")).filter("_from is not null")
    # The last window is the first one that ends after the last time.
    last = F.greatest(F.lit(0), F.floor((F.col("_to") - F.col("_from") - (size - step) * MICRO) / (step * MICRO))).cast("bigint")
    span = span.withColumn("_last", last)
    keys = {f"_k{i}": c for i, c in enumerate(by.values())}
    parts: dict[str, tuple[str, Column]] = {}
    for name, (fn, arg) in aggs.items():
        if fn in ("mean", "avg"):
            parts |= {f"{name}#s": ("sum", arg), f"{name}#n": ("count", arg)}
        else:
            parts[name] = (fn, arg)
    panes = all(fn in _MERGE for fn, _ in parts.values())
    width = (math.gcd(size, step) if panes else 1) * MICRO
    # The one-row span is sent to every task.
    timed = rows.join(F.broadcast(span.select("_from", "_last")))
    offset = F.col("_us") - F.col("_from")
    if panes:
        timed = timed.groupBy(F.floor(offset / width).alias("_p"), "_last", *[c.alias(k) for k, c in keys.items()]).agg(*[_MERGE[fn][0](a).alias(n) for n, (fn, a) in parts.items()])
        at = F.col("_p") * width
    else:
        timed = timed.select("_last", *[c.alias(k) for k, c in keys.items()], offset.alias("_p"), *[a.alias(n) for n, (_, a) in parts.items()])
        at = F.col("_p")
    # Window i covers [i * step, i * step + size) from the start.
    low = F.greatest(F.lit(0), F.floor((at - size * MICRO) / (step * MICRO)) + 1)
    high = F.least(F.col("_last"), F.floor(at / (step * MICRO)))
    timed = timed.withColumn("_low", low.cast("bigint")).withColumn("_high", high.cast("bigint"))
    each = timed.filter("_low <= _high").withColumn("_w", F.explode(F.sequence("_low", "_high")))
    if panes:
        merged = [_MERGE[fn][1](F.col(f"`{n}`")).alias(n) for n, (fn, _) in parts.items()]
    else:
        from ..functions.aggregates import AGGREGATES

        merged = [AGGREGATES[fn](F.col(f"`{n}`")).alias(n) for n, (fn, _) in parts.items()]
    filled = each.groupBy("_w", *keys).agg(*merged)
    # The grid is laid out in stretches, so that a long one is neither one row nor one task.
    starts = span.select("_from", "_last", F.explode(F.sequence(F.lit(0).cast("bigint"), "_last", F.lit(STRETCH).cast("bigint"))).alias("_s"))
    starts = starts.repartition(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "_s")
    grid = starts.select("_from", F.explode(F.sequence("_s", F.least("_last", F.col("_s") + (STRETCH - 1)))).alias("_w"))
    if keys:
        grid = grid.join(timed.select(*keys).distinct())
    f = filled.select(F.col("_w").alias("_fw"), *[F.col(k).alias(f"_f{k}") for k in keys], *[F.col(f"`{n}`") for n in parts])
    match = grid["_w"] == f["_fw"]
    for k in keys:
        match = match & grid[k].eqNullSafe(f[f"_f{k}"])
    out = grid.join(f, match, "left")
    stamp = F.timestamp_micros(F.col("_from") + F.col("_w") * step * MICRO + (size - step) * MICRO)
    cols = [stamp.alias(time_name), *[F.col(k).alias(n) for k, n in zip(keys, by, strict=True)]]
    for name, (fn, _) in aggs.items():
        if fn in ("mean", "avg"):
            n = F.col(f"`{name}#n`")
            cols.append(F.when(n > 0, F.col(f"`{name}#s`") / n).alias(name))
        else:
            cols.append(F.col(f"`{name}`").alias(name))
    return out.select(*cols)
