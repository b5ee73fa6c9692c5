"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations and two joins over the edge list, which never
grows. Joins on hub nodes are left to Spark's skew-join splitting; nothing is
gathered per node, and nothing but one row on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Written out, so that the join reads two exchanges and Spark can split a hub.
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("u <> v").distinct(), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    # Edges here point from the larger node u to the smaller v; a hub may be either.
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct(), least


def _is_settled(edges: DataFrame) -> bool:
    """Every node hangs on one root, and no root hangs on another."""
    twice = edges.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u")
    deep = edges.select(F.col("v").alias("u")).distinct().join(edges.select("u"), "u", "left_semi")
    return not twice.union(deep).limit(1).collect()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (u, v) of one orderable type -> (node, component) for every node
    on an edge that joins two nodes; component is the least node reachable.

    Self-loops, repeated edges, either direction and null ends are fine (null
    ends link nothing). An empty edge list gives an empty table.
    """
    start = edges.filter("u is not null and v is not null and u <> v")
    now = materialize(start.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        if _is_settled(now):
            break
        moved, first = _large_star(now)
        moved = materialize(moved, "moved")
        edges_, second = _small_star(moved)
        after = materialize(edges_, "edges")
        discard(now, first, moved, second)
        now = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    out._tideline_path = now._tideline_path  # so that discard() of the result drops the table behind it
    return out
