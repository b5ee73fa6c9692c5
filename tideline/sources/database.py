"""Tables of relational databases over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_jdbc(spark: SparkSession, url: str, table: str, user: str | None = None, password: str | None = None, condition: str | None = None, column: str | None = None, lower: int | None = None, upper: int | None = None, partitions: int = 8) -> DataFrame:
    """A remote table; with a numeric ``column`` it is read in parallel ranges.

    Bounds that are not given are asked of the database. They only set the
    ranges: rows beyond them, or with null there, are read as well. The
    driver's jar must be on Spark's class path.
    """

    def reader(source: str):
        out = spark.read.format("jdbc").option("url", url).option("dbtable", source)
        out = out.option("user", user) if user else out
        return out.option("password", password) if password else out

    where = f" WHERE {condition}" if condition else ""
    whole = reader(f"(SELECT * FROM {table}{where}) t" if condition else table)
    if not column:
        return whole.load()
    if lower is None or upper is None:
        found = reader(f"(SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {table}{where}) t").load().first()
        if found[0] is None:
            return whole.load()
        lower, upper = int(found[0]) if lower is None else lower, int(found[1]) + 1 if upper is None else upper
    return whole.option("partitionColumn", column).option("lowerBound", lower).option("upperBound", max(upper, lower + 1)).option("numPartitions", partitions).load()
