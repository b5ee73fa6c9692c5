"""Sessions and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .shipping import ship

#: Tables that a dataset folder may hold.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def get_session(app: str = "tideline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the engine's results rely on: UTC, ANSI, AQE."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A Parquet table of a dataset folder; filters and columns reach the scan.

    Times without a zone are read as UTC.
    """
    df = spark.read.parquet(f"{folder}/{table}.parquet")
    if any(isinstance(f.dataType, T.TimestampNTZType) for f in df.schema):
        fields = [T.StructField(f.name, T.TimestampType() if isinstance(f.dataType, T.TimestampNTZType) else f.dataType, f.nullable) for f in df.schema]
        df = spark.read.schema(T.StructType(fields)).parquet(f"{folder}/{table}.parquet")
    return df


def register(spark: SparkSession, folder: str, tables: tuple[str, ...] = TABLES) -> None:
    """Make tables of a folder known by name."""
    for t in tables:
        load(spark, folder, t).createOrReplaceTempView(t)
