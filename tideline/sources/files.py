"""File sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, headers: bool = True, col_sep: str = ",", row_sep: str | None = None, quote_char: str = '"', escape_char: str = "\\", schema: T.StructType | None = None) -> DataFrame:
    """A CSV file as text columns, or as ``schema``; a row of another length fails the job."""
    reader = spark.read.option("header", headers).option("inferSchema", False).option("sep", col_sep).option("quote", quote_char).option("escape", escape_char).option("mode", "FAILFAST")
    if row_sep and row_sep != "\n":
        reader = reader.option("lineSep", row_sep)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON objects, one a line; with a schema the file is read once."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
