"""Source urls of the IMPORT statement."""

from __future__ import annotations

from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import DataFrame, SparkSession

from ..errors import QueryError
from .database import read_jdbc
from .files import read_csv

_CSV = {"headers", "col_sep", "row_sep", "quote_char", "escape_char"}


def open_source(spark: SparkSession, url: str, tables: list[str]) -> dict[str, DataFrame]:
    """The named tables of a ``csv://``, ``mysql://`` or ``jdbc://`` url."""
    scheme, _, rest = url.partition("://")
    if scheme == "csv":
        if len(tables) != 1:
            raise QueryError("exactly one table can be imported from a CSV file")
        path, _, query = rest.partition("?")
        given = dict(parse_qsl(query, keep_blank_values=True))
        if unknown := set(given) - _CSV:
            raise QueryError(f"unknown CSV option: {sorted(unknown)[0]}")
        headers = given.pop("headers", "true").lower() == "true"
        given = {k: v.replace("\\n", "\n").replace("\\t", "\t") for k, v in given.items()}
        return {tables[0]: read_csv(spark, path, headers, **given)}
    if scheme == "jdbc":  # any database whose driver Spark has, read in ranges of a column if one is named
        address, _, query = url.partition("?")
        given = dict(parse_qsl(query))
        return {t: read_jdbc(spark, address.replace("jdbc://", "jdbc:", 1), t, given.get("username"), given.get("password"), given.get("filter"), given.get("column"), partitions=int(given.get("partitions", 8))) for t in tables}
    if scheme == "mysql":
        parts = urlsplit(url)
        given = dict(parse_qsl(parts.query))
        jdbc = f"jdbc:mysql://{parts.netloc}{parts.path}"
        return {t: read_jdbc(spark, jdbc, t, given.get("username"), given.get("password")) for t in tables}
    raise QueryError(f"unknown source: {url}")
