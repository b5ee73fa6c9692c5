"""Tables with a primary key on Spark's catalog.

Every write appends rows with a version; reading keeps the latest row of each
key, and ``compact`` rewrites a table so that it is again a plain scan. Keys
and the partition column are table properties. A table whose partition key is a
time lies in a folder for each day (counted from 1970 in UTC), and a query's
bounds on that key leave the other folders unread.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dialect import ast
from ..errors import QueryError
from ..operators.upsert import SEQUENCE, VERSION, latest

PREFIX = "tideline."
#: Names of column types, as fixed values.
TYPES = {
    "string": T.StringType(), "bool": T.BooleanType(), "boolean": T.BooleanType(), "datetime": T.TimestampType(), "time": T.TimestampType(),
    "uint32": T.LongType(), "uint64": T.LongType(), "int64": T.LongType(), "double": T.DoubleType(), "float": T.DoubleType(),
}
PROPERTIES = ("partition_size_hint", "enable_async_split", "partition_split_threshold", "disable_split", "disable_replication")
DAY = "_day"
HIDDEN = (VERSION, SEQUENCE, DAY)
DAY_MICROS = 86_400_000_000


def day_of(time: Column) -> Column:
    return F.floor(F.unix_micros(time) / DAY_MICROS).cast("int")


def column_type(c: ast.Column) -> T.DataType:
    if c.type == "record":
        kind: T.DataType = struct(c.fields or [])
    elif c.type in TYPES:
        kind = TYPES[c.type]
    else:
        raise QueryError(f"invalid type: '{c.type}' for column '{c.name}'")
    return T.ArrayType(kind) if c.repeated else kind


def struct(columns: list[ast.Column]) -> T.StructType:
    seen: set[str] = set()
    for c in columns:
        if c.name.lower() in seen:
            raise QueryError(f"duplicate column: {c.name}")
        seen.add(c.name.lower())
    return T.StructType([T.StructField(c.name, column_type(c), not c.required) for c in columns])


class Tables:
    """The tables of a session's current database."""

    def __init__(self, spark: SparkSession):
        self.spark, self._last = spark, 0

    def _version(self) -> int:
        """Microseconds now, and always later than the last write here."""
        self._last = max(self._last + 1, time.time_ns() // 1000)
        return self._last

    def properties(self, name: str) -> dict[str, str]:
        rows = self.spark.sql(f"SHOW TBLPROPERTIES {name}").collect()
        return {r["key"].removeprefix(PREFIX): r["value"] for r in rows if r["key"].startswith(PREFIX)}

    def is_keyed(self, name: str) -> bool:
        if not self.spark.catalog.tableExists(name):
            return False
        kinds = [t.tableType for t in [self.spark.catalog.getTable(name)]]
        return kinds[0] not in ("TEMPORARY", "VIEW") and "primary_key" in self.properties(name)

    def key(self, name: str) -> list[str]:
        return [k for k in self.properties(name).get("primary_key", "").split(",") if k]

    def schema(self, name: str) -> T.StructType:
        return T.StructType([f for f in self.spark.table(name).schema if f.name not in HIDDEN])

    def create(self, name: str, columns: list[ast.Column], key: list[str], partition: str | None = None, props: dict[str, str] | None = None) -> None:
        schema = struct(columns)
        names = {f.name for f in schema}
        for k in [*key, *([partition] if partition else [])]:
            if k not in names:
                raise QueryError(f"no such column: '{k}'")
        if partition and key and partition not in key:
            raise QueryError("the partition key must be part of the primary key")
        if self.spark.catalog.tableExists(name):
            raise QueryError(f"table exists already: '{name}'")
        daily = bool(partition) and schema[partition].dataType == T.TimestampType()
        whole = T.StructType([*schema, T.StructField(VERSION, T.LongType()), T.StructField(SEQUENCE, T.LongType()), *([T.StructField(DAY, T.IntegerType())] if daily else [])])
        props = {"primary_key": ",".join(key), "partition_key": partition or "", "required": ",".join(f.name for f in schema if not f.nullable), "compact": "true", **(props or {})}
        self._create(name, whole, props, self._fresh(name))

    def _create(self, name: str, schema: T.StructType, props: dict[str, str], location: str) -> None:
        listed = ", ".join(f"'{PREFIX}{k}' = '{v}'" for k, v in props.items())
        body = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        days = f"PARTITIONED BY ({DAY})" if DAY in schema.names else ""
        self.spark.sql(f"CREATE TABLE {name} ({body}) USING parquet {days} LOCATION '{location}' TBLPROPERTIES ({listed})")

    def _fresh(self, name: str) -> str:
        """A new folder for a table's rows, where its database lies."""
        database, _, own = name.replace("`", "").rpartition(".")
        home = self.spark.catalog.getDatabase(database or self.spark.catalog.currentDatabase()).locationUri
        return f"{home.rstrip('/')}/{own}-v{uuid.uuid4().hex[:8]}"

    def _delete(self, *folders: str | None) -> None:
        for folder in filter(None, folders):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def set_property(self, name: str, k: str, v: str) -> None:
        if k not in PROPERTIES:
            raise QueryError(f"invalid property: '{k}'")
        self._set(name, k, v)

    def _set(self, name: str, k: str, v: str) -> None:
        self.spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{PREFIX}{k}' = '{v}')")

    def read(self, name: str, bounds: dict[str, list[tuple[str, Callable[[], Column]]]] | None = None) -> DataFrame:
        """The table as queries see it: the latest row of each key, without hidden columns.

        ``bounds`` are comparisons of columns with constants that the query's
        rows meet; those of the partition key choose the days that are read.
        """
        if not self.is_keyed(name):
            return self.spark.table(name)
        df, key = self.spark.table(name), self.key(name)
        if DAY in df.columns:
            for op, value in (bounds or {}).get(self.properties(name).get("partition_key", "").lower(), []):
                day = day_of(value().cast("timestamp"))
                df = df.filter(F.col(DAY) >= day if op in (">", ">=") else F.col(DAY) <= day if op in ("<", "<=") else F.col(DAY) == day)
        if key and self.properties(name).get("compact") != "true":
            df = latest(df, key)
        return df.drop(*HIDDEN)

    def append(self, name: str, rows: DataFrame) -> None:
        """Write rows (upserts, where the table has a key); missing columns become null."""
        if not self.is_keyed(name):
            rows.write.insertInto(name)
            return
        schema, given = self.schema(name), {c.lower(): c for c in rows.columns}
        if unknown := [c for c in rows.columns if c.lower() not in {f.name.lower() for f in schema}]:
            raise QueryError(f"no such column: '{unknown[0]}'")
        cols = [(F.col(f"`{given[f.name.lower()]}`") if f.name.lower() in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
        out = rows.select(*cols)
        for c in [c for c in self.properties(name).get("required", "").split(",") if c]:
            out = out.withColumn(c, F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"column '{c}' must not be null")).cast(out.schema[c].dataType)))
        out = out.withColumn(VERSION, F.lit(self._version())).withColumn(SEQUENCE, F.monotonically_increasing_id())
        if self._is_daily(name):
            out = out.withColumn(DAY, day_of(F.col(self.properties(name)["partition_key"])))
        self._set(name, "compact", "false")
        out.write.mode("append").insertInto(name)

    def _is_daily(self, name: str) -> bool:
        return DAY in self.spark.table(name).columns

    def replace(self, name: str, df: DataFrame) -> None:
        """Write ``df`` as the table's whole contents, by way of a new table.

        Between its two renamings the old rows still lie under ``<name>_old_...``.
        """
        mark, folder = uuid.uuid4().hex[:8], self._fresh(name)
        (df.write.partitionBy(DAY) if DAY in df.columns else df.write).parquet(folder)
        self._create(f"{name}_new_{mark}", df.schema, self.properties(name), folder)
        if DAY in df.columns:
            self.spark.sql(f"MSCK REPAIR TABLE {name}_new_{mark}")
        self.spark.sql(f"ALTER TABLE {name} RENAME TO {name}_old_{mark}")
        self.spark.sql(f"ALTER TABLE {name}_new_{mark} RENAME TO {name}")
        was = self._location(f"{name}_old_{mark}")
        self.spark.sql(f"DROP TABLE {name}_old_{mark}")
        self._delete(was)

    def _location(self, name: str) -> str:
        rows = self.spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter("col_name = 'Location'").collect()
        return rows[0]["data_type"].rstrip("/")

    def compact(self, name: str) -> None:
        """Keep the latest row of each key only, sorted into ranges of the key.

        The rows are written to a new folder, and then the table is pointed
        there in one step. What is appended meanwhile is carried over before
        that, and the former folder stays for queries that still read it until
        the next time.
        """
        key, part = self.key(name), self.properties(name).get("partition_key")
        order = [part, *[k for k in key if k != part]] if part else key
        base = self.spark.table(name)
        seen = base.agg(F.max(VERSION)).first()[0] or 0
        df = base.filter(F.col(VERSION) <= seen)
        df = latest(df, key) if key else df
        df = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
        was = self._location(name)
        fresh = self._fresh(name)

        def write(rows: DataFrame) -> None:
            w = rows.write.mode("append")
            (w.partitionBy(DAY) if DAY in rows.columns else w).parquet(fresh)

        write(df)
        self.spark.catalog.refreshTable(name)
        late = self.spark.table(name).filter(F.col(VERSION) > seen)
        more = bool(late.head(1))
        if more:
            write(late)
        former = self.properties(name).get("former_location")
        self.spark.sql(f"ALTER TABLE {name} SET LOCATION '{fresh}'")
        if self._is_daily(name):
            self.spark.sql(f"MSCK REPAIR TABLE {name}")
        self.spark.catalog.refreshTable(name)
        self._set(name, "compact", "false" if more else "true")
        self._set(name, "former_location", was)
        self._delete(former)

    def drop(self, name: str) -> None:
        if not self.spark.catalog.tableExists(name):
            raise QueryError(f"table not found: '{name}'")
        folders = [self._location(name), self.properties(name).get("former_location")] if self.is_keyed(name) else []
        self.spark.sql(f"DROP TABLE {name}")
        self._delete(*folders)

    def add_column(self, name: str, c: ast.Column) -> None:
        """A new column, or one inside a record (``a.b``): old rows have null there."""
        kind = column_type(c)
        path = c.name.split(".")
        if len(path) == 1:
            if c.name.lower() in {f.name.lower() for f in self.spark.table(name).schema}:
                raise QueryError(f"duplicate column: {c.name}")
            df = self.spark.table(name).withColumn(c.name, F.lit(None).cast(kind))
        else:
            df = self.spark.table(name)
            df = df.withColumn(path[0], _change(F.col(f"`{path[0]}`"), df.schema[path[0]].dataType, path[1:], lambda x, field: x.withField(field, F.lit(None).cast(kind))))
        self.replace(name, _hidden_last(df))

    def drop_column(self, name: str, column: str) -> None:
        path, df = column.split("."), self.spark.table(name)
        if path[0].lower() not in {f.name.lower() for f in self.schema(name)}:
            raise QueryError(f"no such column: '{column}'")
        if path[0] in self.key(name):
            raise QueryError(f"column '{column}' is part of the primary key")
        if len(path) == 1:
            df = df.drop(path[0])
        else:
            df = df.withColumn(path[0], _change(F.col(f"`{path[0]}`"), df.schema[path[0]].dataType, path[1:], lambda x, field: x.dropFields(field)))
        self.replace(name, _hidden_last(df))

    def names(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables())

    def describe(self, name: str) -> DataFrame:
        if not self.spark.catalog.tableExists(name):
            raise QueryError(f"table not found: '{name}'")
        key = self.key(name) if self.is_keyed(name) else []
        required = self.properties(name).get("required", "").split(",") if key else []
        rows = [(f.name, kind_name(f.dataType), "NO" if f.name in required or not f.nullable else "YES", "YES" if f.name in key else "NO", None, "PLAIN") for f in self.schema(name)]
        return self.spark.createDataFrame(rows, "column_name string, type string, nullable string, primary_key string, description string, encoding string")

    def partitions(self, name: str) -> DataFrame:
        """The table's days, or else its files, with their rows and the range of the partition key; Spark places them on no server."""
        df, key = self.spark.table(name), self.key(name) if self.is_keyed(name) else []
        part = (self.properties(name).get("partition_key") if key else None) or (key[0] if key else df.columns[0])
        by = F.date_add(F.lit("1970-01-01").cast("date"), F.col(DAY)).cast("string") if DAY in df.columns else F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1)
        out = df.groupBy(by.alias("partition_id")).agg(F.count("*").alias("rows"), F.min(part).cast("string").alias("keyrange_begin"), F.max(part).cast("string").alias("keyrange_end"))
        return out.withColumn("servers", F.lit(None).cast("string")).orderBy("partition_id")


def kind_name(kind: T.DataType) -> str:
    if isinstance(kind, T.ArrayType):
        return f"REPEATED {kind_name(kind.elementType)}"
    if isinstance(kind, T.StructType):
        return "RECORD"
    names = {T.StringType: "STRING", T.BooleanType: "BOOL", T.TimestampType: "DATETIME", T.LongType: "UINT64", T.DoubleType: "DOUBLE"}
    return names.get(type(kind), kind.simpleString().upper())


def _change(c, kind: T.DataType, path: list[str], edit):
    """``c`` with ``edit`` made to the record that holds the last name of ``path``; repeated records are edited one by one."""
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _change(x, kind.elementType, path, edit))
    if not isinstance(kind, T.StructType):
        raise QueryError(f"'{path[0]}' is not inside a record")
    if len(path) == 1:
        return edit(c, path[0])
    return c.withField(path[0], _change(c[path[0]], kind[path[0]].dataType, path[1:], edit))


def _hidden_last(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in HIDDEN], *[c for c in HIDDEN if c in df.columns])
