"""The engine: statements in, DataFrames (or charts) out."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .charts import Chart
from .dialect import ast
from .dialect.compiler import Environment, Scope, build_query, compile_expr, walk
from .dialect.parser import parse
from .errors import QueryError
from .operators.upsert import merge
from .plans.mapreduce import Job, MapReduce
from .plans.tables import Tables
from .session import TABLES, get_session, load
from .shipping import ship
from .sources.files import read_csv, read_json
from .sources.urls import open_source


class Engine:
    """Runs the dialect on a Spark session."""

    def __init__(self, spark: SparkSession | None = None, folder: str | None = None):
        """With a ``folder``, its Parquet tables can be named too; each is opened when first named."""
        self.spark, self.folder = spark or get_session(), folder
        self._opened: dict[str, DataFrame] = {}
        ship(self.spark)
        self.tables = Tables(self.spark)
        self.env = Environment(self.spark, self._table)
        self.mapreduce = MapReduce(self)

    def _table(self, name: str, bounds: dict | None = None) -> DataFrame:
        if self.folder and name in TABLES:
            if name not in self._opened:
                self._opened[name] = load(self.spark, self.folder, name)
            return self._opened[name]
        if not self.spark.catalog.tableExists(name):
            raise QueryError(f"table not found: '{name}'")
        return self.tables.read(name, bounds)

    # -- queries
    def sql(self, text: str) -> DataFrame | Chart:
        """The result of the last statement of ``text``."""
        return self.sql_multi(text)[-1]

    def sql_multi(self, text: str) -> list[DataFrame | Chart]:
        """A result for each statement; the queries after a DRAW belong to its chart."""
        out: list[DataFrame | Chart] = []
        for s in parse(text):
            if s.kind == "draw":
                # Charts drawn one after another share a canvas.
                chart = Chart(s.args["kind"], s.args["options"])
                if out and isinstance(out[-1], Chart):
                    out[-1].beside(chart)
                else:
                    out.append(chart)
                continue
            result = self._run(s)
            if out and isinstance(out[-1], Chart) and s.kind == "select":
                out[-1].add(result)
            else:
                out.append(result)
        if not out:
            raise QueryError("no statement given")
        return out

    def explain(self, text: str, mode: str = "formatted") -> str:
        (s,) = parse(text)
        df = build_query(s.args["query"], self.env)
        return self.spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)

    def _none(self) -> DataFrame:
        return self.spark.createDataFrame([], "result string")

    def _run(self, s: ast.Statement) -> DataFrame:
        a: dict[str, Any] = s.args
        t = self.tables
        if s.kind == "select":
            return build_query(a["query"], self.env)
        if s.kind == "explain":
            df = build_query(a["query"], self.env)
            plan = self.spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
            return self.spark.createDataFrame([(plan,)], "plan string")
        if s.kind == "create_table":
            t.create(a["name"], a["columns"], a["key"], a["partition"], a["props"])
        elif s.kind == "create_database":
            self.spark.sql(f"CREATE DATABASE `{a['name']}`")
        elif s.kind == "use":
            if not self.spark.catalog.databaseExists(a["name"]):
                raise QueryError(f"Unknown database {a['name']}")
            self.spark.catalog.setCurrentDatabase(a["name"])
        elif s.kind == "drop_table":
            t.drop(a["name"])
        elif s.kind == "alter_table":
            for what, arg in a["changes"]:
                if what == "add":
                    t.add_column(a["name"], arg)
                elif what == "drop":
                    t.drop_column(a["name"], arg)
                else:
                    t.set_property(a["name"], *arg)
        elif s.kind == "insert":
            self._insert(a["name"], a["columns"], a["rows"])
        elif s.kind == "insert_json":
            self.insert_json(a["name"], [a["json"]])
        elif s.kind == "show_tables":
            return self.spark.createDataFrame([(n, None) for n in t.names()], "table_name string, description string")
        elif s.kind == "describe_table":
            return t.describe(a["name"])
        elif s.kind == "describe_partitions":
            return t.partitions(a["name"])
        elif s.kind == "show_servers":
            return self._servers()
        elif s.kind == "import":
            for name, df in open_source(self.spark, a["url"], a["names"]).items():
                df.createOrReplaceTempView(name)
        elif s.kind != "begin":
            raise QueryError(f"can't run {s.kind}")
        return self._none()

    def _servers(self) -> DataFrame:
        sc = self.spark.sparkContext._jsc.sc()
        seen = sc.getExecutorMemoryStatus()
        it, rows = seen.keySet().iterator(), []
        while it.hasNext():
            host = it.next()
            rows.append((host, "SERVER_UP", host, self.spark.version, None, None, None))
        return self.spark.createDataFrame(rows, "name string, status string, listen_addr string, build_id string, load double, disk string, partitions string")

    # -- writing
    def _insert(self, name: str, columns: list[str] | None, rows: list[list]) -> None:
        schema = self.tables.schema(name) if self.tables.is_keyed(name) else self.spark.table(name).schema
        columns = columns or schema.names
        one = self.spark.range(1)
        scope = Scope(self.env, one, [])
        out = None
        for values in rows:
            if len(values) != len(columns):
                raise QueryError(f"{len(columns)} values are needed, {len(values)} are given")
            if any(isinstance(n, ast.Ref | ast.Star) for v in values for n in walk(v)):
                raise QueryError("insert into expression must contain only constant expressions")
            df = one.select(*[compile_expr(v, scope).cast(schema[c].dataType).alias(c) for c, v in zip(columns, values, strict=True)])
            out = df if out is None else out.union(df)
        self.tables.append(name, out)

    def insert(self, name: str, rows: list[dict]) -> None:
        """Upsert rows given as dicts (nested where the table is)."""
        self.insert_json(name, [json.dumps(r, default=str) for r in rows])

    def insert_json(self, name: str, objects: list[str]) -> None:
        schema = self.tables.schema(name)
        lines = self.spark.createDataFrame([(o,) for o in objects], "j string")
        self.tables.append(name, lines.select(F.from_json("j", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*"))

    def insert_csv(self, name: str, lines: list[str], **options) -> None:
        """Upsert rows given as CSV lines in the order of the table's columns; ``options`` are those of Spark's ``from_csv``."""
        schema = self.tables.schema(name)
        rows = self.spark.createDataFrame([(x,) for x in lines], "l string")
        self.tables.append(name, rows.select(F.from_csv("l", schema.simpleString()[7:-1].replace(":", " "), {"mode": "FAILFAST", **options}).alias("r")).select("r.*"))

    # -- tables
    def create_table(self, name: str, columns: list[ast.Column], primary_key: list[str], partition_key: str | None = None, **properties: str) -> None:
        self.tables.create(name, columns, primary_key, partition_key, properties)

    def add_field(self, name: str, column: ast.Column) -> None:
        self.tables.add_column(name, column)

    def remove_field(self, name: str, column: str) -> None:
        self.tables.drop_column(name, column)

    def list_tables(self) -> list[str]:
        return self.tables.names()

    def describe_table(self, name: str) -> DataFrame:
        return self.tables.describe(name)

    def drop_table(self, name: str) -> None:
        self.tables.drop(name)

    def import_file(self, name: str, path: str, kind: str = "csv", **options) -> None:
        """Append a CSV or JSON file to a table."""
        schema = self.tables.schema(name)
        df = read_json(self.spark, path, schema) if kind == "json" else read_csv(self.spark, path, **options)
        self.tables.append(name, df)

    def upsert(self, name: str, changes: DataFrame) -> None:
        self.tables.append(name, changes)

    merge = staticmethod(merge)

    # -- functions
    def register_function(self, name: str, fn: Callable[..., Column]) -> None:
        """A scalar function of columns: built from Spark's own, or a pandas UDF."""
        self.env.functions[name.lower()] = fn

    def register_aggregate(self, name: str, fn: Callable[..., Column]) -> None:
        """An aggregate of columns, such as a grouped-aggregate pandas UDF."""
        self.env.aggregates[name.lower()] = fn

    # -- map and reduce
    def map_table(self, *args, **kw) -> Job:
        return self.mapreduce.map_table(*args, **kw)

    def reduce(self, *args, **kw) -> Job:
        return self.mapreduce.reduce(*args, **kw)
