"""The database that import_database fills, read by executors of their own and with odd values."""

import importlib.util
import os
import subprocess
import sys
from pathlib import Path

from tideline.queries import QUERIES

ROOT = Path(__file__).resolve().parent.parent

CLUSTER = """
import sys
from compare import connect, same
from pyspark.sql import SparkSession
from tideline.queries import ORACLE_SQL, QUERIES

data, home = sys.argv[1:]
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.session.timeZone": "UTC", "spark.sql.warehouse.dir": f"{home}/warehouse"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
for _ in range(2):
    same(QUERIES["import_database"](spark, data), ORACLE_SQL["import_database"], connect(data))
spark.stop()
"""


def test_on_a_cluster(data, tmp_path):
    """The driver and each executor are processes of their own, which share the warehouse only."""
    (tmp_path / "spark").mkdir()
    (tmp_path / "cwd").mkdir()
    for p in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():  # the executors' logs go to work in Spark's home
        if p.name != "work":
            (tmp_path / "spark" / p.name).symlink_to(p)
    env = os.environ | {"PYTHONPATH": f"{ROOT}:{ROOT / 'tests'}", "PYTHONDONTWRITEBYTECODE": "1", "PYSPARK_PYTHON": sys.executable, "SPARK_HOME": str(tmp_path / "spark"), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1"}
    env.pop("PYSPARK_GATEWAY_PORT", None)
    run = subprocess.run([sys.executable, "-c", CLUSTER, str(data), str(tmp_path)], env=env, cwd=tmp_path / "cwd", capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-3000:]
    assert not list((tmp_path / "warehouse").glob("catalogue-*"))


def test_odd_values(spark, data, tmp_path):
    """Nulls, empty strings, quotes, line ends, white space; an empty table."""
    rows = [(1, "", 4), (2, None, 5), (3, 'a"b,\n\r\nc;', 6), (None, " x ü\\ ", 7), (5, '"', 8), (6, "'", 9), (7, "x", 3), (8, "y", None)]
    for n, given in enumerate((rows, [])):
        folder = tmp_path / str(n)
        folder.mkdir()
        for p in Path(data).iterdir():
            if p.name != "supplier.parquet":
                (folder / p.name).symlink_to(p)
        spark.createDataFrame(given, "s_suppkey long, s_name string, s_nationkey int").repartition(3).write.parquet(f"{folder}/supplier.parquet")
        got = QUERIES["import_database"](spark, str(folder))
        assert dict(got.dtypes) == {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int"}
        assert sorted(map(tuple, got.collect()), key=str) == sorted((r for r in given if r[2] and r[2] > 3), key=str)
