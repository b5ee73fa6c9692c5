"""Make this package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Let workers import the package, whether or not it is installed there.

    A local session gets the path; a cluster gets a zip through Spark's own
    file distribution, unless ``PYTHONPATH`` names the package already.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tideline_shipped", False):
        return
    sc._tideline_shipped = True
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        there = sc.environment.get("PYTHONPATH", "")
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (str(ROOT), there) if x)
        return
    with tempfile.NamedTemporaryFile(suffix="-tideline.zip", delete=False) as f, zipfile.ZipFile(f, "w") as z:
        for p in (ROOT / "tideline").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(f.name)
