"""Shared plumbing: shared-folder tables, bounded text batches, prefix sums."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship

#: Bytes of text that one Python step works on at a time.
SLICE_BYTES = 1 << 19
NULL_KEY = -(1 << 63)
#: Rows of a range of :func:`prefix_sum`, about, where there are so many that the usual number of partitions would hold more.
RANGE_ROWS = 2_000_000


#: Rows of an Arrow batch, at most: long texts stay within a worker's memory.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """Let workers import this package and get their rows in small batches."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach.

    It is the session's ``spark.checkpoint.dir``. Only a single-process local
    session (tests) may go without the setting and gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by the cluster")
    folder = tempfile.mkdtemp(prefix="tideline-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    made = f"file://{folder}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tideline-{uuid.uuid4().hex[:12]}-{name}"


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and reread it, which cuts its lineage."""
    spark = df.sparkSession
    prepare(spark)
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._tideline_path = path
    return back


def discard(*frames: DataFrame) -> None:
    """Delete tables made by :func:`materialize` that no result reads any more."""
    for df in frames:
        path = getattr(df, "_tideline_path", None)
        if path:
            discard_path(df.sparkSession, path)


def discard_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of plans that are done with."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: A table of row marks is sent to every executor up to this many bytes, else joined by shuffle.
BROADCAST_BYTES = 16 << 20


def fresh_names(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted``, lengthened where ``df`` has a column of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def drop_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows of ``gone`` (doc_id, row_hash: xxhash64 of the text); columns stay."""
    id_, hash_ = fresh_names(docs, "_id", "_hash")
    gone = materialize(gone.select(F.col("doc_id").alias(id_), F.col("row_hash").alias(hash_)).distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() * 24 <= BROADCAST_BYTES else gone
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone[id_]) & (F.xxhash64(docs["text"].cast("string")) == gone[hash_]), "left_anti")


_caches: dict[str, Callable[[], None]] = {}


def only_cache(name: str, forget: Callable[[], None] | None = None) -> None:
    """Give back what other operators keep in this Python worker, which outlives a stage; keep what ``forget`` would drop."""
    others = [k for k in _caches if k != name]
    for k in others:
        _caches.pop(k)()
    if forget is not None:
        _caches[name] = forget
    if others:
        gc.collect()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library keeps its own counsel


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of text (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield batch.slice(start)


def prefix_sum(df: DataFrame, key: str, value: Column, out: str, ties: list[str] | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows before this one by ``key``, then ``ties``.

    Rows are dealt into ranges of their order, whose bounds Spark samples, and
    written with the number of their range; sums run inside each range, and
    only the ranges' totals, one row for each, are summed in one task. Ids may
    be dense, sparse or repeated. Null keys come first. ``df`` is read twice:
    pass a materialized table.
    """
    k, v, part, inner, offset = fresh_names(df, "_key", "_value", "_part", "_inner", "_offset")
    base = df.withColumn(k, F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY))).withColumn(v, value.cast("long"))
    order = [F.col(k), *[F.col(c).asc_nulls_first() for c in ties or []]]
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // RANGE_ROWS + 1)
    base = materialize(base.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()), "ranges")
    before = lambda *of: (Window.partitionBy(*of) if of else Window).orderBy(*(order if of else [part])).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    totals = base.groupBy(part).agg(F.sum(v).alias("_total")).select(part, F.coalesce(F.sum("_total").over(before()), zero).alias(offset))
    rows = base.withColumn(inner, F.coalesce(F.sum(v).over(before(part)), zero)).join(F.broadcast(totals), part)  # as many rows as ranges
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(inner) + F.col(offset)).alias(out))
