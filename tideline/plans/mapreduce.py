"""Map and reduce jobs over tables.

Keys and values are text (values usually JSON). A reducer sees its keys one
after another with an iterator over each key's values, read from sorted Arrow
batches, so a key never has to fit in memory; a combiner, where one is given,
runs over bounded tables of pairs as they are mapped, before anything is sorted
or shuffled, and takes the weight off hot keys.
"""

from __future__ import annotations

import hashlib
import json
import logging
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError

SCHEMA = "key string, value string"
log = logging.getLogger("tideline.mapreduce")
Pairs = Iterable[tuple[Any, Any]]


#: Pairs that a combiner holds at a time, in each task.
COMBINE_PAIRS = 200_000
#: A table of so many bytes for each core, at most, is dealt out before it is mapped.
SMALL_BYTES = 32 << 20


def _text(x: Any) -> str | None:
    if x is None or isinstance(x, str):
        return x
    return str(x) if type(x) is int else json.dumps(x, default=str)


def _combined(pairs: Iterator[tuple[Any, Any]], fn: Callable[[str, Iterator[str]], Pairs]) -> Iterator[tuple[Any, Any]]:
    """``pairs`` with those of one key put through ``fn`` whenever enough are held, and passed on once that no longer makes room."""
    held: dict[Any, list] = {}
    n = 0

    def combine() -> None:
        nonlocal held, n
        made: dict[Any, list] = {}
        n = 0
        for k, values in held.items():
            for k2, v2 in fn(k, iter(values)) or ():
                made.setdefault(_text(k2), []).append(_text(v2))
                n += 1
        held = made

    for k, v in pairs:
        k, v = _text(k), _text(v)
        if (values := held.get(k)) is None:
            held[k] = [v]
        else:
            values.append(v)
        n += 1
        if n >= COMBINE_PAIRS:
            combine()
            if 2 * n > COMBINE_PAIRS:
                yield from ((k, v) for k, values in held.items() for v in values)
                held, n = {}, 0
    combine()
    yield from ((k, v) for k, values in held.items() for v in values)


def _batches(pairs: Iterator[tuple[Any, Any]], size: int = 4096) -> Iterator[pa.RecordBatch]:
    keys: list = []
    values: list = []
    for k, v in pairs:
        keys.append(_text(k))
        values.append(_text(v))
        if len(keys) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.string())], ["key", "value"])
            keys, values = [], []
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.string())], ["key", "value"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
    for b in batches:
        yield from zip(b.column("key").to_pylist(), b.column("value").to_pylist(), strict=True)


def _spread(df: DataFrame) -> DataFrame:
    """A small table dealt to all cores, as it may lie in one file; a large one lies in many parts already."""
    n = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(n) if size <= n * SMALL_BYTES else df


class Job:
    """A step whose result is a table of keys and values.

    ``source`` is the table that a map step reads and how it makes pairs of a
    row, so that a combiner can run in the same pass.
    """

    def __init__(self, pairs: DataFrame, source: tuple[DataFrame, Callable[[dict], Pairs]] | None = None):
        self.pairs, self.source = pairs, source

    def cached(self) -> "Job":
        self.pairs, self.source = self.pairs.persist(), None
        return self

    def combined(self, fn: Callable[[str, Iterator[str]], Pairs]) -> "Job":
        """The pairs after ``fn`` has run over those of each key that are held together."""
        df, make = self.source or (self.pairs, None)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pairs = _rows(batches) if make is None else (pair for b in batches for row in b.to_pylist() for pair in make(row) or ())
            yield from _batches(_combined(pairs, fn))

        return Job(df.mapInArrow(run, SCHEMA))


class MapReduce:
    def __init__(self, engine):
        self.engine = engine
        self._kept: dict[str, Job] = {}

    def map_table(self, table: str | DataFrame, map_fn: Callable[..., Pairs], columns: list[str] | None = None, begin: Any = None, until: Any = None, key_column: str | None = None, params: dict | None = None, keep: bool = False) -> Job:
        """``map_fn(row[, params])`` gives (key, value) pairs for each row, a dict.

        Only ``columns`` are read; ``begin`` and ``until`` bound ``key_column``
        (the table's partition key by default) and reach the scan. ``keep``:
        the pairs are persisted under a digest of the table's name, the
        function and all arguments, and the same call finds them again.
        """
        if keep:
            if not isinstance(table, str):
                raise QueryError("only the pairs of a named table are kept")
            digest = hashlib.sha1(cloudpickle.dumps((table, map_fn, columns, begin, until, key_column, params))).hexdigest()
            if digest not in self._kept:
                self._kept[digest] = self.map_table(table, map_fn, columns, begin, until, key_column, params).cached()
            return self._kept[digest]
        df = table if isinstance(table, DataFrame) else self.engine._table(table)
        if begin is not None or until is not None:
            by = key_column or (self.engine.tables.properties(table).get("partition_key") if isinstance(table, str) else None)
            if not by:
                raise QueryError("a key range needs key_column or a partition key")
            df = df.filter(F.col(by) >= F.lit(begin)) if begin is not None else df
            df = df.filter(F.col(by) < F.lit(until)) if until is not None else df
        df = _spread(df.select(*columns) if columns else df)
        extra = () if params is None else (params,)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _batches(pair for b in batches for row in b.to_pylist() for pair in map_fn(row, *extra) or ())

        return Job(df.mapInArrow(run, SCHEMA), (df, lambda row: map_fn(row, *extra)))

    def forget(self) -> None:
        """Give up the pairs that were kept."""
        for job in self._kept.values():
            job.pairs.unpersist()
        self._kept.clear()

    @staticmethod
    def _gathered(sources: Job | list[Job], shards: int | None) -> DataFrame:
        jobs = sources if isinstance(sources, list) else [sources]
        pairs = jobs[0].pairs
        for j in jobs[1:]:
            pairs = pairs.unionByName(j.pairs)
        return pairs.repartition(shards, "key") if shards else pairs.repartition("key")

    def reduce(self, sources: Job | list[Job], reduce_fn: Callable[..., Pairs], shards: int | None = None, combine_fn: Callable[[str, Iterator[str]], Pairs] | None = None, params: dict | None = None) -> Job:
        """``reduce_fn(key, values[, params])`` gives pairs for each key."""
        extra = () if params is None else (params,)

        def over(fn, *more):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                groups = groupby(_rows(batches), key=lambda kv: kv[0])
                yield from _batches(pair for k, kvs in groups for pair in fn(k, (v for _, v in kvs), *more) or ())

            return run

        if combine_fn:
            jobs = sources if isinstance(sources, list) else [sources]
            sources = [j.combined(combine_fn) for j in jobs]
        dealt = self._gathered(sources, shards).sortWithinPartitions("key")
        return Job(dealt.mapInArrow(over(reduce_fn, *extra), SCHEMA))

    def join(self, sources: list[Job], map_fn: Callable[[str, dict], Pairs] | None = None, shards: int | None = None) -> Job:
        """Merge the JSON objects of each key; of one property the last source's value wins. A null value adds nothing."""
        marked = [Job(j.pairs.withColumn("value", F.concat(F.lit(f"{i:06d}"), F.coalesce("value", F.lit("null"))))) for i, j in enumerate(sources)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def merged() -> Iterator[tuple[str, Any]]:
                for k, kvs in groupby(_rows(batches), key=lambda kv: kv[0]):
                    whole: dict = {}
                    for _, v in kvs:
                        whole |= json.loads(v[6:]) or {}
                    yield from map_fn(k, whole) if map_fn else [(k, whole)]

            yield from _batches(merged())

        return Job(self._gathered(marked, shards).sortWithinPartitions("key", "value").mapInArrow(run, SCHEMA))

    def download_results(self, sources: Job | list[Job], serialize: Callable[[str, str], str] | None = None) -> Iterator[str]:
        """Lines of the result, one partition at a time."""
        line = serialize or (lambda k, v: json.dumps({"key": k, "value": v}))
        for j in sources if isinstance(sources, list) else [sources]:
            for r in j.pairs.toLocalIterator():
                yield line(r["key"], r["value"])

    def save_to_table(self, source: Job, table: str) -> None:
        """Upsert the values (JSON rows) into a table."""
        schema = self.engine.tables.schema(table)
        self.engine.tables.append(table, source.pairs.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*"))

    def broadcast(self, value: Any):
        return self.engine.spark.sparkContext.broadcast(value)

    @staticmethod
    def log(message: str) -> None:
        log.info(message)

    def run(self, tasks: list[dict], functions: dict[str, Callable]) -> dict[str, Any]:
        """A job graph: tasks with id, op (map_table, reduce, return_results, save_to_table) and sources.

        A failing task fails the graph.
        """
        made: dict[str, Any] = {}
        waiting = list(tasks)
        while waiting:
            ready = [t for t in waiting if all(s in made for s in t.get("sources", []))]
            if not ready:
                raise QueryError("the job graph has a circle or an unknown source")
            for t in ready:
                src = [made[s] for s in t.get("sources", [])]
                op = t["op"]
                if op == "map_table":
                    made[t["id"]] = self.map_table(t["table_name"], functions[t["map_fn"]], t.get("required_columns"), t.get("begin"), t.get("until"), t.get("key_column"), t.get("params"))
                elif op == "reduce":
                    made[t["id"]] = self.reduce(src, functions[t["reduce_fn"]], t.get("num_shards"), params=t.get("params"))
                elif op == "return_results":
                    made[t["id"]] = self.download_results(src, functions.get(t.get("serialize_fn", "")))
                elif op == "save_to_table":
                    for s in src:
                        self.save_to_table(s, t["table_name"])
                    made[t["id"]] = None
                else:
                    raise QueryError(f"unknown operation: {op}")
                waiting.remove(t)
        return made
