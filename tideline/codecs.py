"""Results as text tables, JSON, server-sent events and a binary stream."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cell(c: Column, kind: T.DataType) -> Column:
    """A value as the codecs print it: times as civil time, null as NULL."""
    if isinstance(kind, T.TimestampType):
        c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    elif isinstance(kind, T.ArrayType | T.StructType | T.MapType):
        c = F.to_json(c)
    return F.coalesce(c.cast("string"), F.lit("NULL"))


def printed(df: DataFrame) -> DataFrame:
    """``df`` with every cell as text; rendering happens on the executors."""
    names = [f"c{i}" for i in range(len(df.columns))]
    flat = df.toDF(*names)
    return flat.select(*[cell(F.col(n), f.dataType).alias(n) for n, f in zip(names, flat.schema, strict=True)])


def rows(df: DataFrame) -> Iterator[list[str]]:
    for r in printed(df).toLocalIterator():
        yield list(r)


def to_json(df: DataFrame) -> str:
    return json.dumps({"type": "table", "columns": df.columns, "rows": list(rows(df))}, ensure_ascii=False)


def to_ascii(df: DataFrame) -> str:
    table = [df.columns, *rows(df)]
    widths = [max(len(r[i]) for r in table) for i in range(len(df.columns))]
    bar = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    lines = ["|" + "|".join(f" {v:<{w}} " for v, w in zip(r, widths, strict=True)) + "|" for r in table]
    return "\n".join([bar, lines[0], bar, *lines[1:], *([bar] if len(lines) > 1 else [])])


def to_json_sse(df: DataFrame) -> Iterator[str]:
    """Events: progress before, the result, and the end."""
    yield 'event: status\ndata: {"status":"running","progress":0.0}\n\n'
    yield f"event: result\ndata: {json.dumps({'results': [json.loads(to_json(df))]}, ensure_ascii=False)}\n\n"
    yield 'event: status\ndata: {"status":"finished","progress":1.0}\n\n'


def to_binary(df: DataFrame) -> Iterator[bytes]:
    """A header with the column names, then a frame per row; texts carry their length first."""
    text = lambda s: struct.pack("<I", len(b := s.encode())) + b
    yield b"TLR1" + struct.pack("<I", len(df.columns)) + b"".join(map(text, df.columns))
    for r in rows(df):
        yield b"\x01" + b"".join(map(text, r))
    yield b"\x00"


def from_binary(raw: bytes) -> tuple[list[str], list[list[str]]]:
    at = 8

    def text() -> str:
        nonlocal at
        (n,) = struct.unpack_from("<I", raw, at)
        at += 4 + n
        return raw[at - n : at].decode()

    (width,) = struct.unpack_from("<I", raw, 4)
    columns, out = [text() for _ in range(width)], []
    while raw[at] == 1:
        at += 1
        out.append([text() for _ in range(width)])
    return columns, out
