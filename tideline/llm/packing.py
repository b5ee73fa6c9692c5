"""Packing by power-of-two decomposition.

Each document's ids (with the end id) are cut into pieces of binary length: as
many of the longest length as fit, then one piece for each binary digit of the
rest, longest first. Every piece is a sequence of its own in the bucket of its
length, so sequences never cross documents and nothing is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, prefix_sum, prepare, text_slices
from .tokenizing import encoder, tokenizer_path

SEQUENCE_TOKENS = 2048
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def binary_pieces(n: int, longest: int = SEQUENCE_TOKENS) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; ``longest`` is a power of two."""
    whole, rest = divmod(n, longest)
    out = [(i * longest, longest) for i in range(whole)]
    at = whole * longest
    for k in range(longest.bit_length() - 2, -1, -1):
        if rest >> k & 1:
            out.append((at, 1 << k))
            at += 1 << k
    return out


def cut_documents(docs: DataFrame, path: str, sequence_tokens: int = SEQUENCE_TOKENS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document, with its ids if asked for."""
    if sequence_tokens < 1 or sequence_tokens & (sequence_tokens - 1):
        raise ValueError("sequence_tokens must be a power of two")

    prepare(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path, True), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in text_slices(batch):
                cols: list[list] = [[] for _ in range(6)]
                ids = part.column("doc_id").to_pylist()
                for doc, raw in zip(ids, enc.encode([t or "" for t in part.column("text").to_pylist()]), strict=True):
                    raw += end
                    n = len(raw) // 4
                    for start, length in binary_pieces(n, sequence_tokens):
                        body = raw[4 * start : 4 * (start + length)]
                        for col, v in zip(cols, (doc, start, length, zlib.crc32(body), n, body), strict=True):
                            col.append(v)
                arrays = [pa.array(c, pa.int64()) for c in cols[:5]]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    arrays.append(pa.array([np.frombuffer(b, "<u4").astype(np.int32) for b in cols[5]], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, _SCHEMA + (", ids array<int>" if with_ids else ""))


def pack(docs: DataFrame, path: str | None = None, sequence_tokens: int = SEQUENCE_TOKENS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pack all documents; one row per piece.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    (always 0), bucket (the length of the sequence), and ids if ``with_ids``.

    Null or empty text: the end id alone. Null doc_id: packed like any other,
    first in order. Repeated rows: each is packed. Empty table: no rows. Other
    columns are ignored. Texts of any length are cut, never shortened.
    """
    pieces = materialize(cut_documents(docs, path or tokenizer_path(VOCABULARY), sequence_tokens, end_id, with_ids), "pieces")
    numbered = prefix_sum(pieces, "doc_id", F.lit(1), "sequence_id", ties=["doc_tokens", "start", "ids_crc32"])
    return numbered.withColumns({"offset": F.lit(0).cast("long"), "bucket": F.col("length")})


def op7(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return pack(table(spark, sf_dir, "documents"))
