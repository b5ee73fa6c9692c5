"""Media columns: content-defined chunking of payloads.

A payload (UTF-8 bytes of a text, zero-padded to a positive multiple of 64, one
byte per 8-bit sample) is cut by a rolling gear hash. Chunk digests are
deduplicated by Spark joins. A chunk that is referenced once stays in its
document's record (the ordered chunk list and a compressed blob); one that is
referenced more often is stored once, by its first reference, among the shared
chunks. So every distinct chunk is stored once, most documents are rebuilt from
their own record without a shuffle, and only shared chunks travel by digest.

Stored form of a document: its manifest (``HEAD``, the number of chunks, then
for each chunk its digest and length), the compressed chunks of its record, and
each shared chunk as it is stored, in order.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, discard_path, materialize, new_path, prepare, table, text_slices

UNIT = 64
MIN_BYTES, MASK_BITS, MAX_BYTES = 1024, 11, 16384
WINDOW = 32
DIGEST_BYTES = 16
HEAD = b"TLMC1\n"
#: Which chunks are shared, by document: sent to every executor up to this many bytes, else joined by shuffle.
BROADCAST_BYTES = 32 << 20


def _gear() -> np.ndarray:
    x = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


_TABLE = _gear()


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(unpadded length, payload) of a text."""
    raw = (text or "").encode("utf-8")
    n = len(raw)
    return n, raw + bytes(-n % UNIT if n else UNIT)


def cut_points(payload: bytes) -> list[int]:
    """Ends of a payload's chunks; the last is its length."""
    n = len(payload)
    if n <= MIN_BYTES:
        return [n]
    h = _TABLE[np.frombuffer(payload, np.uint8)]
    step = 1
    while step < WINDOW:
        h[step:] = h[step:] + (h[:-step] << np.uint64(step))
        step *= 2
    hits = np.flatnonzero((h >> np.uint64(WINDOW)) & np.uint64((1 << MASK_BITS) - 1) == 0) + 1
    out, at, k = [], 0, 0
    while n - at > MIN_BYTES:
        k += int(np.searchsorted(hits[k:], at + MIN_BYTES))
        at = min(int(hits[k]) if k < len(hits) else n, at + MAX_BYTES, n)
        out.append(at)
    if at < n:
        out.append(n)
    return out


def chunks_of(payload: bytes) -> tuple[list[bytes], list[bytes]]:
    """(chunks, digests) of a payload, in order."""
    ends = cut_points(payload)
    parts = [payload[a:b] for a, b in zip([0, *ends], ends)]
    return parts, [hashlib.sha256(p).digest()[:DIGEST_BYTES] for p in parts]


def chunk_list(digests: list[bytes], lengths: list[int]) -> bytes:
    return HEAD + struct.pack("<I", len(digests)) + b"".join(d + struct.pack("<I", n) for d, n in zip(digests, lengths, strict=True))


def features_of(payload: bytes) -> str:
    """Sample count, mean and root mean square of the bytes as 8-bit samples, and zero crossings about 128."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    above = x >= 128
    crossings = int(np.count_nonzero(above[1:] != above[:-1]))
    return f"n={len(x)};mean={int(x.sum()) * 1000 // len(x)};power={int((x * x).sum()) // len(x)};crossings={crossings}"


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash that tells rows with one doc_id apart."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("row_hash", F.xxhash64("text"))


def chunk_references(docs: DataFrame) -> DataFrame:
    """(doc_id, row_hash, seq, digest): every chunk of every document, without its bytes."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                cols: list[list] = [[], [], [], []]
                for doc, text, h in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "row_hash")), strict=True):
                    own = chunks_of(payload_of(text)[1])[1]
                    for c, v in zip(cols, ([doc] * len(own), [h] * len(own), range(len(own)), own), strict=True):
                        c.extend(v)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "row_hash", "seq", "digest"])

    return _rows(docs).mapInArrow(run, "doc_id long, row_hash long, seq int, digest binary")


def shared_chunks(refs: DataFrame) -> DataFrame:
    """(doc_id, row_hash, shared, lent): numbers of a document's chunks that are
    referenced more than once, and of those whose first reference is here."""
    at = F.struct("doc_id", "row_hash", "seq")
    # Written out, so that the join below reads two exchanges and Spark can split a hot digest.
    many = materialize(refs.groupBy("digest").agg(F.min(at).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "many")
    marked = refs.join(many, "digest").withColumn("owns", at.eqNullSafe(F.col("first")))
    return marked.groupBy("doc_id", "row_hash").agg(F.collect_set("seq").alias("shared"), F.collect_set(F.when(F.col("owns"), F.col("seq"))).alias("lent"))


def read_list(manifest: bytes) -> tuple[list[bytes], list[int]]:
    """(digests, lengths) of a manifest."""
    at = len(HEAD)
    (n,) = struct.unpack_from("<I", manifest, at)
    if manifest[:at] != HEAD or len(manifest) != at + 4 + n * (DIGEST_BYTES + 4):
        raise ValueError("a manifest is damaged")
    rows = list(struct.iter_unpack(f"<{DIGEST_BYTES}sI", manifest[at + 4 :]))
    return [d for d, _ in rows], [k for _, k in rows]


_OBJECT = "kind string, doc_id long, row_hash long, n_bytes long, manifest binary, shared array<int>, blob binary, digest binary"


def store_media(docs: DataFrame, out: str) -> str:
    """Write the media column to ``out`` (Parquet): ``kind=record`` has one row per
    document, ``kind=shared`` each chunk that is referenced more than once.

    Rows alike in doc_id and text own the same chunks; where there are such,
    ``kind=once`` takes the place of ``kind=shared``, without the repeats.
    """
    refs = materialize(chunk_references(docs), "refs")
    shared = materialize(shared_chunks(refs), "shared")
    repeated = refs.filter("seq = 0").groupBy("doc_id", "row_hash").count().filter("count > 1").limit(1).collect()
    discard(refs)
    size = shared.agg(F.sum(F.size("shared") * 8 + 48)).first()[0] or 0
    side = shared.select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash"), "shared", "lent")
    side = F.broadcast(side) if size <= BROADCAST_BYTES else side
    base = _rows(docs)
    joined = base.join(side, base["doc_id"].eqNullSafe(side["_id"]) & (base["row_hash"] == side["_hash"]), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in text_slices(batch):
                rows: list[tuple] = []
                for doc, text, h, away, lent in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "row_hash", "shared", "lent")), strict=True):
                    n, payload = payload_of(text)
                    parts, digests = chunks_of(payload)
                    away = sorted(away or ())
                    apart = set(away)
                    own = b"".join(p for i, p in enumerate(parts) if i not in apart)
                    rows.append(("record", doc, h, n, chunk_list(digests, [len(p) for p in parts]), away, pack.compress(own), None))
                    rows += [("shared", None, None, None, None, None, pack.compress(parts[i]), digests[i]) for i in lent or ()]
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _OBJECT.split(", ")])

    joined.select("doc_id", "text", "row_hash", "shared", "lent").mapInArrow(run, _OBJECT).write.partitionBy("kind").option("compression", "none").parquet(out)
    if repeated:
        spark = docs.sparkSession
        many = spark.read.schema(_OBJECT).parquet(out).filter("kind = 'shared'")
        once = many.groupBy("digest").agg(F.min("blob").alias("blob")).withColumn("kind", F.lit("once"))
        once.write.mode("append").partitionBy("kind").option("compression", "none").parquet(out)
        discard_path(spark, f"{out}/kind=shared")
    return out


def _checked(body: bytes, digest: bytes) -> bytes:
    if hashlib.sha256(body).digest()[:DIGEST_BYTES] != digest:
        raise ValueError(f"chunk {digest.hex()} is damaged")
    return body


_RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long"


def _rebuild(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        names = ("doc_id", "n_bytes", "manifest", "shared", "blob", "fetched")
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part, rows = batch.slice(i, 64), []
                for doc, n, manifest, away, blob, more in zip(*(part.column(c).to_pylist() for c in names), strict=True):
                    lent, apart = {x["digest"]: x["blob"] for x in more or ()}, set(away)
                    own, at, parts = unpack(blob), 0, []
                    digests, lengths = read_list(manifest)
                    form, size_of_form = hashlib.sha256(manifest + blob), len(manifest) + len(blob)
                    for j, (d, size) in enumerate(zip(digests, lengths, strict=True)):
                        if j in apart:
                            form.update(lent[d])
                            size_of_form += len(lent[d])
                            parts.append(_checked(unpack(lent[d]), d))
                        else:
                            parts.append(_checked(own[at : at + size], d))
                            at += size
                    payload = b"".join(parts)
                    rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), size_of_form, form.hexdigest(), features_of(payload), len(digests), payload))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                width = 9 + with_payload
                arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays[:width], ([x.split()[0] for x in _RESULT.split(", ")] + ["payload"])[:width])

    return run


def read_media(spark: SparkSession, out: str, with_payload: bool = False) -> DataFrame:
    """Rebuild every stored payload, check each chunk's digest and describe it.

    Documents without shared chunks need no shuffle; for the others the shared
    chunks travel to the records by digest, then by document.
    """
    prepare(spark)
    objects = spark.read.schema(_OBJECT).parquet(out)
    records, shared = objects.filter("kind = 'record'").drop("kind", "digest"), objects.filter("kind in ('shared', 'once')").select("digest", "blob")
    alone = records.filter(F.size("shared") == 0).withColumn("fetched", F.lit(None).cast("array<struct<digest:binary,blob:binary>>"))
    borrowers = records.filter(F.size("shared") > 0)
    # A digest stands at a fixed place of the manifest.
    at = lambda i: F.call_function("substring", F.col("manifest"), F.lit(len(HEAD) + 5) + i * (DIGEST_BYTES + 4), F.lit(DIGEST_BYTES))
    wanted = borrowers.select("doc_id", "row_hash", F.explode(F.array_distinct(F.transform("shared", at))).alias("digest")).distinct()
    fetched = wanted.join(shared, "digest").groupBy("doc_id", "row_hash").agg(F.collect_list(F.struct("digest", "blob")).alias("fetched"))
    f = fetched.select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash"), "fetched")
    both = borrowers.join(f, borrowers["doc_id"].eqNullSafe(f["_id"]) & borrowers["row_hash"].eqNullSafe(f["_hash"]))
    cols = ["doc_id", "n_bytes", "manifest", "shared", "blob", "fetched"]
    return alone.select(cols).union(both.select(cols)).mapInArrow(_rebuild(with_payload), _RESULT + (", payload binary" if with_payload else ""))


def media_column(docs: DataFrame) -> DataFrame:
    """Store the texts of ``docs`` as media, read them back and describe each.

    Null or empty text: 64 zero bytes, n_bytes 0. Null doc_id: stored like any
    other. Repeated rows: a row each; equal texts get equal values. Empty
    table: no rows. Other columns are ignored. Texts of any length are stored
    whole.
    """
    out = store_media(docs, new_path(docs.sparkSession, "media"))
    return read_media(docs.sparkSession, out)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_column(table(spark, sf_dir, "documents"))
