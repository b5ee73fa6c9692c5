"""Content-addressed token store.

A document's ids (with the end id) are cut where a rolling gear hash over the
id stream matches a mask, so equal passages give equal chunks wherever they
stand. A chunk is stored once, under the digest of its bytes; a recipe lists a
document's chunks in order with a Merkle root over their digests. Reading back
re-digests every stored chunk, joins it to the recipes and checks each root.

Ids are kept as 16-bit little-endian integers, compressed per chunk; the
vocabulary must have fewer than 65,536 entries.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, new_path, prefix_sum, prepare, table, text_slices
from .tokenizing import crc_combiner, encoder, tokenizer_path

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
MIN_IDS, MASK_BITS, MAX_IDS = 256, 10, 8192
WINDOW = 16
DIGEST_BYTES = 16


def _gear() -> np.ndarray:
    """One pseudo-random 32-bit value for each 16-bit id, from a fixed mixing rule."""
    x = (np.arange(1 << 16, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(32)).astype(np.uint32)


_TABLE = _gear()


def cut_points(ids: np.ndarray, min_ids: int = MIN_IDS, mask_bits: int = MASK_BITS, max_ids: int = MAX_IDS) -> list[int]:
    """Ends of the chunks of one id stream (the last is its length)."""
    n = len(ids)
    if n == 0:
        return []
    if n <= min_ids:
        return [n]
    h = _TABLE[ids]
    step = 1
    while step < WINDOW:  # h[i] becomes the sum of table values shifted by their distance, over the window
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    # The mask looks at bits that the whole window reaches.
    hits = np.flatnonzero(h & np.uint32(((1 << mask_bits) - 1) << WINDOW) == 0) + 1
    out, at, k = [], 0, 0
    while n - at > min_ids:
        k += int(np.searchsorted(hits[k:], at + min_ids))
        cut = int(hits[k]) if k < len(hits) else n
        at = min(cut, at + max_ids, n)
        out.append(at)
    if at < n:
        out.append(n)
    return out


def merkle_root(digests: list[bytes]) -> bytes:
    """Root over the ordered digests; an odd node moves up unchanged."""
    level = list(digests) or [b""]
    while len(level) > 1:
        level = [hashlib.sha256(b"\x01" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


_OBJECTS = "kind string, row_key string, doc_id long, chunks array<binary>, root binary, digest binary, body binary"
#: Text encoded at a time: larger slices meet each distinct word less often.
SLICE_BYTES = 4 << 20


def encode_objects(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """A ``recipe`` row for each document, with its chunk digests in order, and a ``chunk``
    row with the compressed ids for each digest that is new to the task."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pack = encoder(path, False, "<u2"), zstandard.ZstdCompressor(level=1)
        seen, end = set(), end_id.to_bytes(2, "little")
        for batch in batches:
            for part in text_slices(batch, limit=SLICE_BYTES):
                rows: list[tuple] = []
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc, raw in zip(part.column("doc_id").to_pylist(), enc.encode(texts), strict=True):
                    raw += end
                    ends = cut_points(np.frombuffer(raw, "<u2"))
                    bodies = [raw[2 * a : 2 * b] for a, b in zip([0, *ends], ends)]
                    digests = [hashlib.sha256(b).digest()[:DIGEST_BYTES] for b in bodies]
                    root = merkle_root(digests)
                    key = f"{doc}:{root.hex()}"  # rows alike in id and text share it
                    rows.append(("recipe", key, doc, digests, root, None, None))
                    for d, b in zip(digests, bodies, strict=True):
                        if d not in seen:
                            seen.add(d)
                            rows.append(("chunk", None, None, None, None, d, pack.compress(b)))
                kinds = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _OBJECTS.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _OBJECTS)


def write_store(docs: DataFrame, out: str, path: str | None = None, end_id: int = END_ID) -> str:
    """Encode ``docs`` and write the store to ``out``; returns ``out``.

    ``objects/kind=chunk`` holds each distinct chunk once, ``recipes`` the
    documents in ascending doc_id order: their chunk digests and Merkle root.
    One shuffle carries the ids; a hot chunk crosses it once per task at most.
    """
    spark = docs.sparkSession
    spread = F.when(F.col("kind") == "chunk", F.xxhash64("digest")).otherwise(F.xxhash64("row_key"))
    objects = encode_objects(docs, path or tokenizer_path(VOCABULARY), end_id)
    # Rows are dealt by a hash, so a digest's chunk rows meet; all but one of them go.
    once = Window.partitionBy("_spread", "digest").orderBy("kind")
    objects = objects.withColumn("_spread", spread).repartition("_spread").withColumn("_n", F.row_number().over(once)).filter("kind = 'recipe' or _n = 1").drop("_spread", "_n")
    objects.write.partitionBy("kind").option("compression", "none").parquet(f"{out}/objects")
    recipes = _objects(spark, out, "recipe").select("doc_id", "row_key", "root", "chunks")
    recipes.orderBy("doc_id", "row_key").write.parquet(f"{out}/recipes")
    return out


def _objects(spark: SparkSession, out: str, kind: str) -> DataFrame:
    return spark.read.schema(_OBJECTS).parquet(f"{out}/objects").filter(F.col("kind") == kind)


def verified_chunks(spark: SparkSession, out: str, with_ids: bool = False) -> DataFrame:
    """Read the stored chunks back; a body that does not match its digest fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            digests = batch.column("digest").to_pylist()
            bodies = [unpack.decompress(b) for b in batch.column("body").to_pylist()]
            for d, b in zip(digests, bodies, strict=True):
                if hashlib.sha256(b).digest()[:DIGEST_BYTES] != d:
                    raise ValueError(f"chunk {d.hex()} is damaged")
            ids = [np.frombuffer(b, "<u2").astype("<u4") for b in bodies]
            cols = [pa.array(digests, pa.binary()), pa.array([len(x) for x in ids], pa.int32()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())]
            if with_ids:
                cols.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, ["digest", "n", "crc", "ids"][: len(cols)])

    prepare(spark)
    return _objects(spark, out, "chunk").select("digest", "body").mapInArrow(run, "digest binary, n int, crc long" + (", ids array<int>" if with_ids else ""))


def _recipe_rows(spark: SparkSession, out: str) -> DataFrame:
    recipes = spark.read.parquet(f"{out}/recipes")
    return recipes.select("doc_id", "row_key", "root", F.size("chunks").alias("n_chunks"), F.posexplode("chunks").alias("seq", "digest"))


def read_summaries(spark: SparkSession, out: str) -> DataFrame:
    """Per document, from the files: doc_id, n_tokens, ids_crc32, merkle_root and n_chunks.

    A document's crc is combined from those of its stored chunks, in recipe
    order, after its Merkle root has been recomputed from their digests.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        combine = crc_combiner()
        for batch in batches:
            rows: list[tuple] = []
            for doc, root, n_chunks, parts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "root", "n_chunks", "parts")), strict=True):
                copies = len(parts) // n_chunks  # a row repeated whole has its references repeated
                own = parts[::copies] if copies else []
                if len(parts) % n_chunks or [p["seq"] for p in own] != list(range(n_chunks)) or any(p["n"] is None for p in own) or merkle_root([p["digest"] for p in own]) != root:
                    raise ValueError(f"document {doc} cannot be rebuilt")
                n = crc = 0
                for p in own:
                    crc = combine(crc, p["crc"], 4 * p["n"])
                    n += p["n"]
                rows += [(doc, n, crc, root.hex(), n_chunks)] * copies
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            cols = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_tokens", "ids_crc32", "merkle_root", "n_chunks"])

    rows = _recipe_rows(spark, out)
    chunks = verified_chunks(spark, out)
    joined = rows.join(chunks, "digest", "left").groupBy("row_key", "doc_id", "root", "n_chunks").agg(F.sort_array(F.collect_list(F.struct("seq", "digest", "n", "crc"))).alias("parts"))
    return joined.select("doc_id", "root", "n_chunks", "parts").mapInArrow(fold, "doc_id long, n_tokens long, ids_crc32 long, merkle_root string, n_chunks long")


def read_documents(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, ids): the id streams rebuilt from the store, one row per stored document."""
    rows = _recipe_rows(spark, out).dropDuplicates(["row_key", "seq"])
    joined = rows.join(verified_chunks(spark, out, True), "digest").groupBy("row_key", "doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "ids"))).alias("p"))
    return joined.select("doc_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))


def store_and_read(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write a store in the shared folder, read it back and place each document.

    Columns: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32, merkle_root, n_chunks.

    Null or empty text: the end id alone. Null doc_id: stored, first in order.
    Repeated rows: a row each. Empty table: no rows. Other columns are ignored.
    Texts of any length are encoded whole.
    """
    spark = docs.sparkSession
    out = write_store(docs, new_path(spark, "store"), path, end_id)
    back = materialize(read_summaries(spark, out), "summaries")
    return prefix_sum(back, "doc_id", F.col("n_tokens"), "start", ties=["n_tokens", "ids_crc32"]).select("doc_id", "start", "n_tokens", "ids_crc32", "merkle_root", "n_chunks")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_read(table(spark, sf_dir, "documents"))
