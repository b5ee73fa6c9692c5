"""Language identification with averaged hashed subword embeddings.

A text's vector is the mean of the embeddings of its letter n-grams (2 to 4
bytes of lower-cased words with their borders, hashed to a fixed table); a
linear softmax over it gives the languages. Embeddings and weights are trained
together by stochastic gradient descent in numpy on a bounded sample of
labelled rows; a temperature and a rejection limit are then fitted on labelled
rows that training did not see.

Since mean and softmax layer are linear, a worker keeps only the product of
both tables, one row of class scores per n-gram bucket.
"""

from __future__ import annotations

import dataclasses
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only_cache, prepare, table, text_slices

#: Rows fitted on, at most: per language, and in all; and the languages, the most frequent ones.
SAMPLE_PER_LANG, SAMPLE_ROWS, SAMPLE_LANGS = 600, 6000, 256
BUCKET_BITS, DIMENSIONS, GRAMS = 16, 16, (2, 3, 4)
EPOCHS, RATE, SEED = 6, 0.5, 11
#: Share of correctly labelled calibration rows that the rejection limit may turn away.
FALSE_REJECTION = 0.001
#: Where the limit lies between a blind guess (0) and the probability that this share of right answers stays under (1):
#: a corpus holds shorter and odder texts than the calibration rows, and clean ones among them should stay.
MARGIN = 0.5
HELD_OUT_REMAINDER = 2
UNKNOWN = "und"
_FACTORS = {2: 0x9E3779B1, 3: 0x85EBCA77, 4: 0xC2B2AE3D}


def _letters_table() -> np.ndarray:
    """Byte -> itself for letters and all bytes of non-ASCII characters (A-Z lower-cased), else 0."""
    out = np.zeros(256, np.uint8)
    out[128:] = np.arange(128, 256)
    for c in range(ord("a"), ord("z") + 1):
        out[c] = out[c - 32] = c
    return out


_BYTES = _letters_table()


def gram_buckets(raw: bytes) -> Iterator[np.ndarray]:
    """For each n, the bucket of the n-gram at every position, or -1 where it holds no letter or spans words."""
    x = _BYTES[np.frombuffer(raw, np.uint8)].astype(np.uint32)
    for n in GRAMS:
        if len(x) < n:
            continue
        parts = [x[i : len(x) - n + 1 + i] for i in range(n)]
        code = parts[0].copy()
        for p in parts[1:]:
            code = code * np.uint32(257) + p
        inner = np.ones(len(code), bool)
        for p in parts[1:-1]:  # a border may only stand at either end
            inner &= p > 0
        inner &= (parts[0] > 0) | (parts[-1] > 0)
        code *= np.uint32(_FACTORS[n])
        out = ((code ^ (code >> np.uint32(15))) & np.uint32((1 << BUCKET_BITS) - 1)).astype(np.int32)
        out[~inner] = -1
        yield out


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


@dataclasses.dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # (buckets, languages), the product of embeddings and weights
    bias: np.ndarray
    temperature: float = 1.0
    limit: float = 0.0

    def logits(self, texts: list[str]) -> np.ndarray:
        """A row of class logits per text; whole texts, in slices of bounded size."""
        raws = [t.encode("utf-8", "replace") for t in texts]
        sums, counts = np.zeros((len(raws), len(self.langs))), np.zeros(len(raws))
        # Texts share one buffer with a border between them, so short ones cost little.
        buffer = b"\n" + b"\n".join(raws) + b"\n"
        starts = np.cumsum([1] + [len(r) + 1 for r in raws[:-1]]) if raws else np.zeros(0, int)
        for a, b in zip(*_blocks(len(buffer)), strict=True):
            piece = buffer[a : min(len(buffer), b + max(GRAMS) - 1)]
            for n, code in zip(GRAMS, gram_buckets(piece), strict=False):
                at = np.flatnonzero(code[: b - a] >= 0)
                owner = np.clip(np.searchsorted(starts, at + a + (n > 1), "right") - 1, 0, None)
                hits = self.scores[code[at]]
                edges = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, int)
                if len(edges):
                    sums[owner[edges]] += np.add.reduceat(hits, edges, axis=0)
                    counts += np.bincount(owner, minlength=len(raws))
        return sums / np.maximum(counts, 1)[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, accepted) of each text."""
        known = [i for i, t in enumerate(texts) if t and has_letter(t)]
        out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, False)] * len(texts)
        if known and self.langs:
            p = softmax(self.logits([texts[i] for i in known]) / self.temperature)
            best = p.argmax(1)
            for i, k, row in zip(known, best.tolist(), p, strict=True):
                out[i] = (self.langs[k], float(row[k]), bool(row[k] >= self.limit))
        return out


def _blocks(n: int, size: int = 1 << 18) -> tuple[list[int], list[int]]:
    starts = list(range(0, n, size))
    return starts, [min(n, s + size) for s in starts]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[str], langs: list[str], seed: int = SEED) -> Model:
    """Fit a model; every fifth row (in the given order) is for calibration only."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros(0))
    y = np.array([names.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSIONS))
    out, bias = rng.normal(0, 0.1, (DIMENSIONS, len(names))), np.zeros(len(names))
    bags = []
    for t in texts:
        codes = np.concatenate([c[c >= 0] for c in gram_buckets(b"\n" + t.encode("utf-8", "replace") + b"\n")] or [np.zeros(0, np.int32)])
        ids, n = np.unique(codes, return_counts=True)
        bags.append((ids, n / max(1, n.sum())))
    rows = np.arange(len(texts))
    fit = rows[rows % 5 != 4] if len(rows) >= 5 else rows
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(fit):
            ids, w = bags[i]
            if not len(ids):
                continue
            mean = w @ emb[ids]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= rate * np.outer(mean, p)
            bias -= 0.1 * rate * p
            emb[ids] -= rate * len(GRAMS) * np.outer(np.sqrt(w), back)
    model = Model(names, (emb @ out).astype(np.float32), bias)
    held = rows[rows % 5 == 4] if len(rows) >= 5 else rows
    z = np.array([w @ model.scores[ids] + bias if len(ids) else bias for ids, w in (bags[i] for i in held)])
    grid = np.geomspace(0.25, 16, 25)
    loss = [-np.mean(np.log(softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12)) for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = softmax(z / model.temperature)
    right = np.sort(p.max(1)[p.argmax(1) == y[held]])
    # The highest limit that turns away no more than the allowed share of right answers.
    guess = 1 / len(names)
    model.limit = guess + MARGIN * (float(right[int(len(right) * FALSE_REJECTION)]) - guess) * 0.999 if len(right) else 0.0
    return model


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT_REMAINDER, F.lit(False))


def sample(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, rows: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """A bounded, repeatable sample of labelled rows that may be learnt from: about
    ``per_lang`` of each of the ``SAMPLE_LANGS`` most frequent languages and
    ``rows`` in all, by a hash of the row."""
    usable = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string"))
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE_LANGS).collect()
    pick = F.lit(False)
    draw = F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id"), F.length("text")), F.lit(1 << 53))
    for r in counts:
        pick = pick | ((F.col("lang") == r["lang"]) & (draw < int(min(1.0, per_lang / r["count"]) * (1 << 53))))
    drawn = usable.filter(pick).withColumn("h", F.xxhash64(F.lit(SEED + 1), "doc_id", F.length("text"))).orderBy("h", "doc_id").limit(rows)
    return [(r["text"], r["lang"]) for r in drawn.select("text", "lang").toLocalIterator()]


def fit(docs: DataFrame) -> Model:
    rows = sample(docs)
    return train([t for t, _ in rows], [x for _, x in rows])


_SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean"


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Predict the language of every text.

    Columns: doc_id, held_out, lang_pred, score, accepted (false under the
    calibrated limit). The model is fitted on ``docs`` unless given.

    Null text or one without a letter: ``und``, score 0, not accepted. Null
    doc_id: not held out. Null lang: never learnt from. Without any labelled
    row everything is ``und``. At most ``SAMPLE_LANGS`` languages are learnt,
    the most frequent ones. Ties go to the first language by name. Repeated
    rows: a row each. Empty table: no rows. Other columns are never read. Whole
    texts are scored.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))  # buckets x languages, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache("")
        for batch in batches:
            for part in text_slices(batch):
                got = shared.value.predict(part.column("text").to_pylist())
                arrays = [part.column("doc_id"), part.column("held_out"), *(pa.array([g[i] for g in got], k) for i, k in enumerate((pa.string(), pa.float64(), pa.bool_())))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out(F.col("doc_id")).alias("held_out")).mapInArrow(run, _SCHEMA)


def keep_accepted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` without the rows whose language is unknown or rejected; columns stay.

    Null, empty and very long texts, nulls, repeats, ties and empty tables: as in :func:`identify`.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache("")
        for batch in batches:
            for part in text_slices(batch):
                yield part.filter(pa.array([g[2] for g in shared.value.predict(part.column("text").to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
