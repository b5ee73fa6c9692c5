"""The pipeline against plain Python on the same rows."""

import duckdb
from pyspark.sql import functions as F
from test_operators import brute_components, brute_counts, library

import corpus_pipeline
from tideline.llm import langid, packing, quality, secrets


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    columns, kept = docs.columns, dict(rows)
    frames = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
        frames.append(docs)

    model = langid.train(*map(list, zip(*langid.sample(spark.read.parquet(f"{data}/documents.parquet")), strict=True)))
    kept = {d: r for d, r in kept.items() if model.predict([r.text])[0][2]}
    assert {r.doc_id for r in frames[0].collect()} == set(kept)

    # So few labels prove no cutoff: the base rule alone decides.
    labels = dict(duckdb.sql(f"select doc_id, quality from '{data}/labels.parquet'").fetchall())
    assert len(labels) < 700
    counts = {d: brute_counts(r.text) for d, r in kept.items()}
    kept = {d: r for d, r in kept.items() if not (counts[d][0] < 50 or 100 * counts[d][4] > 50 * counts[d][0])}
    assert {r.doc_id for r in frames[1].collect()} == set(kept)

    where = brute_components([(d, r.text) for d, r in kept.items()])
    kept = {d: r for d, r in kept.items() if where[d][1] == d}
    assert {r.doc_id: r.text for r in frames[2].collect()} == {d: r.text for d, r in kept.items()}

    masked = {d: secrets.mask(r.text, secrets.find_spans(r.text, secrets.trained())[1]) for d, r in kept.items()}
    got = frames[3].collect()
    assert {r.doc_id: (r.text, r.n_chars, r.source) for r in got} == {d: (t, len(t), kept[d].source) for d, t in masked.items()}
    assert all(f.columns == columns for f in frames[:4])

    ids = library("word_bpe_49k.json")
    want = sorted((d, *p) for d, t in masked.items() for p in packing.binary_pieces(len(ids(t)) + 1))
    assert sorted((r.doc_id, r.start, r.length) for r in frames[4].collect()) == want


def test_run(spark, data, tmp_path):
    rows = corpus_pipeline.run(spark, data)
    assert rows.count() > 0 and rows.agg(F.max("length")).first()[0] <= packing.SEQUENCE_TOKENS


def test_empty_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
    assert docs.count() == 0
    assert quality.GRID
