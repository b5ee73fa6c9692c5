"""The documents of a corpus on their way to training sequences.

Each stage works on all rows its predecessor kept and takes (spark, docs,
sf_dir); all but the last return the columns of ``documents``. Between stages
the rows are written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import langid, ngram_join, packing, quality, secrets
from tideline.llm.common import materialize, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not recognized go: null and letterless texts, and those under the calibrated limit. Repeats: each is judged. Empty table: stays empty."""
    return langid.keep_accepted(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a risk-controlled cutoff rejects go, null and empty texts among them. Repeats: each is judged. Empty table: stays empty."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar texts stays: the least doc_id. Null and wordless texts are like nothing and stay. Empty table: stays empty."""
    return ngram_join.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every row stays. Null text: stays null. Empty table: stays empty."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is cut into sequences of binary length. Null and empty texts: the end id alone. Repeats: each is packed. Empty table: no rows."""
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secrets", secret_scan),
    ("packing", pack_sequences),
]

#: Training, tagging and tokenizing are beyond SQL; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
