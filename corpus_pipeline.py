"""A training corpus from raw documents, in five stages; each reads what the one before it wrote.

All but the last stage keep the documents' columns, extra ones as well, whatever their names. Null texts are empty documents: they take the classifier's
score, are near no other, hold no passage and count no words, so the mix leaves them out; null doc_ids, langs and sources are values of their own. Repeated rows are
near duplicates of each other: one stays. Without labels nothing is rejected, without a benchmark nothing is decontaminated; without documents every stage
gives no rows. Very long texts go through every stage whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chromatid.llm import cotrain, decontam, mixing, ngram_join, token_store
from chromatid.llm.common import drop_stored, new_path, read, stored, stored_so_far
from chromatid.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the co-trained classifier rejects."""
    return cotrain.keep_good(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates."""
    return ngram_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of the benchmark."""
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents, so that sources come to their target weights."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token store and returns each document's digest, read back from it."""
    path = new_path(spark, "corpus")
    token_store.write_store(docs, path, tokenizer_path())
    return token_store.read_digests(spark, path)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("tokens", tokens),
]
#: The stages' models and searches have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what a stage stored for itself is deleted once its rows are written."""
    out, before = read(spark, sf_dir, "documents"), stored_so_far()
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if k < len(STAGES) - 1:
            out = stored(out, name)
            drop_stored(spark, keep=out, since=before)
    return out
