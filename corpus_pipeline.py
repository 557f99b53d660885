"""Corpus pipeline: language ID, near-duplicates, repeated passages, benchmark leaks, packing.

``run`` applies the stages to ``documents``; each stage's result is written and read
back before the next one starts, so a lost executor costs at most one stage.

What a stage decides: language ID drops the texts it rejects (null, without a letter, or far from every
learned language); near-dedup keeps one document of each group (shingles of five words, similarity of 0.8 or
more); substring dedup takes every word out that is covered by a passage of 35 words occurring
elsewhere, and a document that loses all its words stays with an empty text; decontamination drops
documents that hold a benchmark item; packing returns the pieces.  Nulls in other columns, repeated rows,
empty tables and extra columns are handled as the operators' docstrings say; extra columns are kept
up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blendwise.llm import bestfit, decontam, langid, neardup, substrings
from blendwise.llm.common import fresh, materialize, small_batches, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose language is rejected."""
    small_batches(spark)
    out = tuple(fresh(docs, x) for x in ("_lang_pred", "_score", "_cross_entropy", "_rejected"))
    found = langid.identify(docs, langid.fit_on_documents(docs), out=out)
    return found.filter(~F.col(out[3])).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    small_batches(spark)
    return neardup.drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated passages out of the texts; ``n_chars`` follows the text."""
    small_batches(spark)
    out = substrings.dedup_substrings(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold an item of the benchmark."""
    small_batches(spark)
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), short_documents=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 1024 tokens."""
    small_batches(spark)
    d = bestfit.pack_documents(docs, bestfit.byte_bpe_50k(), ["doc_id"])
    return d.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("leaks", leaks),
    ("packing", packing),
]

# SQL cannot express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
