"""The given parquet tables and the fixtures derived from them by Spark.

Every fixture is a projection, join or window of a given table, so its size
grows with the input.  Rules (see FIXTURES.md):

* documents: ``split`` = 'valid' when ``(doc_id div 20) % 10 = 0`` else 'train';
* question/answer pairs: a user turn followed by an assistant turn;
  ``task`` = one of four task names by ``conv_id % 4``;
* run log: one run per ``event_type``, iteration = rank by ``ts``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blendwise.session import spread_input

# The four question/answer task names, in this order.
QA_TASKS = ["hellaswag", "arc_challenge", "piqa", "sciq"]

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def split_expr(doc_id: str = "doc_id") -> F.Column:
    return F.when((F.floor(F.col(doc_id) / 20) % 10) == 0, F.lit("valid")).otherwise(F.lit("train"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents(doc_id, source, split, lang, text); null text rows are dropped."""
    d = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    d = spread_input(d, "doc_id")
    return d.select("doc_id", "source", split_expr().alias("split"), "lang", "text")


BUCKETS_PER_CORE = 32
WIDEST_BUCKET = 1 << 16


@dataclass(frozen=True)
class DocBuckets:
    """How ``documents`` are dealt for packing: ranges of ``width`` ids, and bounds of the keys that packing uses."""

    width: int
    buckets: int
    sources: int
    langs: int

    def pairs(self, keys: Sequence[str]) -> int:
        """Bound of the (key, bucket) pairs."""
        n = {"source": self.sources, "lang": self.langs, "split": 2}
        return self.buckets * math.prod(n[k] for k in keys)


def document_buckets(spark: SparkSession, sf_dir: str) -> DocBuckets:
    """Read from the narrow columns; ranges are as wide as a window should be, but many enough for every core."""
    groups = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.max("doc_id").alias("last")).collect()  # one row per key
    last = max((r["last"] or 0 for r in groups), default=0) + 1
    width = max(1, min(WIDEST_BUCKET, last // (BUCKETS_PER_CORE * spark.sparkContext.defaultParallelism)))
    return DocBuckets(width, -(-last // width), len({r["source"] for r in groups}), len({r["lang"] for r in groups}))


def bucketed_documents(spark: SparkSession, sf_dir: str, buckets: DocBuckets) -> DataFrame:
    """``documents`` partitioned by ranges of ids (``doc_bucket``), so that offsets need no further exchange of texts or ids."""
    d = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    d = d.select("doc_id", "source", split_expr().alias("split"), "lang", "text", F.floor(F.col("doc_id") / buckets.width).alias("doc_bucket"))
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return d.repartition(n, "doc_bucket")


def qa_task(conv_id: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(t) for t in QA_TASKS]), (conv_id % 4 + 1).cast("int"))
