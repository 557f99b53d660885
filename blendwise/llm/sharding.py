"""Sharding by longest-processing-time scheduling (LPT).

Groups of rows that must stay together (equal texts) are sorted by size and each
goes to the least-loaded shard through a heap.

LPT itself is sequential, so it runs on a bounded list of items.  A group of at
least ``total / (shards * items_per_shard)`` bytes is an item of its own (there can be
at most ``shards * items_per_shard`` of those); all smaller groups are hashed, whole,
into ``shards * items_per_shard`` bundles, and a bundle is one item.  The list thus has at
most ``2 * shards * items_per_shard`` rows at any input size, and shard sizes differ by
about one item (the largest group, or a few hundredths of a percent of the data).

A hot group (a third of the rows) is always an item: it is counted by a
partial aggregate before the shuffle and reaches its rows by the broadcast of
the bounded item list, so no task gathers it.

Defined results: a null text counts as an empty text and belongs to the group of
empty texts; an empty table gives an empty result; repeated rows are rows of one
group with a slot each; extra columns pass through unchanged.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blendwise.functions.prefix import prefix_rank
from blendwise.llm.common import fresh, materialize, table, text_digest

ITEMS_PER_SHARD = 1000
SLOT_BUCKETS = 4096  # a shard's slots are numbered in so many ranges, each in its own task


def lpt(items: list[tuple[int, object]], shards: int) -> dict[object, int]:
    """Item -> shard: items by size, largest first, each to the least-loaded shard."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, key in sorted(items, key=lambda x: (-x[0], str(x[1]))):
        load, s = heapq.heappop(heap)
        out[key] = s
        heapq.heappush(heap, (load + size, s))
    return out


def assign_shards_lpt(df: DataFrame, group: Column, size: Column, shards: int,
                      items_per_shard: int = ITEMS_PER_SHARD, out: str = "shard") -> DataFrame:
    """``df`` plus ``out`` (0 .. shards-1); rows with an equal ``group`` text share a shard."""
    spark = df.sparkSession
    bundles = shards * items_per_shard
    g, s = fresh(df, "_group"), fresh(df, "_size")
    keyed = df.withColumn(g, text_digest(group)).withColumn(s, size.cast("bigint"))
    groups = materialize(keyed.groupBy(F.col(g).alias("g")).agg(F.sum(s).alias("bytes")), "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    least = max(1, -(-total // bundles))
    large = groups.filter(F.col("bytes") >= least).select(F.hex("g").alias("item"), "bytes")
    bundle = F.concat(F.lit("b"), F.pmod(F.xxhash64("g"), F.lit(bundles)).cast("string"))
    small = groups.filter(F.col("bytes") < least).groupBy(bundle.alias("item")).agg(F.sum("bytes").alias("bytes"))
    items = [(r["bytes"], r["item"]) for r in large.unionByName(small).collect()]  # at most 2 * bundles rows
    placed = lpt(items, shards)
    i, t = fresh(df, "_item"), fresh(df, "_to")
    schema = f"`{i}` string, `{t}` int"
    of_large = spark.createDataFrame([(k, v) for k, v in placed.items() if k[0] != "b"] or [], schema)
    of_bundle = spark.createDataFrame([(int(k[1:]), v) for k, v in placed.items() if k[0] == "b"] or [], f"`{i}` bigint, `{t}_b` int")
    return (keyed.join(F.broadcast(of_large), F.hex(g) == F.col(i), "left").drop(i)
            .join(F.broadcast(of_bundle), F.pmod(F.xxhash64(g), F.lit(bundles)) == F.col(i), "left").drop(i)
            .withColumn(out, F.coalesce(F.col(t), F.col(f"{t}_b"))).drop(g, s, t, f"{t}_b"))


def number_slots(df: DataFrame, shard: str, order: list[str], out: str = "slot", buckets: int = SLOT_BUCKETS) -> DataFrame:
    """``out`` = 0-based place of the row in its shard, gapless; ``order`` breaks ties inside a hash range."""
    b = fresh(df, "_bucket")
    d = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)))
    d = prefix_rank(d, [shard], [b, *order], out, bucket=F.col(b))
    return d.withColumn(out, F.col(out) - 1).drop(b)


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def shard_documents(docs: DataFrame, shards: int = 8, text: str = "text", order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """All columns of ``docs`` plus ``shard`` and ``slot``; equal texts stay together, shard bytes are near equal.

    Size of a row: its UTF-8 bytes plus 1 (a line end)."""
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # any column name may be in use
    d = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()])
    d = assign_shards_lpt(d, F.col(own[text]), text_bytes(F.col(own[text])) + 1, shards)
    d = number_slots(d, "shard", [own[c] for c in order])
    return d.select(*[F.col(n).alias(c) for c, n in own.items()], "shard", "slot")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn(
        "size", text_bytes(F.col("text")) + 1).withColumn(
        "text_crc32", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    d = shard_documents(docs, 8, order=("doc_id", "text_crc32"))
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"))
