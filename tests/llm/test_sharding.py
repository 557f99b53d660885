"""LPT sharding: the heap against a direct version, groups, balance, slots, edge cases."""

import random
import zlib

from helpers import SF, edge_documents
from pyspark.sql import functions as F

from blendwise.llm import sharding


def test_lpt_matches_a_linear_scan():
    rng = random.Random(2)
    for _ in range(200):
        items = [(rng.randint(1, 50), f"k{i}") for i in range(rng.randint(0, 40))]
        shards = rng.randint(1, 9)
        loads, want = [0] * shards, {}
        for size, key in sorted(items, key=lambda x: (-x[0], x[1])):
            s = loads.index(min(loads))
            want[key], loads[s] = s, loads[s] + size
        assert sharding.lpt(items, shards) == want


def check(rows, texts_of_groups=True):
    loads, slots, place = {}, {}, {}
    for r in rows:
        loads[r.shard] = loads.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
        assert place.setdefault(r.text_crc32, r.shard) == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(0 <= s < 8 for s in loads)
    return loads


def test_query_on_a_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = sharding.op4_sharding(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        data = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
    groups = {}
    for r in rows:
        groups[r.text_crc32] = groups.get(r.text_crc32, 0) + r.size
    loads = check(rows)
    # every group is an item of its own on so small a table: exactly the heap's loads
    want = [0] * 8
    for size in sorted(groups.values(), reverse=True):
        want[want.index(min(want))] += size
    assert sorted(loads.values()) == sorted(want)


def test_many_small_groups_go_by_bundles(spark):
    df = spark.range(5000).select("id", F.concat(F.lit("t"), (F.col("id") % 2500).cast("string")).alias("text"))
    d = sharding.assign_shards_lpt(df, F.col("text"), F.lit(10), 4, items_per_shard=50)
    of = {}
    for r in d.collect():
        assert of.setdefault(r.text, r.shard) == r.shard
    loads = [r["count"] for r in d.groupBy("shard").count().collect()]
    assert len(loads) == 4 and max(loads) - min(loads) <= 5000 // 50


def test_a_hot_group_stays_together(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("text"))
    rows = sharding.shard_documents(df, 8).collect()
    assert len({r.shard for r in rows if r.text == "hot"}) == 1
    loads = [sum(len(r.text) + 1 for r in rows if r.shard == s) for s in range(8)]
    hot = next(r.shard for r in rows if r.text == "hot")
    rest = [x for s, x in enumerate(loads) if s != hot]
    assert max(rest) - min(rest) <= 6


def test_edge_cases(spark):
    docs = edge_documents(spark)
    out = sharding.shard_documents(docs, 8)
    assert out.columns == [*docs.columns, "shard", "slot"] and out.count() == docs.count()
    rows = out.collect()
    assert len({r.shard for r in rows if not r.text}) == 1  # null and empty texts are one group
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.shard_documents(docs.limit(0), 8).count() == 0
