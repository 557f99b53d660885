"""Two-level prefix sums and the packing tail rules."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from blendwise.functions.prefix import prefix_rank, prefix_sum
from blendwise.operators import packing as pk


def _docs(spark, lengths, source="s"):
    rows, tok = [], 1
    for i, n in enumerate(lengths):
        rows.append((i, source, list(range(tok, tok + n))))
        tok += n
    return spark.createDataFrame(rows, "doc_id long, source string, ids array<int>")


def test_prefix_sum_matches_cumsum_with_a_hot_key(spark):
    rng = np.random.default_rng(7)
    n = 3000
    keys = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", "c"], n))
    pdf = pd.DataFrame({"k": keys, "o": rng.permutation(n), "x": rng.integers(0, 50, n)})
    df = spark.createDataFrame(pdf)
    out = prefix_sum(df, ["k"], "o", "x", "run", bucket_width=37, total="tot").toPandas()
    exp = pdf.sort_values(["k", "o"]).assign(run=lambda d: d.groupby("k")["x"].cumsum())
    got = out.sort_values(["k", "o"])
    assert list(got["run"]) == list(exp["run"])
    assert (got.groupby("k")["tot"].first() == pdf.groupby("k")["x"].sum()).all()


def test_prefix_rank_independent_of_partitions(spark):
    df = spark.range(0, 500).select(F.col("id").alias("o"), (F.col("id") % 3).alias("k"))
    a = prefix_rank(df.repartition(1), ["k"], "o", "r", bucket_width=16).orderBy("o").toPandas()["r"].tolist()
    b = prefix_rank(df.repartition(7), ["k"], "o", "r", bucket_width=5).orderBy("o").toPandas()["r"].tolist()
    assert a == b


def _stream(lengths):
    return list(range(1, sum(lengths) + 1))


@pytest.mark.parametrize("total", [0, 1, 31, 32, 33, 64])
def test_emitted_chunks_closed_form(spark, total):
    C, B = 32, 8
    lengths = [total] if total else []
    df = _docs(spark, lengths) if lengths else spark.createDataFrame([], "doc_id long, source string, ids array<int>")
    blocks = pk.pack(df, C, B, remainder="drop").collect()
    expected_chunks = max(-(-total // C) - 1, 0) if total else 0
    assert len({r.chunk_id for r in blocks}) == expected_chunks
    assert len(blocks) == expected_chunks * (C // B)


def test_pack_concatenation_is_a_prefix_of_the_stream(spark):
    lengths = [5, 40, 3, 100, 1, 17]  # one document longer than three chunks
    C, B = 24, 8
    blocks = pk.pack(_docs(spark, lengths), C, B, remainder="drop").orderBy("block_no").collect()
    flat = [t for r in blocks for t in r.tokens]
    stream = _stream(lengths)
    assert flat == stream[: len(flat)]
    assert len(flat) == (-(-len(stream) // C) - 1) * C


def test_chunk_not_a_multiple_of_block_skips_the_rest(spark):
    lengths = [70]
    C, B = 30, 8  # 3 blocks per chunk, 6 ids per chunk unreachable
    blocks = pk.pack(_docs(spark, lengths), C, B, remainder="drop").orderBy("block_no").collect()
    stream = _stream(lengths)
    assert [r.block_no for r in blocks] == [0, 1, 2, 3, 4, 5]
    assert blocks[3].tokens == stream[30:38]
    rem = pk.block_remainder(pk.chunks(_docs(spark, lengths), C, remainder="drop"), C, B).orderBy("chunk_id").collect()
    assert [r.unreachable for r in rem] == [stream[24:30], stream[54:60]]


@pytest.mark.parametrize("lengths", [[], [1], [31], [32], [33], [64], [5, 40, 3, 100, 1, 17]])
def test_keep_loses_nothing(spark, lengths):
    C, B = 32, 8
    df = _docs(spark, lengths) if lengths else spark.createDataFrame([], "doc_id long, source string, ids array<int>")
    blocks = pk.pack(df, C, B).orderBy("block_no").collect()
    assert [t for r in blocks for t in r.tokens] == _stream(lengths)
    assert all(len(r.tokens) == B for r in blocks[:-1]) and all(0 < len(r.tokens) <= B for r in blocks[-1:])
    assert {r.chunk_id for r in blocks} == {r.chunk_id for r in pk.written_chunks(df, C).collect()}


def test_pad_keeps_the_open_chunk(spark):
    lengths = [20]
    C, B = 16, 4
    blocks = pk.pack(_docs(spark, lengths), C, B, remainder="pad", sep=0).orderBy("block_no").collect()
    assert len(blocks) == 8
    assert blocks[4].tokens == [17, 18, 19, 20]
    assert all(r.tokens == [0, 0, 0, 0] for r in blocks[5:])


def test_next_token_shift(spark):
    df = spark.createDataFrame([([1, 2, 3, 4],)], "tokens array<int>")
    r = pk.next_token(df).first()
    assert r.input_ids == [1, 2, 3] and r.targets == [2, 3, 4]


def test_shards_drop_the_tail(spark):
    files = spark.createDataFrame([("s", f"f{i}", i + 1) for i in range(7)], "source string, file string, file_rank long")
    out = pk.assign_shards(files, 2).collect()
    assert len(out) == 6
    assert sorted(r.shard for r in out) == [0, 0, 0, 1, 1, 1]
    few = pk.assign_shards(files.filter(F.col("file_rank") <= 1), 2).collect()
    assert few == []


def test_match_sources_longest_prefix(spark):
    files = spark.createDataFrame([("train_a_b_0_0000000001.bin",), ("train_a_0_0000000001.bin",)], "file string")
    mix = spark.createDataFrame([("train_a",), ("train_a_b",)], "prefix string")
    got = {r.file: r.prefix for r in pk.match_sources(files, mix, mixture_rows=2).collect()}
    assert got == {"train_a_b_0_0000000001.bin": "train_a_b", "train_a_0_0000000001.bin": "train_a"}


def test_cyclic_replay(spark):
    pos = spark.createDataFrame([("s", i, 2, f"b{i}") for i in range(2)], "source string, position long, n_blocks long, name string")
    reads = spark.createDataFrame([("s", k) for k in range(5)], "source string, read_index long")
    got = [(r.read_index, r.epoch, r.name) for r in pk.cyclic(pos, reads).orderBy("read_index").collect()]
    assert got == [(0, 0, "b0"), (1, 0, "b1"), (2, 1, "b0"), (3, 1, "b1"), (4, 2, "b0")]


def test_pack_independent_of_partitioning(spark):
    lengths = [9, 31, 4, 60, 2, 18, 27, 5, 44, 13]
    docs = _docs(spark, lengths)
    a = pk.pack(docs.repartition(1), 24, 8).orderBy("block_no").collect()
    b = pk.pack(docs.repartition(7, "doc_id"), 24, 8, bucket_width=3).orderBy("block_no").collect()
    assert [(r.block_no, r.tokens) for r in a] == [(r.block_no, r.tokens) for r in b]
