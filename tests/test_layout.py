"""Closed-form block positions against ranking the blocks, and per-rank streams (P9, P10, P7 x M4)."""

import pytest
from pyspark.sql import functions as F

from blendwise.operators import layout as ly
from blendwise.operators import mixture as mx
from blendwise.operators import packing as pk

CHUNK, BLOCK, SEED = 12, 4, 7
TOTALS = [("a", 12 * 9 + 5), ("b", 12 * 4), ("c", 3), ("d", 12 * 6 + 9), ("e", 12 * 7 + 1)]


def _sizes(spark, remainder="keep"):
    return ly.stream_sizes(spark.createDataFrame(TOTALS, "source string, n_ids bigint"), CHUNK, BLOCK, remainder)


def _ids(spark):
    docs = [(i, s, list(range(n))) for i, (s, n) in enumerate(TOTALS)]
    return spark.createDataFrame(docs, "doc_id long, source string, ids array<int>")


@pytest.mark.parametrize("n_chunks", [1, 2, 5, 100])
@pytest.mark.parametrize("remainder", ["keep", "pad", "drop"])
def test_positions_equal_the_ranked_ones(spark, n_chunks, remainder):
    blocks = pk.pack(_ids(spark), CHUNK, BLOCK, remainder=remainder)
    files = pk.shuffle_files(pk.file_table(pk.written_chunks(_ids(spark), CHUNK, remainder=remainder)), SEED)
    ranked = pk.block_positions(pk.shuffle_blocks(blocks.join(files.select("source", "chunk_id", "file_rank"), ["source", "chunk_id"]), n_chunks, SEED))
    cols = ["source", "chunk_id", "block_in_chunk", "buffer", "pos_in_buffer", "position", "n_blocks"]
    want = sorted(tuple(r) for r in ranked.select(*cols).collect())
    got = ly.block_layout(_sizes(spark, remainder), CHUNK, BLOCK, SEED, n_chunks)
    assert sorted(tuple(r) for r in got.select(*cols).collect()) == want
    assert sorted((r.source, r.n_blocks) for r in _sizes(spark, remainder).collect()) == sorted({(r[0], r[6]) for r in want})


@pytest.mark.parametrize("ranks", [1, 2, 3, 4])
def test_ranks_read_disjoint_files_and_all_of_their_own(spark, ranks):
    lay = ly.block_layout(_sizes(spark), CHUNK, BLOCK, SEED, 2, ranks=ranks).collect()
    files = {(r.source, r.chunk_id): r.file_rank for r in ly.ordered_files(_sizes(spark), SEED).collect()}
    n_files = {r.source: r.n_files for r in _sizes(spark).collect()}
    for r in lay:
        assert (files[r.source, r.chunk_id] - 1) % ranks == r.rank
        assert files[r.source, r.chunk_id] <= n_files[r.source] // ranks * ranks
    streams = {}
    for r in lay:
        streams.setdefault((r.source, r.rank), []).append((r.position, r.chunk_id, r.block_in_chunk, r.n_blocks))
    for s, rows in streams.items():
        assert sorted(x[0] for x in rows) == list(range(rows[0][3]))  # gapless, as long as the stream says
    assert len({(r.source, r.chunk_id, r.block_in_chunk) for r in lay}) == len(lay)  # no block on two ranks
    assert {r.source for r in lay} == {s for s, n in n_files.items() if n >= ranks}


def test_sharded_mix_does_not_depend_on_tasks(spark):
    lay = ly.block_layout(_sizes(spark), CHUNK, BLOCK, SEED, 2, ranks=2)
    per = lay.groupBy("source", "rank").agg(F.max("n_blocks").alias("n_blocks"))
    m = spark.createDataFrame([(0, "a", 3.0), (1, "b", 1.0), (2, "d", 2.0)], "group_id int, source string, weight double")

    def run(parts):
        d = mx.draw_sources(spark, 300, m, 5, mixture_rows=3, num_partitions=parts)
        out = ly.rank_partitions(ly.attach_blocks(mx.sharded_mix(lay, d, 2, per), pk.chunks(_ids(spark), CHUNK), BLOCK), 2)
        return [[(r.rank, r.draw_idx, r.source, r.read_index, r.epoch, list(r.tokens)) for r in p] for p in out.rdd.glom().collect()]

    one, many = run(1), run(7)
    assert one == many and len(one) == 2
    for rank, rows in enumerate(one):  # partition r is rank r's stream, in order, complete
        assert [r[0] for r in rows] == [rank] * 300 and [r[1] for r in rows] == list(range(300))
    assert [r[2:5:2] for r in one[0]] != [r[2:5:2] for r in one[1]] or one[0][0][5] != one[1][0][5]
    assert [r[2] for r in one[0]] == [r[2] for r in one[1]]  # the same sources on every rank
    assert not {tuple(r[5]) + (r[2],) for r in one[0]} & {tuple(r[5]) + (r[2],) for r in one[1]}  # other blocks


def test_rank_streams_are_cut_into_bounded_pieces(spark, monkeypatch):
    rows = [(r, i, r * 1000 + i) for i in range(250) for r in range(3)]
    d = spark.createDataFrame(rows, "rank int, draw_idx long, x long").repartition(5)
    whole = [[tuple(x) for x in p] for p in ly.rank_partitions(d, 3).rdd.glom().collect()]
    monkeypatch.setattr(ly, "PIECE_DRAWS", 100)
    cut = [[tuple(x) for x in p] for p in ly.rank_partitions(d, 3, n_draws=250).rdd.glom().collect()]
    assert [len(p) for p in cut] == [100, 100, 50] * 3
    assert [sum(cut[3 * r:3 * r + 3], []) for r in range(3)] == whole
