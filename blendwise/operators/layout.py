"""Where every block stands in its stream, in closed form (P9, P10, P7 x M4).

A source of T ids has ``ceil(T / chunk)`` files of ``chunk div block`` blocks; only its last file may be
shorter.  Files are put in seeded order (P8); with ranks, file i goes to rank ``i mod R`` (P7; files beyond the largest
multiple of R are dropped) and keeps its order there.  Blocks are shuffled inside buffers of ``n_chunks`` consecutive files.  A
block's position in its stream then follows by arithmetic:

    position = buffer * n_chunks * (chunk div block) + place in the buffer - blocks that a short file before the buffer lacks

so nothing ranks blocks within a source, and the ids themselves are not read: the layout comes from one total per source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blendwise.functions.hashing import md5_key
from blendwise.operators.packing import emitted_chunks, file_table, read_range, shuffle_files
from blendwise.session import cut_lineage, small_broadcast

LAYOUT_BROADCAST_ROWS = 500_000
PIECE_DRAWS = 1 << 18  # draws of a rank that one task puts in order


def stream_sizes(totals: DataFrame, chunk_size: int, block_size: int, remainder: str = "keep",
                 keys: Sequence[str] = ("source",), n_ids: str = "n_ids") -> DataFrame:
    """Per key of ``totals(keys..., n_ids)``: files, blocks of the last file, blocks of a whole file and of the key."""
    nb = chunk_size // block_size
    s = totals.select(*keys, F.col(n_ids).cast("bigint").alias("n_ids"), emitted_chunks(F.col(n_ids), chunk_size, remainder).alias("n_files"))
    last = F.ceil((F.col("n_ids") - (F.col("n_files") - 1) * chunk_size) / F.lit(block_size)).cast("bigint")
    s = s.filter(F.col("n_files") > 0)
    s = s.withColumn("last_blocks", F.least(last, F.lit(nb)) if remainder == "keep" else F.lit(nb).cast("bigint"))
    return s.withColumn("n_blocks", (F.col("n_files") - 1) * nb + F.col("last_blocks"))


def ordered_files(sizes: DataFrame, seed: int, keys: Sequence[str] = ("source",)) -> DataFrame:
    """P8 from the sizes alone: ``(keys..., chunk_id, file, file_rank)``."""
    files = file_table(read_range(sizes.select(*keys, "n_files"), "n_files", list(keys), out="chunk_id"), keys=keys)
    return shuffle_files(files.select(*keys, "chunk_id", "file"), seed, keys)


def block_layout(sizes: DataFrame, chunk_size: int, block_size: int, seed: int, n_chunks: int, ranks: int | None = None,
                 keys: Sequence[str] = ("source",), cut: bool = True) -> DataFrame:
    """``(keys..., [rank], chunk_id, block_in_chunk, buffer, pos_in_buffer, position, n_blocks)`` of every block.

    ``sizes`` comes from :func:`stream_sizes` and has one row per key, so it is broadcast.  With ``ranks``, every rank has a
    stream of its own files, shuffled with ``seed + rank``.  ``cut`` writes the file order (one row per file) to the
    shared folder, because two branches read it."""
    keys, nb = list(keys), chunk_size // block_size
    files = ordered_files(sizes, seed, keys).select(*keys, "chunk_id", (F.col("file_rank") - 1).alias("_i"))
    files = cut_lineage(files) if cut else files
    one = F.broadcast(sizes.select(*keys, "n_files", "last_blocks"))  # one row per key
    f = files.join(one, keys)
    stream = keys
    if ranks is not None:
        stream = [*keys, "rank"]
        f = f.filter(F.col("_i") < F.floor(F.col("n_files") / ranks) * ranks)
        f = f.withColumn("rank", (F.col("_i") % ranks).cast("int")).withColumn("_i", F.floor(F.col("_i") / ranks).cast("bigint"))
        f = f.withColumn("n_files_here", F.floor(F.col("n_files") / ranks).cast("bigint"))
    else:
        f = f.withColumn("n_files_here", F.col("n_files"))
    is_last = F.col("chunk_id") == F.col("n_files") - 1
    f = f.withColumn("_buffer", F.floor(F.col("_i") / n_chunks).cast("bigint"))
    short = f.filter(is_last).select(*stream, F.col("_buffer").alias("_short"))  # at most one row per key
    f = f.join(F.broadcast(short), stream, "left")
    lacks = F.when(F.col("_short").isNotNull(), F.lit(nb) - F.col("last_blocks")).otherwise(F.lit(0))
    f = f.withColumn("n_blocks", (F.col("n_files_here") * nb - lacks).cast("bigint"))
    f = f.withColumn("_lacks", F.when(F.col("_short") < F.col("_buffer"), lacks).otherwise(F.lit(0)))
    own = F.when(is_last, F.col("last_blocks")).otherwise(F.lit(nb).cast("bigint"))
    b = f.select(*stream, "chunk_id", "_i", F.col("_buffer").alias("buffer"), "_lacks", "n_blocks",
                 F.explode(F.sequence(F.lit(0).cast("bigint"), own - 1)).alias("block_in_chunk"))
    own_seed = F.lit(seed) + F.col("rank") if ranks is not None else F.lit(seed)
    b = b.withColumn("_k", md5_key(own_seed, *[F.col(k).cast("string") for k in keys], F.col("_i") + 1, F.col("block_in_chunk")))
    w = Window.partitionBy(*stream, "buffer").orderBy("_k", "_i", "block_in_chunk")  # bounded by the buffer
    b = b.withColumn("pos_in_buffer", F.row_number().over(w).cast("bigint"))
    b = b.withColumn("position", F.col("buffer") * (n_chunks * nb) + F.col("pos_in_buffer") - 1 - F.col("_lacks"))
    return b.select(*stream, "chunk_id", "block_in_chunk", "buffer", "pos_in_buffer", F.col("position").cast("bigint").alias("position"), "n_blocks")


def bounded_layout(layout: DataFrame, n_blocks: int) -> DataFrame:
    """Broadcast a layout of known, small size; any other is joined by a shuffle on the position."""
    return small_broadcast(layout, LAYOUT_BROADCAST_ROWS, known_rows=n_blocks)


def attach_blocks(rows: DataFrame, chunk_rows: DataFrame, block_size: int, keys: Sequence[str] = ("source",),
                  tokens: str = "tokens") -> DataFrame:
    """Rows ``(keys..., chunk_id, block_in_chunk, ...)`` with the block's ids, cut from the chunk they are in.

    The join is by chunk, the key that packing has put the ids in order by, so the ids do not move again."""
    ids = F.slice(F.col("_ids"), (F.col("block_in_chunk") * block_size + 1).cast("int"), F.lit(block_size))
    j = rows.join(chunk_rows.withColumnRenamed(tokens, "_ids"), [*keys, "chunk_id"])
    return j.withColumn(tokens, ids).drop("_ids")


def rank_partitions(stream: DataFrame, ranks: int, draw: str = "draw_idx", n_draws: int | None = None) -> DataFrame:
    """Partition r holds exactly rank r's rows, in order of the draw (written, one file per rank).

    With ``n_draws``, the number of draws of every rank, a rank's stream is as many partitions in a row as it has pieces of
    ``PIECE_DRAWS`` draws, so that no task sorts more than a piece, however long the stream is."""
    pieces = max(1, -(-n_draws // PIECE_DRAWS)) if n_draws else 1
    place = F.col("rank") * pieces + (F.floor(F.col(draw) / PIECE_DRAWS) if pieces > 1 else F.lit(0))
    return stream.repartitionById(ranks * pieces, place.cast("int")).sortWithinPartitions(draw)
