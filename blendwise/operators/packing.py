"""Packing token streams into chunks and blocks, shards and replay.

The stream of a pack key (a source, or a (source, file) pair) is its
documents' ids concatenated in document order.  The stream is cut into
chunks of ``chunk_size`` ids; a chunk holds ``chunk_size // block_size``
whole blocks.  Tail rules of the packed format:

* ``remainder='keep'`` (default): the last chunk is written at its true length, so
  its last block may be short and nothing is lost;
* ``remainder='drop'``: a chunk is only written when a later id overflows it,
  so for T > 0 ids exactly ``ceil(T / chunk) - 1`` chunks exist: the last
  partial chunk and an exactly full last chunk are both lost;
* ``remainder='pad'``: the last chunk is written too, filled with ``sep``;
* ids after the last whole block of a chunk are never read.

Nothing here orders a whole key in one task: offsets come from the
two-level prefix sum, blocks are assembled by grouping on (key, block), a
group that holds at most ``block_size`` ids.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blendwise.functions.hashing import md5_key
from blendwise.functions.prefix import DEFAULT_BUCKET_WIDTH, hashed_bucket, prefix_rank, prefix_sum


def doc_offsets(
    tokens: DataFrame,
    keys: Sequence[str] = ("source",),
    order: str = "doc_id",
    ids: str = "ids",
    bucket_width: int = DEFAULT_BUCKET_WIDTH,
    bucket: str | None = None,
    base_rows: int | None = None,
) -> DataFrame:
    """``start``/``end`` of each document in its key's stream, plus ``key_tokens``.

    ``bucket`` names a column that does not fall along ``order``: documents that are partitioned by it get their offsets
    where they are, from the bucket totals (broadcast if ``base_rows``, a bound of their number, is small)."""
    d = tokens if "n_tokens" in tokens.columns else tokens.withColumn("n_tokens", F.size(ids).cast("bigint"))
    d = prefix_sum(d, keys, order, "n_tokens", "end", bucket=F.col(bucket) if bucket else None, bucket_width=bucket_width,
                   total="key_tokens", base_rows=base_rows)
    return d.withColumn("start", F.col("end") - F.col("n_tokens"))


def emitted_chunks(total: F.Column, chunk_size: int, remainder: str = "keep") -> F.Column:
    """Chunks written for a stream of ``total`` ids (closed form of the builder)."""
    full = F.ceil(total / F.lit(chunk_size)).cast("bigint")
    if remainder == "drop":
        return F.greatest(full - 1, F.lit(0).cast("bigint"))
    if remainder in ("keep", "pad"):
        return full
    raise ValueError(f"remainder must be 'keep', 'drop' or 'pad', got {remainder!r}")


def chunks(
    tokens: DataFrame,
    chunk_size: int,
    keys: Sequence[str] = ("source",),
    order: str = "doc_id",
    ids: str = "ids",
    remainder: str = "keep",
    sep: int = 0,
    bucket_width: int = DEFAULT_BUCKET_WIDTH,
    bucket: str | None = None,
    base_rows: int | None = None,
    reach: int | None = None,
) -> DataFrame:
    """Written chunks ``(keys..., chunk_id, tokens)``, up to ``reach`` ids of each.

    One row per (document, chunk) piece is cut with ``slice``; pieces are grouped per chunk (a group holds
    at most ``chunk_size`` ids) and put in order.  This is the only exchange that carries ids if ``bucket`` is given."""
    keys, C = list(keys), chunk_size
    reach = C if reach is None else reach
    o = doc_offsets(tokens, keys, order, ids, bucket_width, bucket, base_rows)
    o = o.withColumn("_nchunks", emitted_chunks(F.col("key_tokens"), C, remainder))
    o = o.filter((F.col("n_tokens") > 0) & (F.col("start") < F.col("_nchunks") * C))

    c = F.explode(F.sequence(F.floor(F.col("start") / C), F.least(F.floor((F.col("end") - 1) / C), F.col("_nchunks") - 1)))
    o = o.select(*keys, ids, "start", "end", c.alias("chunk_id"))
    c0 = F.col("chunk_id") * C
    ps = F.greatest(F.col("start"), c0)
    pe = F.least(F.col("end"), c0 + reach)
    o = o.filter(ps < pe)
    piece = F.slice(F.col(ids), (ps - F.col("start") + 1).cast("int"), (pe - ps).cast("int"))
    pieces = o.select(*keys, "chunk_id", (ps - c0).alias("_off"), piece.alias("_piece"))
    ch = pieces.groupBy(*keys, "chunk_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_off", "_piece"))), lambda s: s["_piece"])).alias("tokens")
    )
    if remainder == "pad":  # the open chunk is written whole
        fill = F.array_repeat(F.lit(sep).cast("int"), (F.lit(reach) - F.size("tokens")).cast("int"))
        ch = ch.withColumn("tokens", F.concat("tokens", fill))
    return ch.select(*keys, "chunk_id", "tokens")


def pack(
    tokens: DataFrame,
    chunk_size: int,
    block_size: int,
    keys: Sequence[str] = ("source",),
    order: str = "doc_id",
    ids: str = "ids",
    remainder: str = "keep",
    sep: int = 0,
    bucket_width: int = DEFAULT_BUCKET_WIDTH,
    bucket: str | None = None,
    base_rows: int | None = None,
) -> DataFrame:
    """Blocks ``(keys..., chunk_id, block_in_chunk, block_no, tokens)``: each written chunk cut into its whole
    blocks; ids past the last whole block of a chunk are never read, a short last chunk has fewer blocks."""
    if block_size <= 0 or chunk_size < block_size:
        raise ValueError("need 0 < block_size <= chunk_size")
    keys, B = list(keys), block_size
    nb = chunk_size // B
    ch = chunks(tokens, chunk_size, keys, order, ids, remainder, sep, bucket_width, bucket, base_rows, reach=nb * B)
    j = F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.size("tokens") / F.lit(B)).cast("bigint") - 1)).alias("block_in_chunk")
    blocks = ch.select(*keys, "chunk_id", "tokens", j)
    tok = F.slice("tokens", (F.col("block_in_chunk") * B + 1).cast("int"), F.lit(B))
    return blocks.withColumn("tokens", tok).withColumn("block_no", F.col("chunk_id") * nb + F.col("block_in_chunk")).select(
        *keys, "chunk_id", "block_in_chunk", "block_no", "tokens"
    )


def block_remainder(chunk_rows: DataFrame, chunk_size: int, block_size: int, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Ids of each chunk that no block reaches (positions >= (chunk div block) * block)."""
    reach = (chunk_size // block_size) * block_size
    return chunk_rows.select(
        *keys, "chunk_id", F.slice("tokens", reach + 1, chunk_size - reach).alias("unreachable")
    ).filter(F.size("unreachable") > 0)


def next_token(blocks: DataFrame, tokens: str = "tokens") -> DataFrame:
    """P5: ``input_ids`` = all but the last id, ``targets`` = all but the first."""
    n = F.size(tokens) - 1
    return blocks.withColumn("input_ids", F.slice(tokens, F.lit(1), n)).withColumn("targets", F.slice(tokens, F.lit(2), n))


def block_count(files: DataFrame, chunk_size: int, block_size: int, n_shards: int, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Files, files per shard and blocks per shard for each key."""
    per = files.groupBy(*keys).agg(F.countDistinct("file").alias("n_files"))
    fps = F.floor(F.col("n_files") / n_shards).cast("bigint")
    return per.select(
        *keys,
        F.col("n_files").cast("bigint").alias("n_files"),
        fps.alias("files_per_shard"),
        (fps * F.lit(chunk_size // block_size)).cast("bigint").alias("blocks_per_shard"),
    )


def assign_shards(files: DataFrame, n_shards: int, keys: Sequence[str] = ("source",), order: str = "file_rank") -> DataFrame:
    """File i (0-based, in ``order``) goes to shard i mod n; files past the
    largest multiple of n are dropped."""
    r = prefix_rank(files, keys, order, "_r", total="_n")
    keep = (F.col("_r") - 1) < F.floor(F.col("_n") / n_shards) * n_shards
    return r.filter(keep).withColumn("shard", ((F.col("_r") - 1) % n_shards).cast("int")).withColumn(
        "file_index", (F.col("_r") - 1).cast("bigint")
    ).drop("_r", "_n")


def shuffle_files(files: DataFrame, seed: int, keys: Sequence[str] = ("source",), file: str = "file") -> DataFrame:
    """Seeded order of the files of each key: rank by md5(seed:file)."""
    d = files.withColumn("_k", md5_key(F.lit(seed), F.col(file)))
    d = prefix_rank(d, keys, ["_k", file], "file_rank", bucket=hashed_bucket(F.col("_k")))
    return d.drop("_k")


def shuffle_blocks(
    blocks: DataFrame, n_chunks: int, seed: int, keys: Sequence[str] = ("source",),
    file_rank: str = "file_rank", block_key: str = "block_in_chunk",
) -> DataFrame:
    """Blocks shuffled inside buffers of ``n_chunks`` consecutive files.

    ``buffer`` = file rank div n_chunks; ``pos_in_buffer`` ranks the blocks of a
    buffer by md5(seed:key:file:block); the window is bounded by the buffer.
    """
    kcols = [F.col(k).cast("string") for k in keys]
    d = blocks.withColumn("buffer", F.floor((F.col(file_rank) - 1) / n_chunks).cast("bigint"))
    d = d.withColumn("_k", md5_key(F.lit(seed), *kcols, F.col(file_rank), F.col(block_key)))
    w = Window.partitionBy(*keys, "buffer").orderBy("_k", file_rank, block_key)
    return d.withColumn("pos_in_buffer", F.row_number().over(w).cast("bigint")).drop("_k")


def block_positions(blocks: DataFrame, keys: Sequence[str] = ("source",), order: Sequence[str] = ("buffer", "pos_in_buffer"), bucket_col: str = "buffer") -> DataFrame:
    """0-based read position of each block in its key's stream, with ``n_blocks``."""
    d = prefix_rank(blocks, keys, list(order), "_r", bucket=F.col(bucket_col), total="n_blocks")
    return d.withColumn("position", F.col("_r") - 1).drop("_r")


def cyclic(positioned: DataFrame, reads: DataFrame, keys: Sequence[str] = ("source",), read_index: str = "read_index",
           sizes: DataFrame | None = None) -> DataFrame:
    """P10: the k-th read of a key (0-based) takes block k mod n, in epoch k div n.  ``sizes(keys..., n_blocks)``, one row
    per key, spares counting the blocks."""
    if sizes is None:
        n = positioned.groupBy(*keys).agg(F.max("n_blocks").alias("_n"))
    else:
        n = F.broadcast(sizes.select(*keys, F.col("n_blocks").alias("_n")))
    r = reads.join(n, list(keys), "inner")
    r = r.withColumn("position", (F.col(read_index) % F.col("_n")).cast("bigint")).withColumn(
        "epoch", F.floor(F.col(read_index) / F.col("_n")).cast("bigint")
    ).drop("_n")
    return r.join(positioned.drop("n_blocks"), [*keys, "position"], "inner")


def match_sources(files: DataFrame, mixture: DataFrame, file: str = "file", prefix: str = "prefix",
                  mixture_rows: int | None = None) -> DataFrame:
    """Each file to the longest mixture prefix ``p`` it starts with as ``p_``.

    Every prefix of the file name that ends just before an underscore is a
    candidate (a handful per file); candidates are equi-joined with the
    mixture, and the longest match per file is a grouped ``max_by``.  No
    theta join: the cost is linear in the files for any mixture size.
    """
    cols = files.columns
    parts = F.split(F.col(file), "_")
    cand = files.select(*cols, F.posexplode(parts).alias("_i", "_part")).filter(F.col("_i") < F.size(parts) - 1)
    cand = cand.select(*cols, F.array_join(F.slice(parts, 1, (F.col("_i") + 1).cast("int")), "_").alias("_p"))
    m = mixture.select(F.col(prefix).alias("_p"), *[c for c in mixture.columns if c != prefix])
    if mixture_rows is not None and mixture_rows <= 100000:
        m = F.broadcast(m)
    j = cand.join(m, "_p", "inner")
    best = F.max_by(F.struct(*[F.col(c) for c in m.columns]), F.length("_p"))
    out = j.groupBy(*cols).agg(best.alias("_m"))
    return out.select(*cols, *[F.col("_m")[c].alias(prefix if c == "_p" else c) for c in m.columns])


def file_table(chunk_rows: DataFrame, split: str = "train", process_id: int = 0, keys: Sequence[str] = ("source",)) -> DataFrame:
    """One row per written chunk with the packed-format file name
    ``{split}_{source}_{process_id}_{counter:010d}.bin``."""
    src = keys[0]
    name = F.concat(
        F.lit(f"{split}_"), F.col(src), F.lit(f"_{process_id}_"),
        F.lpad(F.col("chunk_id").cast("string"), 10, "0"), F.lit(".bin"),
    )
    return chunk_rows.select(*keys, "chunk_id", name.alias("file"), F.lit(split).alias("split"),
                             F.lit(process_id).alias("process_id"), F.col("chunk_id").cast("int").alias("counter"))


READ_PIECE = 1 << 17


def read_range(need: DataFrame, n: str, keys: Sequence[str], out: str = "read_index", piece: int = READ_PIECE) -> DataFrame:
    """Rows ``0 .. n-1`` per key, made in two explodes with a shuffle between,
    so a key that needs a billion reads is not expanded by one task."""
    keys = list(keys)
    lvl1 = need.select(*keys, n, F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                      F.ceil(F.col(n) / piece).cast("bigint") - 1)).alias("_piece"))
    lvl1 = lvl1.repartition(*[F.col(k) for k in keys], F.col("_piece"))
    lo = F.col("_piece") * piece
    hi = F.least(F.col(n), lo + piece) - 1
    return lvl1.select(*keys, F.explode(F.sequence(lo, hi)).alias(out))


def written_chunks(tokens: DataFrame, chunk_size: int, keys: Sequence[str] = ("source",), ids: str = "ids",
                   remainder: str = "keep") -> DataFrame:
    """``(keys..., chunk_id)`` of every chunk the packer writes, from the keys'
    id totals alone (closed form), without packing: a per-key aggregate and a
    two-level range expansion."""
    n = F.col("n_tokens") if "n_tokens" in tokens.columns else F.size(ids)
    tot = tokens.groupBy(*keys).agg(F.sum(n).cast("bigint").alias("_t"))
    tot = tot.withColumn("_n", emitted_chunks(F.col("_t"), chunk_size, remainder)).filter(F.col("_n") > 0)
    return read_range(tot, "_n", list(keys), out="chunk_id")
