"""Registered queries for packing, shards and replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from blendwise.operators import layout as ly
from blendwise.operators import packing as pk
from blendwise.plans.common import (
    BLOCK, CHUNK, N_BLOCKS, PACK_CTES, SEED, SQL_DOC_IDS, SQL_DOC_OFF, SQL_SUMS, SQL_TOKS, blocks, checksum, doc_ids,
    packing_input, sql_pack, with_sql, written_chunks,
)
from blendwise.plans.registry import query
from blendwise.operators.packing import read_range

SHARDS = 3
BUFFER_CHUNKS = 2
REMAINDER_BLOCK = 100  # a block size that does not divide the chunk


def source_sizes(spark, sf):
    """(source, n_ids, n_files, last_blocks, n_blocks): one row per source, made from one total each; the driver holds the
    K totals, so that every plan that needs them starts from a local table instead of the texts."""
    totals = doc_ids(spark, sf).groupBy("source").agg(F.sum("n_tokens").alias("n_ids")).collect()
    rows = [(r["source"], r["n_ids"]) for r in totals]
    return ly.stream_sizes(spark.createDataFrame(rows, "source string, n_ids bigint"), CHUNK, BLOCK), rows


def files(spark, sf):
    """One file per written chunk, as the packed-format builder names them
    (the chunk list follows from the sources' id totals: no packing needed)."""
    sizes, _ = source_sizes(spark, sf)
    return pk.file_table(read_range(sizes.select("source", "n_files"), "n_files", ["source"], out="chunk_id"))


def shuffled_files(spark, sf):
    return pk.shuffle_files(files(spark, sf), SEED)


def n_positions(rows) -> int:
    return sum(-(-n // CHUNK) * N_BLOCKS for _, n in rows)


def layout(spark, sf):
    """Every block's place in its source's stream, without the ids, and the sources' sizes."""
    sizes, rows = source_sizes(spark, sf)
    return ly.bounded_layout(ly.block_layout(sizes, CHUNK, BLOCK, SEED, BUFFER_CHUNKS), n_positions(rows)), sizes


def positioned_blocks(spark, sf):
    return ly.attach_blocks(layout(spark, sf)[0], written_chunks(spark, sf), BLOCK)


SQL_NF = f"""nf AS (SELECT DISTINCT source, (key_tokens + {CHUNK - 1}) // {CHUNK} AS n_files FROM doc_off)"""

SQL_NFILES = SQL_NF + f""",
files AS (SELECT source, chunk_id,
                 'train_' || source || '_0_' || lpad(CAST(chunk_id AS VARCHAR), 10, '0') || '.bin' AS file
          FROM (SELECT source, unnest(range(n_files)) AS chunk_id FROM nf)),
sfiles AS (SELECT *, row_number() OVER (PARTITION BY source
               ORDER BY ('0x' || substr(md5('{SEED}:' || file), 1, 15))::BIGINT, file) AS file_rank FROM files)"""

SQL_POSITIONED = f"""bks AS (SELECT DISTINCT source, chunk_id, block_in_chunk FROM btoks),
sb AS (SELECT b.source, b.chunk_id, b.block_in_chunk, f.file_rank, (f.file_rank - 1) // {BUFFER_CHUNKS} AS buffer
       FROM bks b JOIN sfiles f USING (source, chunk_id)),
sb2 AS (SELECT *, row_number() OVER (PARTITION BY source, buffer ORDER BY
          ('0x' || substr(md5('{SEED}:' || source || ':' || file_rank || ':' || block_in_chunk), 1, 15))::BIGINT,
          file_rank, block_in_chunk) AS pos_in_buffer FROM sb),
pos AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY buffer, pos_in_buffer) - 1 AS position,
               count(*) OVER (PARTITION BY source) AS n_blocks FROM sb2)"""


@query("p1_doc_offsets", f"""{with_sql(SQL_DOC_IDS, SQL_DOC_OFF)}
SELECT doc_id, source, CAST(len(ids) AS BIGINT) AS n_tokens, start AS start_pos,
       start + len(ids) AS end_pos, key_tokens FROM doc_off""")
def p1_doc_offsets(spark, sf):
    ids, how = packing_input(spark, sf)
    o = pk.doc_offsets(ids, **how)
    return o.select("doc_id", "source", "n_tokens", F.col("start").alias("start_pos"),
                    F.col("end").alias("end_pos"), "key_tokens")


@query("p2_pack", f"""{with_sql(*PACK_CTES)}
SELECT source, chunk_id, block_in_chunk, chunk_id * {N_BLOCKS} + block_in_chunk AS block_no,
       CAST(count(*) AS BIGINT) AS n_tokens, CAST(sum(CAST(id AS BIGINT) * (i + 1)) AS BIGINT) AS checksum
FROM btoks GROUP BY source, chunk_id, block_in_chunk""")
def p2_pack(spark, sf):
    b = blocks(spark, sf)
    return b.select("source", "chunk_id", "block_in_chunk", "block_no",
                    F.size("tokens").cast("bigint").alias("n_tokens"), checksum("tokens").alias("checksum"))


SQL_PADDED = f"""{with_sql(SQL_DOC_IDS, SQL_DOC_OFF, SQL_TOKS)},
real AS (SELECT source, pos // {CHUNK} AS chunk_id, (pos % {CHUNK}) // {BLOCK} AS block_in_chunk,
                sum(CAST(id AS BIGINT) * ((pos % {CHUNK}) % {BLOCK} + 1)) AS cs
         FROM toks WHERE pos % {CHUNK} < {N_BLOCKS * BLOCK} GROUP BY ALL),
tot AS (SELECT DISTINCT source, key_tokens, (key_tokens + {CHUNK - 1}) // {CHUNK} - 1 AS last FROM doc_off WHERE key_tokens > 0),
emp AS (SELECT source, last AS chunk_id,
               unnest(range((key_tokens - last * {CHUNK} + {BLOCK - 1}) // {BLOCK}, {N_BLOCKS})) AS block_in_chunk,
               0 AS cs FROM tot),
allb AS (SELECT * FROM real UNION ALL SELECT * FROM emp)
SELECT source, chunk_id, block_in_chunk, chunk_id * {N_BLOCKS} + block_in_chunk AS block_no,
       CAST({BLOCK} AS BIGINT) AS n_tokens, CAST(cs AS BIGINT) AS checksum FROM allb"""


@query("p3_pack_pad", SQL_PADDED)
def p3_pack_pad(spark, sf):
    b = blocks(spark, sf, remainder="pad")
    return b.select("source", "chunk_id", "block_in_chunk", "block_no",
                    F.size("tokens").cast("bigint").alias("n_tokens"), checksum("tokens").alias("checksum"))


@query("p3_pack_drop", f"""{with_sql(SQL_DOC_IDS, *sql_pack(("source",), "d", "drop"))}
SELECT source, chunk_id, block_in_chunk, block_no, CAST(len(tokens) AS BIGINT) AS n_tokens,
       CAST(list_sum(list_transform(tokens, lambda x, i: CAST(x AS BIGINT) * i)) AS BIGINT) AS checksum FROM d_blocks""")
def p3_pack_drop(spark, sf):
    """The packed format's own tail rule: the last chunk of a key is lost."""
    b = blocks(spark, sf, remainder="drop")
    return b.select("source", "chunk_id", "block_in_chunk", "block_no",
                    F.size("tokens").cast("bigint").alias("n_tokens"), checksum("tokens").alias("checksum"))


@query("p4_block_remainder", f"""{with_sql(SQL_DOC_IDS, SQL_DOC_OFF, SQL_TOKS)}
SELECT source, pos // {CHUNK} AS chunk_id, CAST(count(*) AS BIGINT) AS n_unreachable,
       CAST(sum(CAST(id AS BIGINT) * (pos % {CHUNK} - {(CHUNK // REMAINDER_BLOCK) * REMAINDER_BLOCK} + 1)) AS BIGINT) AS checksum
FROM toks
WHERE pos % {CHUNK} >= {(CHUNK // REMAINDER_BLOCK) * REMAINDER_BLOCK}
GROUP BY source, pos // {CHUNK}""")
def p4_block_remainder(spark, sf):
    ch = written_chunks(spark, sf)
    rem = pk.block_remainder(ch, CHUNK, REMAINDER_BLOCK)
    return rem.select("source", "chunk_id", F.size("unreachable").cast("bigint").alias("n_unreachable"),
                      checksum("unreachable").alias("checksum"))


@query("p5_next_token", f"""{with_sql(*PACK_CTES)}
SELECT source, chunk_id * {N_BLOCKS} + block_in_chunk AS block_no,
       CAST(count(*) - 1 AS BIGINT) AS n_pairs,
       CAST(sum(id) - arg_max(id, i) AS BIGINT) AS input_sum,
       CAST(sum(id) - arg_min(id, i) AS BIGINT) AS target_sum,
       CAST(sum(CAST(id AS BIGINT) * i) AS BIGINT) AS target_checksum
FROM btoks GROUP BY source, chunk_id, block_in_chunk""")
def p5_next_token(spark, sf):
    b = pk.next_token(blocks(spark, sf))
    total = lambda c: F.aggregate(F.col(c), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return b.select("source", "block_no", F.size("input_ids").cast("bigint").alias("n_pairs"),
                    total("input_ids").alias("input_sum"), total("targets").alias("target_sum"),
                    checksum("targets").alias("target_checksum"))


@query("p6_block_count", f"""{with_sql(SQL_DOC_IDS, SQL_DOC_OFF, SQL_NF)}
SELECT source, CAST(n_files AS BIGINT) AS n_files, CAST(n_files // {SHARDS} AS BIGINT) AS files_per_shard,
       CAST(n_files // {SHARDS} * {N_BLOCKS} AS BIGINT) AS blocks_per_shard
FROM nf WHERE n_files > 0""")
def p6_block_count(spark, sf):
    return pk.block_count(files(spark, sf), CHUNK, BLOCK, SHARDS)


@query("p7_assign_shards", f"""{with_sql(SQL_DOC_IDS, SQL_DOC_OFF, SQL_NFILES)}
SELECT source, file, CAST((file_rank - 1) % {SHARDS} AS INTEGER) AS shard, CAST(file_rank - 1 AS BIGINT) AS file_index
FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM sfiles)
WHERE file_rank - 1 < n // {SHARDS} * {SHARDS}""")
def p7_assign_shards(spark, sf):
    s = pk.assign_shards(shuffled_files(spark, sf), SHARDS, order="file_rank")
    return s.select("source", "file", "shard", "file_index")


@query("p8_shuffle_files", f"""{with_sql(SQL_DOC_IDS, SQL_DOC_OFF, SQL_NFILES)}
SELECT source, file, CAST(file_rank AS BIGINT) AS file_rank FROM sfiles""")
def p8_shuffle_files(spark, sf):
    return shuffled_files(spark, sf).select("source", "file", F.col("file_rank").cast("bigint"))


@query("p9_shuffle_blocks", f"""{with_sql(*PACK_CTES, SQL_SUMS, SQL_NFILES, SQL_POSITIONED)}
SELECT source, chunk_id, block_in_chunk, CAST(buffer AS BIGINT) AS buffer, CAST(pos_in_buffer AS BIGINT) AS pos_in_buffer,
       CAST(position AS BIGINT) AS position, checksum
FROM pos JOIN sums USING (source, chunk_id, block_in_chunk)""")
def p9_shuffle_blocks(spark, sf):
    return positioned_blocks(spark, sf).select("source", "chunk_id", "block_in_chunk", "buffer", "pos_in_buffer", "position",
                                             checksum("tokens").alias("checksum"))


@query("p10_cyclic", f"""{with_sql(*PACK_CTES, SQL_SUMS, SQL_NFILES, SQL_POSITIONED)},
reads AS (SELECT source, unnest(range(2 * n_blocks + 2)) AS read_index FROM (SELECT DISTINCT source, n_blocks FROM pos))
SELECT r.source, CAST(r.read_index AS BIGINT) AS read_index, CAST(r.read_index // p.n_blocks AS BIGINT) AS epoch,
       p.chunk_id, p.block_in_chunk, checksum
FROM reads r JOIN pos p ON p.source = r.source AND p.position = r.read_index % p.n_blocks
JOIN sums s ON s.source = p.source AND s.chunk_id = p.chunk_id AND s.block_in_chunk = p.block_in_chunk""")
def p10_cyclic(spark, sf):
    pos, sizes = layout(spark, sf)
    reads = read_range(sizes.select("source", (2 * F.col("n_blocks") + 2).alias("n_reads")), "n_reads", ["source"])
    out = ly.attach_blocks(pk.cyclic(pos, reads, sizes=sizes), written_chunks(spark, sf), BLOCK)
    return out.select("source", "read_index", "epoch", "chunk_id", "block_in_chunk", checksum("tokens").alias("checksum"))


@query("p12_match_sources", f"""{with_sql(SQL_DOC_IDS, SQL_DOC_OFF, SQL_NFILES)},
mix AS (SELECT DISTINCT 'train_' || source AS prefix FROM documents UNION ALL SELECT 'train')
SELECT f.file, arg_max(m.prefix, length(m.prefix)) AS prefix
FROM files f JOIN mix m ON starts_with(f.file, m.prefix || '_') GROUP BY f.file""")
def p12_match_sources(spark, sf):
    from blendwise.sources import tables

    docs = tables.table(spark, sf, "documents")
    mix = docs.select(F.concat(F.lit("train_"), F.col("source")).alias("prefix")).distinct()
    mix = mix.unionByName(spark.range(1).select(F.lit("train").alias("prefix")))
    out = pk.match_sources(files(spark, sf).select("file"), mix)
    return out.select("file", "prefix")
