"""Registered queries for sources and sinks.

Where an operator reads files (corpus, configuration, packed chunks, blocks,
history), the query first writes those files from the given tables with a
Spark job into the shared checkpoint folder, then reads them back; its work
grows with the input.  A file is stood in by a source name
(``train/<source>.jsonl``) for the file-level operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from blendwise.operators import packing as pk
from blendwise.plans.common import (
    BLOCK, CHUNK, SQL_DOC_IDS, SQL_SPLIT, VOCAB, blocks, checksum, doc_ids, sql_pack, with_sql, written_chunks,
)
from blendwise.plans.mixture_queries import SQL_MIX, SQL_STATE, mixture, state
from blendwise.plans.packing_queries import SQL_PADDED
from blendwise.plans.registry import query
from blendwise.session import scratch_path
from blendwise.sources import config as cf
from blendwise.sources import corpus as cp
from blendwise.sources import history as hs
from blendwise.sources import packed as pf
from blendwise.sources import tables

FRACTION = 0.5
SHORT = "corpus"


def _file_docs(spark, sf):
    d = tables.documents(spark, sf)
    return d.withColumn("file", F.concat(F.lit("train/"), F.col("source"), F.lit(".jsonl")))


@query("s1_read_jsonl", f"SELECT 'corpus_' || source AS source, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL")
def s1_read_jsonl(spark, sf):
    """The corpus as JSON lines, one file name per source, read back with labels from the file names."""
    root = scratch_path(spark, "jsonl")
    tables.documents(spark, sf).select("text", F.concat("source", F.lit(".jsonl")).alias("file")).write.partitionBy("file").json(f"{root}/train")
    df = cp.with_source(cp.read_corpus(spark, f"{root}/train/*/*.json", split="train"), SHORT)
    return df.select("source", F.md5("text").alias("text_md5"))


@query("s1_read_corpus", """SELECT 'documents.parquet' AS file_name, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL""")
def s1_read_corpus(spark, sf):
    df = cp.read_corpus(spark, f"{sf.rstrip('/')}/documents.parquet", split="train", fmt="parquet")
    return df.select(F.regexp_extract("file", r"([^/]*)$", 1).alias("file_name"), F.md5("text").alias("text_md5"))


@query("s2_file_fraction", f"""
WITH f AS (SELECT DISTINCT 'train/' || source || '.jsonl' AS file FROM documents),
k AS (SELECT file FROM f QUALIFY row_number() OVER (ORDER BY file) <= floor(count(*) OVER () * {FRACTION}))
SELECT doc_id, 'train/' || source || '.jsonl' AS file FROM documents WHERE 'train/' || source || '.jsonl' IN (SELECT file FROM k)""")
def s2_file_fraction(spark, sf):
    return cp.file_fraction(_file_docs(spark, sf), FRACTION).select("doc_id", "file")


@query("s3_with_source", f"""SELECT doc_id, '{SHORT}_' || source AS source_label FROM documents""")
def s3_with_source(spark, sf):
    return cp.with_source(_file_docs(spark, sf), SHORT, out="source_label").select("doc_id", "source_label")


@query("s4_split_rows", f"""SELECT doc_id, source FROM documents WHERE {SQL_SPLIT} = 'valid'""")
def s4_split_rows(spark, sf):
    return cp.split_rows(tables.documents(spark, sf), "valid").select("doc_id", "source")


@query("s5_read_mixture", f"""WITH {SQL_MIX}
SELECT 'train' AS split, group_id, source, weight FROM mix
UNION ALL SELECT 'valid', CAST(0 AS INTEGER), 'valid_' || min(source), CAST(1.0 AS DOUBLE) FROM mix""")
def s5_read_mixture(spark, sf):
    return _mixture_config(spark, sf).mixture


@query("s5_overrides", f"""WITH {SQL_MIX}, o AS (
SELECT 'data_seed' AS setting, CAST(3407 + count(*) AS VARCHAR) AS value, CAST(3407 + count(*) AS BIGINT) AS data_seed, CAST(count(*) + 1 AS BIGINT) AS n_sources FROM mix
UNION ALL SELECT 'micro_batch_size', '16', CAST(3407 + count(*) AS BIGINT), CAST(count(*) + 1 AS BIGINT) FROM mix
UNION ALL SELECT 'seed', '1', CAST(3407 + count(*) AS BIGINT), CAST(count(*) + 1 AS BIGINT) FROM mix)
SELECT * FROM o""")
def s5_overrides(spark, sf):
    """The run settings that the file overrides, and the seed of the data: ``data_seed``, never ``seed``."""
    cfg = _mixture_config(spark, sf)
    return cf.overrides_table(spark, cfg)


def _mixture_config(spark, sf):
    import yaml

    rows = mixture(spark, sf).orderBy("group_id").collect()  # K rows: one per source
    cfg = {"train": {r.source: r.weight for r in rows}, "valid": {"valid_" + rows[0].source: 1.0},
           "data_seed": 3407 + len(rows), "seed": 1, "micro_batch_size": 16}
    path = scratch_path(spark, "mixture")
    spark.createDataFrame([(yaml.safe_dump(cfg, sort_keys=False),)], "value string").coalesce(1).write.text(path)
    return cf.read_mixture(spark, path)


SQL_SBLOCKS = sql_pack(("split", "source"), "s")


@query("s6_write_blocks", f"""{with_sql(SQL_DOC_IDS, *SQL_SBLOCKS)}
SELECT split, source, block_no, CAST(len(tokens) AS BIGINT) AS n_tokens,
       CAST(list_sum(list_transform(tokens, lambda x, i: CAST(x AS BIGINT) * i)) AS BIGINT) AS checksum
FROM s_blocks""")
def s6_write_blocks(spark, sf):
    b = blocks(spark, sf, keys=("split", "source"))
    path = scratch_path(spark, "blocks")
    pf.write_blocks(b, path)
    back = spark.read.parquet(path)
    return back.select("split", "source", "block_no", F.size("tokens").cast("bigint").alias("n_tokens"),
                       checksum("tokens").alias("checksum"))


# documents arrive as files of so many consecutive ids, one builder per source and file
PART_DOCS = 256
PART_KEYS = ("source", "part")
SQL_PARTS = f"""parted AS (SELECT d.*, doc_id // {PART_DOCS} AS part FROM doc_ids d)"""


def sql_file_pack(remainder):
    ctes = (x.replace("FROM doc_ids", "FROM parted") for x in sql_pack(PART_KEYS, "p", remainder))
    return f"""{with_sql(SQL_DOC_IDS, SQL_PARTS, *ctes)}
SELECT source, CAST(part AS BIGINT) AS part, chunk_id, block_in_chunk, CAST(len(tokens) AS BIGINT) AS n_tokens,
       CAST(list_sum(list_transform(tokens, lambda x, i: CAST(x AS BIGINT) * i)) AS BIGINT) AS checksum
FROM p_blocks"""


def file_docs(spark, sf):
    return doc_ids(spark, sf).select("doc_id", "source", F.floor(F.col("doc_id") / PART_DOCS).cast("bigint").alias("part"), "ids")


def _packed_rows(b):
    return b.select("source", F.col("part").cast("bigint").alias("part"), "chunk_id", "block_in_chunk",
                    F.size("tokens").cast("bigint").alias("n_tokens"), checksum("tokens").alias("checksum"))


@query("s7_read_packed_files", f"SELECT source, chunk_id, block_in_chunk, n_tokens, checksum FROM ({SQL_PADDED})")
def s7_read_packed_files(spark, sf):
    """Chunks written through the committing sink and read back by block ranges, a few kilobytes a task."""
    ch = written_chunks(spark, sf, remainder="pad")  # a packed file always holds a whole chunk
    root = scratch_path(spark, "packed")
    pf.write_packed_files(ch, root, VOCAB, CHUNK)
    b = pf.read_packed_files(spark, root, BLOCK)
    return b.select("source", "chunk_id", "block_in_chunk", F.size("tokens").cast("bigint").alias("n_tokens"), checksum("tokens").alias("checksum"))


FILE_SOURCE = "src1"


SQL_FILES_PADDED = f"""{with_sql(SQL_DOC_IDS, SQL_PARTS, *(x.replace("FROM doc_ids", "FROM parted") for x in sql_pack(PART_KEYS, "p")))},
tot AS (SELECT DISTINCT source, part, key_tokens, (key_tokens + {CHUNK - 1}) // {CHUNK} - 1 AS last FROM p_off WHERE key_tokens > 0),
b AS (SELECT source, part, chunk_id, block_in_chunk, sum(CAST(id AS BIGINT) * (i + 1)) AS cs FROM p_btoks GROUP BY ALL
  UNION ALL SELECT source, part, last, unnest(range((key_tokens - last * {CHUNK} + {BLOCK - 1}) // {BLOCK}, {CHUNK // BLOCK})), 0 FROM tot)
SELECT source, CAST(part AS BIGINT) AS part, chunk_id, block_in_chunk, CAST({BLOCK} AS BIGINT) AS n_tokens, CAST(cs AS BIGINT) AS checksum
FROM b WHERE source = '{FILE_SOURCE}'"""


@query("s7_packed_files_of_a_source", SQL_FILES_PADDED)
def s7_packed_files_of_a_source(spark, sf):
    """One builder per source and input file (its number is the file name's process id); only the files of one source are opened."""
    ch = pk.chunks(file_docs(spark, sf), CHUNK, keys=PART_KEYS, remainder="pad")
    root = scratch_path(spark, "packed")
    pf.write_packed_files(ch, root, VOCAB, CHUNK, process_id="part")
    b = pf.read_packed_files(spark, root, BLOCK).filter(F.col("source") == FILE_SOURCE)
    return _packed_rows(b.withColumn("part", F.col("process_id")))


@query("s9_append_history", f"""WITH {SQL_DOC_IDS}, {SQL_STATE}
SELECT run_id, step, source, round(z, 9) AS z FROM st
UNION ALL SELECT run_id, step + 1, source, round(z * 2, 9) FROM st""")
def s9_append_history(spark, sf):
    st = state(spark, sf).select("run_id", "step", "source", "z")
    path = scratch_path(spark, "history")
    hs.append_history(st, path)
    hs.append_history(st.select("run_id", (F.col("step") + 1).alias("step"), "source", (F.col("z") * 2).alias("z")), path)
    back = hs.read_history(spark, path)
    return back.select("run_id", "step", "source", F.round("z", 9).alias("z"))


@query("s8_read_qa", """
WITH qa AS (
  SELECT CASE conv_id % 4 WHEN 0 THEN 'hellaswag' WHEN 1 THEN 'arc_challenge' WHEN 2 THEN 'piqa' ELSE 'sciq' END AS task,
         text AS question, ntext AS answer
  FROM (SELECT *, lead(role) OVER w AS nrole, lead(text) OVER w AS ntext FROM conversations
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND nrole = 'assistant')
SELECT task, md5(question) AS question_md5, md5(answer) AS answer_md5 FROM qa""")
def s8_read_qa(spark, sf):
    from blendwise.operators.qa import pairs_from_conversations

    pairs = pairs_from_conversations(tables.table(spark, sf, "conversations"))
    root = scratch_path(spark, "qa")
    for t in tables.QA_TASKS:
        pairs.filter(F.col("task") == t).select("question", "answer").write.mode("overwrite").json(f"{root}/{t}_sft.jsonl")
    q = cp.read_qa(spark, root)
    return q.select("task", F.md5("question").alias("question_md5"), F.md5("answer").alias("answer_md5"))


# A micro-batch opens and commits the state of every partition, whatever it brings; so more files make larger batches, not more of them.
FILES_PER_BATCH, MOST_BATCHES = 16, 8


def files_per_batch(n_files: int) -> int:
    return max(FILES_PER_BATCH, -(-n_files // MOST_BATCHES))


def _streamed(spark, sf, remainder):
    """Documents arrive as files, in any order, each with its end markers; the result is the batch pack's over the same keys."""
    from blendwise.streaming.pack_stream import pack_stream, with_end_markers

    root = scratch_path(spark, "stream")
    with_end_markers(file_docs(spark, sf), PART_KEYS).repartition("part").write.partitionBy("part").parquet(f"{root}/in")
    schema = "doc_id long, source string, ids array<int>, expected long, part long"
    n = len(spark.read.schema(schema).parquet(f"{root}/in").inputFiles())
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch(n)).parquet(f"{root}/in")
    out = pack_stream(stream, CHUNK, BLOCK, keys=PART_KEYS, remainder=remainder)
    q = (out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/ckpt")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return _packed_rows(spark.read.schema(out.schema).parquet(f"{root}/out"))


@query("p11_pack_stream", sql_file_pack("keep"))
def p11_pack_stream(spark, sf):
    """Nothing is lost: each builder's open chunk comes out at its true length when its file is complete."""
    return _streamed(spark, sf, "keep")


@query("p11_pack_stream_drop", sql_file_pack("drop"))
def p11_pack_stream_drop(spark, sf):
    """The packed format's own tail rule as an option: each builder's open chunk is lost."""
    return _streamed(spark, sf, "drop")


@query("p2_pack_per_file", sql_file_pack("keep"))
def p2_pack_per_file(spark, sf):
    """The batch packer with one builder per source and input file."""
    return _packed_rows(pk.pack(file_docs(spark, sf), CHUNK, BLOCK, keys=PART_KEYS))
