"""Parameters and shared building blocks of the registered queries.

Spark builders and the matching DuckDB CTEs live side by side so that a
change of a parameter changes both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blendwise.operators.packing import chunks, pack
from blendwise.operators.tokens import encode_documents
from blendwise.sources import tables

# Query parameters (the fixture scale of FIXTURES.md).
VOCAB = 1024          # hashed ids 1..1023, 0 = EOS
CHUNK = 1032          # = 8 blocks
BLOCK = 129           # 128 inputs + 1 shifted target
N_BLOCKS = CHUNK // BLOCK
SEED = 3406
ROUND = 6             # decimals of every double in a query result


def r(c) -> F.Column:
    """Round a double column the same way the SQL twins do."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), ROUND)


def doc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, split, lang, ids): hashed ids, EOS-terminated."""
    docs = tables.documents(spark, sf_dir)
    return encode_documents(docs, vocab_size=VOCAB, keep=("doc_id", "source", "split", "lang"))


def packing_input(spark: SparkSession, sf_dir: str, keys=("source",)) -> tuple[DataFrame, dict]:
    """The documents' ids, partitioned by ranges of document ids, and the packer's options that say so."""
    b = tables.document_buckets(spark, sf_dir)
    ids = encode_documents(tables.bucketed_documents(spark, sf_dir, b), vocab_size=VOCAB,
                           keep=("doc_id", "source", "split", "lang", "doc_bucket"))
    return ids, {"keys": keys, "bucket": "doc_bucket", "base_rows": b.pairs(keys)}


def blocks(spark: SparkSession, sf_dir: str, keys=("source",), remainder: str = "keep") -> DataFrame:
    ids, how = packing_input(spark, sf_dir, keys)
    return pack(ids, CHUNK, BLOCK, remainder=remainder, **how)


def written_chunks(spark: SparkSession, sf_dir: str, keys=("source",), remainder: str = "keep") -> DataFrame:
    ids, how = packing_input(spark, sf_dir, keys)
    return chunks(ids, CHUNK, remainder=remainder, **how)


def checksum(arr: str) -> F.Column:
    """sum(id * position) over a 1-based position, as bigint."""
    return F.aggregate(
        F.transform(F.col(arr), lambda x, i: x.cast("bigint") * (i + 1)), F.lit(0).cast("bigint"), lambda a, b: a + b
    )


# ---- DuckDB building blocks -------------------------------------------------

SQL_WORDS = r"list_filter(regexp_split_to_array(text, '[ \t\n\r\f]+'), lambda x: x <> '')"
SQL_SPLIT = "CASE WHEN (doc_id // 20) % 10 = 0 THEN 'valid' ELSE 'train' END"

SQL_DOC_IDS = rf"""doc_ids AS (
  SELECT doc_id, source, {SQL_SPLIT} AS split, lang,
         list_concat(list_transform({SQL_WORDS},
             lambda w: CAST(1 + (('0x' || substr(md5(w), 1, 8))::BIGINT % {VOCAB - 1}) AS INTEGER)), [0]) AS ids
  FROM documents WHERE text IS NOT NULL)"""

SQL_DOC_OFF = """doc_off AS (
  SELECT *, CAST(SUM(len(ids)) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) - len(ids) AS start,
            CAST(SUM(len(ids)) OVER (PARTITION BY source) AS BIGINT) AS key_tokens
  FROM doc_ids)"""

SQL_TOKS = """toks AS (
  SELECT source, key_tokens, doc_id, start + k AS pos, k, id
  FROM (SELECT source, key_tokens, doc_id, start, unnest(ids) AS id, unnest(range(len(ids))) AS k FROM doc_off))"""

SQL_BTOKS = f"""btoks AS (
  SELECT source, pos // {CHUNK} AS chunk_id, (pos % {CHUNK}) // {BLOCK} AS block_in_chunk,
         (pos % {CHUNK}) % {BLOCK} AS i, id
  FROM toks
  WHERE pos % {CHUNK} < {N_BLOCKS * BLOCK})"""

SQL_BLOCKS = f"""blocks AS (
  SELECT source, chunk_id, block_in_chunk, chunk_id * {N_BLOCKS} + block_in_chunk AS block_no,
         list(id ORDER BY i) AS tokens
  FROM btoks GROUP BY source, chunk_id, block_in_chunk)"""


SQL_SUMS = """sums AS (SELECT source, chunk_id, block_in_chunk, CAST(sum(CAST(id AS BIGINT) * (i + 1)) AS BIGINT) AS checksum
  FROM btoks GROUP BY source, chunk_id, block_in_chunk)"""


def with_sql(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes)


PACK_CTES = (SQL_DOC_IDS, SQL_DOC_OFF, SQL_TOKS, SQL_BTOKS)


def sql_num(x: float) -> str:
    """A double literal that parses to exactly the Python float on both engines."""
    return f"CAST({float(x)!r} AS DOUBLE)"


def sql_pack(keys: tuple[str, ...], tag: str, remainder: str = "keep") -> list[str]:
    """CTEs ``{tag}_off``, ``{tag}_toks``, ``{tag}_btoks``, ``{tag}_blocks`` packing
    ``doc_ids`` per ``keys`` (chunk CHUNK, block BLOCK, tail kept or dropped)."""
    tail = f"pos // {CHUNK} < (key_tokens + {CHUNK - 1}) // {CHUNK} - 1" if remainder == "drop" else "TRUE"
    k = ", ".join(keys)
    off = f"""{tag}_off AS (
  SELECT *, CAST(SUM(len(ids)) OVER (PARTITION BY {k} ORDER BY doc_id) AS BIGINT) - len(ids) AS start,
            CAST(SUM(len(ids)) OVER (PARTITION BY {k}) AS BIGINT) AS key_tokens
  FROM doc_ids)"""
    toks = f"""{tag}_toks AS (
  SELECT {k}, key_tokens, doc_id, start + kk AS pos, kk, id
  FROM (SELECT {k}, key_tokens, doc_id, start, unnest(ids) AS id, unnest(range(len(ids))) AS kk FROM {tag}_off))"""
    btoks = f"""{tag}_btoks AS (
  SELECT {k}, pos // {CHUNK} AS chunk_id, (pos % {CHUNK}) // {BLOCK} AS block_in_chunk,
         (pos % {CHUNK}) % {BLOCK} AS i, id
  FROM {tag}_toks
  WHERE {tail} AND pos % {CHUNK} < {N_BLOCKS * BLOCK})"""
    blocks_ = f"""{tag}_blocks AS (
  SELECT {k}, chunk_id, block_in_chunk, chunk_id * {N_BLOCKS} + block_in_chunk AS block_no,
         list(id ORDER BY i) AS tokens
  FROM {tag}_btoks GROUP BY {k}, chunk_id, block_in_chunk)"""
    return [off, toks, btoks, blocks_]


def sql_pairs(keys: tuple[str, ...], tag: str, src: str | None = None, where: str = "TRUE") -> str:
    """CTE ``{tag}_pairs``: one row per (input, target) position of the blocks."""
    k = ", ".join(keys)
    src = src or f"{tag}_blocks"
    return f"""{tag}_pairs AS (
  SELECT {k}, block_no, unnest(list_slice(tokens, 1, len(tokens) - 1)) AS u,
         unnest(list_slice(tokens, 2, len(tokens))) AS v, unnest(range(len(tokens) - 1)) AS pos
  FROM {src} WHERE {where} AND len(tokens) > 1)"""
