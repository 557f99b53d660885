"""Registered queries for mixtures.

The mixture fixture is one row per distinct ``source`` of ``documents``:
``group_id`` by name order, ``weight = 1 + the number in the name``.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from blendwise.functions.prefix import DEFAULT_BUCKET_WIDTH
from blendwise.operators import layout as ly
from blendwise.operators import mixture as mx
from blendwise.operators.tokens import corpus_stats
from blendwise.plans.common import (
    BLOCK, CHUNK, N_BLOCKS, PACK_CTES, SEED, SQL_SUMS, VOCAB, blocks, checksum, doc_ids, r, with_sql, written_chunks,
)
from blendwise.plans.packing_queries import BUFFER_CHUNKS, SHARDS, SQL_NFILES, SQL_POSITIONED, files, layout, n_positions, source_sizes
from blendwise.plans.registry import query
from blendwise.session import cut_lineage, with_scalars
from blendwise.sources import tables

MIN_FILES = 19
DRAWS_PER_DOC = 20
MIX_DRAWS_PER_DOC = 3
MICRO = 16
ACCUM = 4

SQL_MIX = """mix AS (
  SELECT CAST(row_number() OVER (ORDER BY source) - 1 AS INTEGER) AS group_id, source,
         CAST(1 + CAST(regexp_extract(source, '[0-9]+') AS BIGINT) AS DOUBLE) AS weight
  FROM (SELECT DISTINCT source FROM documents))"""

SQL_IV = """iv AS (
  SELECT group_id, source, p, round(c - p, 12) AS lo,
         CASE WHEN group_id = max(group_id) OVER () THEN CAST(1.0 AS DOUBLE) ELSE round(c, 12) END AS hi
  FROM (SELECT *, sum(p) OVER (ORDER BY group_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c
        FROM (SELECT *, weight / sum(weight) OVER () AS p FROM mix)))"""


def sql_draws(per_doc: int) -> str:
    return f"""dr AS (
  SELECT range AS draw_idx,
         CAST(('0x' || substr(md5('{SEED}:' || range), 1, 8))::BIGINT AS DOUBLE) / CAST(4294967296 AS DOUBLE) AS u
  FROM range(0, {per_doc} * (SELECT count(*) FROM documents WHERE text IS NOT NULL))),
draws AS (SELECT d.draw_idx, i.group_id, i.source FROM dr d JOIN iv i ON d.u >= i.lo AND d.u < i.hi)"""


SQL_MIXED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY draw_idx) - 1 AS read_index FROM draws),
mixed AS (SELECT r.draw_idx, r.group_id, r.source, r.read_index, r.read_index // p.n_blocks AS epoch,
                 p.chunk_id, p.block_in_chunk
          FROM ranked r JOIN pos p ON p.source = r.source AND p.position = r.read_index % p.n_blocks)"""


def mixture(spark, sf):
    src = tables.table(spark, sf, "documents").select("source").distinct()
    w = Window.orderBy("source")  # K rows: one per source
    return src.select(
        (F.row_number().over(w) - 1).cast("int").alias("group_id"), "source",
        (F.lit(1) + F.regexp_extract("source", "[0-9]+", 0).cast("bigint")).cast("double").alias("weight"),
    )


def local_mixture(spark, sf):
    """The mixture as a local table of K rows (plans that join it need no scan of the documents), and K."""
    rows = [tuple(r) for r in mixture(spark, sf).collect()]
    return spark.createDataFrame(rows, "group_id int, source string, weight double"), len(rows)


def n_docs(spark, sf) -> int:
    return tables.documents(spark, sf).count()


def draws(spark, sf, per_doc=DRAWS_PER_DOC):
    m, k = local_mixture(spark, sf)  # one row per source: the size bound that allows the broadcast
    return mx.draw_sources(spark, per_doc * n_docs(spark, sf), m, SEED, mixture_rows=k)


def mixed(spark, sf, ids=True):
    """Draws with their blocks' places and (``ids``) contents."""
    pos, sizes = layout(spark, sf)
    m, k = local_mixture(spark, sf)
    n = MIX_DRAWS_PER_DOC * n_docs(spark, sf)
    d = mx.draw_sources(spark, n, m, SEED, mixture_rows=k)
    out = mx.mix(pos, d, sizes=sizes, draw_buckets=k * (n // DEFAULT_BUCKET_WIDTH + 1))
    return ly.attach_blocks(out, written_chunks(spark, sf), BLOCK) if ids else out


@query("m1_normalize", f"""WITH {SQL_MIX}
SELECT 'numbered' AS run_id, source, round(weight / sum(weight) OVER (), 6) AS p FROM mix
UNION ALL SELECT 'uniform', source, round(1.0 / count(*) OVER (), 6) FROM mix""")
def m1_normalize(spark, sf):
    m = mixture(spark, sf)
    runs = m.withColumn("run_id", F.lit("numbered")).unionByName(
        m.withColumn("run_id", F.lit("uniform")).withColumn("weight", F.lit(1.0)))
    return mx.normalize(runs).select("run_id", "source", r("p").alias("p"))


@query("m2_valid_sources", f"""{with_sql(*PACK_CTES[:2], SQL_MIX, SQL_NFILES)}
SELECT CAST(row_number() OVER (ORDER BY m.group_id) - 1 AS INTEGER) AS group_id, m.source, CAST(nf.n_files AS BIGINT) AS n_files
FROM mix m JOIN nf USING (source) WHERE nf.n_files >= {MIN_FILES}""")
def m2_valid_sources(spark, sf):
    v = mx.valid_sources(mixture(spark, sf), files(spark, sf), MIN_FILES)
    return v.select("group_id", "source", F.col("n_files").cast("bigint"))


@query("m3_draw_sources", f"""WITH {SQL_MIX}, {SQL_IV}, {sql_draws(DRAWS_PER_DOC)}
SELECT draw_idx, group_id, source FROM draws""")
def m3_draw_sources(spark, sf):
    return draws(spark, sf).select("draw_idx", "group_id", "source")


@query("m4_mix", f"""{with_sql(*PACK_CTES, SQL_SUMS, SQL_NFILES, SQL_POSITIONED, SQL_MIX, SQL_IV, sql_draws(MIX_DRAWS_PER_DOC), SQL_MIXED)}
SELECT draw_idx, source, CAST(read_index AS BIGINT) AS read_index, CAST(epoch AS BIGINT) AS epoch, chunk_id, block_in_chunk, checksum
FROM mixed JOIN sums USING (source, chunk_id, block_in_chunk)""")
def m4_mix(spark, sf):
    return mixed(spark, sf).select("draw_idx", "source", "read_index", "epoch", "chunk_id", "block_in_chunk",
                                   checksum("tokens").alias("checksum"))


SQL_RANKS = f"""shard AS (SELECT s.source, s.chunk_id, CAST((s.file_rank - 1) % {SHARDS} AS INTEGER) AS rank, (s.file_rank - 1) // {SHARDS} AS i
  FROM sfiles s JOIN nf USING (source) WHERE s.file_rank - 1 < nf.n_files // {SHARDS} * {SHARDS}),
rb AS (SELECT h.source, h.rank, h.chunk_id, h.i, b.block_in_chunk, h.i // {BUFFER_CHUNKS} AS buffer,
         ('0x' || substr(md5(({SEED} + h.rank) || ':' || h.source || ':' || (h.i + 1) || ':' || b.block_in_chunk), 1, 15))::BIGINT AS k
       FROM shard h JOIN (SELECT DISTINCT source, chunk_id, block_in_chunk FROM btoks) b USING (source, chunk_id)),
rpos AS (SELECT *, row_number() OVER (PARTITION BY source, rank ORDER BY buffer, k, i, block_in_chunk) - 1 AS position,
           count(*) OVER (PARTITION BY source, rank) AS n_blocks FROM rb),
rmix AS (SELECT CAST(row_number() OVER (ORDER BY source) - 1 AS INTEGER) AS group_id, source, weight
         FROM mix JOIN nf USING (source) WHERE n_files >= {SHARDS}),
riv AS (SELECT group_id, source, round(c - p, 12) AS lo, CASE WHEN group_id = max(group_id) OVER () THEN CAST(1.0 AS DOUBLE) ELSE round(c, 12) END AS hi
        FROM (SELECT *, sum(p) OVER (ORDER BY group_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c
              FROM (SELECT *, weight / sum(weight) OVER () AS p FROM rmix))),
rd AS (SELECT d.draw_idx, i.source, row_number() OVER (PARTITION BY i.source ORDER BY d.draw_idx) - 1 AS read_index
       FROM dr d JOIN riv i ON d.u >= i.lo AND d.u < i.hi),
ranked AS (SELECT unnest(range({SHARDS})) AS rank)"""


@query("m4_mix_ranks", f"""{with_sql(*PACK_CTES, SQL_SUMS, SQL_NFILES, SQL_MIX, SQL_IV, sql_draws(MIX_DRAWS_PER_DOC), SQL_RANKS)}
SELECT CAST(k.rank AS INTEGER) AS rank, rd.draw_idx, rd.source, CAST(rd.read_index AS BIGINT) AS read_index,
       CAST(rd.read_index // p.n_blocks AS BIGINT) AS epoch, p.chunk_id, p.block_in_chunk, checksum
FROM rd CROSS JOIN ranked k JOIN rpos p ON p.source = rd.source AND p.rank = k.rank AND p.position = rd.read_index % p.n_blocks
JOIN sums s ON s.source = p.source AND s.chunk_id = p.chunk_id AND s.block_in_chunk = p.block_in_chunk""")
def m4_mix_ranks(spark, sf):
    """Every rank's own training stream: its own files, its own block order, the sources that all ranks draw."""
    sizes, rows = source_sizes(spark, sf)
    lay = ly.block_layout(sizes, CHUNK, BLOCK, SEED, BUFFER_CHUNKS, ranks=SHARDS)
    per_rank = cut_lineage(lay.groupBy("source", "rank").agg(F.max("n_blocks").alias("n_blocks")))  # K rows a rank
    m = mx.valid_sources(local_mixture(spark, sf)[0], sizes.select("source", F.explode(F.sequence(F.lit(1), F.least("n_files", F.lit(SHARDS)))).alias("f")), SHARDS)
    n = MIX_DRAWS_PER_DOC * n_docs(spark, sf)
    d = mx.draw_sources(spark, n, m, SEED, mixture_rows=len(rows))
    out = mx.sharded_mix(ly.bounded_layout(lay, n_positions(rows)), d, SHARDS, per_rank, draw_buckets=len(rows) * (n // DEFAULT_BUCKET_WIDTH + 1))
    out = ly.rank_partitions(ly.attach_blocks(out, written_chunks(spark, sf), BLOCK), SHARDS, n_draws=n)
    return out.select("rank", "draw_idx", "source", "read_index", "epoch", "chunk_id", "block_in_chunk", checksum("tokens").alias("checksum"))


@query("m3_draw_sources_runs", f"""WITH {SQL_MIX}, {SQL_IV}, {sql_draws(DRAWS_PER_DOC)}
SELECT 'a' AS run_id, draw_idx, group_id, source FROM draws UNION ALL SELECT 'b', draw_idx, group_id, source FROM draws""")
def m3_draw_sources_runs(spark, sf):
    m = mixture(spark, sf)
    both = m.withColumn("run_id", F.lit("a")).unionByName(m.withColumn("run_id", F.lit("b")))
    d = mx.draw_sources(spark, DRAWS_PER_DOC * n_docs(spark, sf), both, SEED, mixture_rows=2 * m.count())
    return d.select("run_id", "draw_idx", "group_id", "source")


@query("m5_batches", f"""WITH {SQL_MIX}, {SQL_IV}, {sql_draws(DRAWS_PER_DOC)}
SELECT draw_idx, group_id, draw_idx // {MICRO} AS micro_batch, draw_idx // {MICRO * ACCUM} AS opt_step FROM draws""")
def m5_batches(spark, sf):
    return mx.batches(draws(spark, sf), MICRO, ACCUM).select("draw_idx", "group_id", "micro_batch", "opt_step")


@query("m6_batch_groups", f"""WITH {SQL_MIX}, {SQL_IV}, {sql_draws(DRAWS_PER_DOC)}
SELECT draw_idx // {MICRO} AS micro_batch, group_id, count(*) AS n_rows FROM draws GROUP BY ALL""")
def m6_batch_groups(spark, sf):
    return mx.batch_groups(mx.batches(draws(spark, sf), MICRO, ACCUM))


@query("m7_mixture_size", f"""{with_sql(*PACK_CTES)},
bl AS (SELECT source, chunk_id, block_in_chunk, count(*) AS nt FROM btoks GROUP BY ALL)
SELECT source, count(*) AS n_blocks, CAST(sum(nt) AS BIGINT) AS n_tokens FROM bl GROUP BY ROLLUP (source)""")
def m7_mixture_size(spark, sf):
    return mx.mixture_size(blocks(spark, sf))


@query("m8_proportional", f"""{with_sql(PACK_CTES[0], SQL_MIX)},
st AS (SELECT source, CAST(sum(len(ids)) AS BIGINT) AS n_tokens FROM doc_ids GROUP BY source)
SELECT source, round(w / sum(w) OVER (), 6) AS p FROM (SELECT source, CAST(n_tokens AS DOUBLE) * weight AS w FROM mix JOIN st USING (source))""")
def m8_proportional(spark, sf):
    st = corpus_stats(doc_ids(spark, sf), vocab_size=VOCAB)
    return mx.proportional(mixture(spark, sf), st).select("source", r("p").alias("p"))


@query("m9_mixture_report", f"""{with_sql(*PACK_CTES, SQL_NFILES, SQL_POSITIONED, SQL_MIX, SQL_IV, sql_draws(MIX_DRAWS_PER_DOC), SQL_MIXED)},
got AS (SELECT source, count(*) AS reads, max(epoch) + 1 AS epochs FROM mixed GROUP BY source)
SELECT m.source, round(m.weight / sum(m.weight) OVER (), 6) AS expected_share, CAST(coalesce(g.reads, 0) AS BIGINT) AS reads,
       CAST(coalesce(g.epochs, 0) AS BIGINT) AS epochs,
       round(coalesce(g.reads, 0) / sum(coalesce(g.reads, 0)) OVER (), 6) AS drawn_share
FROM mix m LEFT JOIN got g USING (source)""")
def m9_mixture_report(spark, sf):
    rep = mx.mixture_report(mixed(spark, sf, ids=False), mixture(spark, sf))
    return rep.select("source", r("expected_share").alias("expected_share"), "reads", "epochs",
                      r("drawn_share").alias("drawn_share"))


SQL_STATE = f"""st AS (SELECT split AS run_id, CAST(0 AS BIGINT) AS step, source, CAST(sum(len(ids)) AS DOUBLE) / 10000.0 AS z
       FROM doc_ids GROUP BY split, source),
sm AS (SELECT *, exp(z - max(z) OVER (PARTITION BY run_id, step)) AS e FROM st),
probs AS (SELECT run_id, step, source, z, e / sum(e) OVER (PARTITION BY run_id, step) AS p FROM sm)"""


def state(spark, sf):
    d = doc_ids(spark, sf)
    return d.groupBy(F.col("split").alias("run_id"), "source").agg(
        (F.sum(F.size("ids")).cast("double") / F.lit(10000.0)).alias("z")).withColumn("step", F.lit(0).cast("bigint"))


def probs(spark, sf):
    return mx.softmax(state(spark, sf))


@query("m10_softmax", f"""WITH {PACK_CTES[0]}, {SQL_STATE}
SELECT run_id, step, source, round(p, 6) AS p FROM probs""")
def m10_softmax(spark, sf):
    return probs(spark, sf).select("run_id", "step", "source", r("p").alias("p"))


@query("m11_sample_weights", f"""WITH {SQL_MIX}, {SQL_IV}, {sql_draws(DRAWS_PER_DOC)}, {PACK_CTES[0]}, {SQL_STATE}
SELECT d.draw_idx, d.source, round(coalesce(p.p, 0.0), 6) AS sample_weight
FROM draws d LEFT JOIN (SELECT source, p FROM probs WHERE run_id = 'train') p USING (source)""")
def m11_sample_weights(spark, sf):
    pr = probs(spark, sf).filter(F.col("run_id") == "train").select("source", "p")
    sw = mx.sample_weights(draws(spark, sf), pr, probs_rows=None)
    return sw.select("draw_idx", "source", r("sample_weight").alias("sample_weight"))


@query("m12_apply_mixture", f"""{with_sql(*PACK_CTES, SQL_SUMS, SQL_NFILES, SQL_POSITIONED, SQL_STATE)},
budget AS (SELECT CAST(sum(len(ids)) AS BIGINT) AS b FROM doc_ids WHERE split = 'train'),
need AS (SELECT source, CAST(ceil(p * (SELECT b FROM budget) / {BLOCK}) AS BIGINT) AS nd FROM probs WHERE run_id = 'train'),
reads AS (SELECT source, unnest(range(nd)) AS read_index FROM need WHERE nd > 0)
SELECT r.source, CAST(r.read_index AS BIGINT) AS read_index, CAST(r.read_index // p.n_blocks AS BIGINT) AS epoch,
       p.chunk_id, p.block_in_chunk, checksum
FROM reads r JOIN pos p ON p.source = r.source AND p.position = r.read_index % p.n_blocks
JOIN sums s ON s.source = p.source AND s.chunk_id = p.chunk_id AND s.block_in_chunk = p.block_in_chunk""")
def m12_apply_mixture(spark, sf):
    return _applied(spark, sf, repeat=True)


@query("m12_apply_mixture_once", f"""{with_sql(*PACK_CTES, SQL_SUMS, SQL_NFILES, SQL_POSITIONED, SQL_STATE)},
budget AS (SELECT CAST(sum(len(ids)) AS BIGINT) AS b FROM doc_ids WHERE split = 'train'),
need AS (SELECT source, CAST(ceil(p * (SELECT b FROM budget) / {BLOCK}) AS BIGINT) AS nd FROM probs WHERE run_id = 'train')
SELECT p.source, CAST(p.position AS BIGINT) AS read_index, CAST(0 AS BIGINT) AS epoch, p.chunk_id, p.block_in_chunk, checksum
FROM need n JOIN pos p ON p.source = n.source AND p.position < n.nd JOIN sums s ON s.source = p.source AND s.chunk_id = p.chunk_id AND s.block_in_chunk = p.block_in_chunk""")
def m12_apply_mixture_once(spark, sf):
    return _applied(spark, sf, repeat=False)


def _applied(spark, sf, repeat):
    d = doc_ids(spark, sf).filter(F.col("split") == "train")
    budget = d.agg(F.sum("n_tokens").cast("bigint").alias("_budget"))
    pr = probs(spark, sf).filter(F.col("run_id") == "train").select("source", "p")
    pos, sizes = layout(spark, sf)
    out = mx.apply_mixture(pos, with_scalars(pr, budget), F.col("_budget"), BLOCK, repeat=repeat, sizes=sizes)
    out = ly.attach_blocks(out, written_chunks(spark, sf), BLOCK)
    return out.select("source", "read_index", "epoch", "chunk_id", "block_in_chunk", checksum("tokens").alias("checksum"))
