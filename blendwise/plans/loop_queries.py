"""Registered queries for the search loop, the softmax head, the streaming
metrics' batch twin and the streaming pack's batch run (L19, L21, R10, P11)."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from blendwise.operators import gradients as gr
from blendwise.operators import layout as ly
from blendwise.operators import optim as op
from blendwise.operators import loss as ls
from blendwise.operators import packing as pk
from blendwise.plans.common import BLOCK, CHUNK, SEED, VOCAB, doc_ids, packing_input, sql_num, with_sql
from blendwise.plans.loss_queries import SQL_LANG, SQL_PROXY, lang_blocks, rnd
from blendwise.plans.registry import query
from blendwise.plans.search import SearchConfig, run_search, search
from blendwise.plans.softmax_head import fit_softmax_head
from blendwise.session import cut_lineage, scratch_path
from blendwise.sources import tables
from blendwise.streaming.metrics_stream import metrics_stream

SEARCH = SearchConfig(n_iters=40, interval=10, micro_batch=16, mix_lr=0.01, order="unigram", vocab=VOCAB,
                      run_id="val", source="lang")


STEPS = 4


def whole_corpus(spark, sf, cfg, steps=STEPS):
    """The configuration with as many iterations as the train split has micro-batches, in ``steps`` intervals."""
    d = doc_ids(spark, sf).filter(F.col("split") == "train")
    blocks = d.groupBy("lang").agg(F.ceil(F.sum("n_tokens") / BLOCK).alias("n")).agg(F.sum("n")).first()[0] or 0  # one number
    n_iters = max(steps + 1, -(-int(blocks) // cfg.micro_batch))
    return replace(cfg, n_iters=n_iters, interval=max(1, n_iters // steps),
                   anneal_t_max=n_iters if cfg.anneal_t_max else None)


def lang_positioned(spark, sf, split="train"):
    """Blocks of one split packed per language, files shuffled, blocks shuffled in
    one-file buffers (as the training loader), with their read positions: the places alone, and the chunks with the ids."""
    d = doc_ids(spark, sf).filter(F.col("split") == split)
    totals = [(r["lang"], r["n"]) for r in d.groupBy("lang").agg(F.sum("n_tokens").alias("n")).collect()]  # one row per language
    sizes = ly.stream_sizes(spark.createDataFrame(totals, "lang string, n_ids bigint"), CHUNK, BLOCK, keys=("lang",))
    return ly.block_layout(sizes, CHUNK, BLOCK, SEED, 1, keys=("lang",))


def lang_chunks(spark, sf, split="train"):
    ids, how = packing_input(spark, sf, ("lang",))
    return pk.chunks(ids.filter(F.col("split") == split), CHUNK, **how)


def lang_mixture(spark, sf):
    langs = tables.documents(spark, sf).select("lang").distinct()
    return langs.select("lang", (F.row_number().over(Window.orderBy("lang")) - 1).cast("int").alias("group_id"),
                        F.lit(1.0).alias("weight"))  # K rows: one per language


def val_target(spark, sf, lang=None, order="unigram"):
    b = lang_blocks(spark, sf).filter(F.col("split") == "valid")  # all validation blocks
    if lang is not None:
        b = b.filter(F.col("lang") == lang)
    return gr.val_gradient(ls.pair_counts(b, ["lang"], order=order), "lang")


SQL_SEARCH_BLOCKS = f"""tb AS (SELECT lang, chunk_id, block_in_chunk, tokens FROM l_blocks WHERE split = 'train'),
tf AS (SELECT lang, chunk_id, row_number() OVER (PARTITION BY lang ORDER BY ('0x' || substr(md5('{SEED}:' || file), 1, 15))::BIGINT, file) AS file_rank
       FROM (SELECT DISTINCT lang, chunk_id, 'train_' || lang || '_0_' || lpad(CAST(chunk_id AS VARCHAR), 10, '0') || '.bin' AS file FROM tb)),
tp AS (SELECT lang, tokens, count(*) OVER (PARTITION BY lang) AS n_blocks,
         row_number() OVER (PARTITION BY lang ORDER BY file_rank,
           ('0x' || substr(md5('{SEED}:' || lang || ':' || file_rank || ':' || block_in_chunk), 1, 15))::BIGINT, block_in_chunk) - 1 AS position
       FROM tb JOIN tf USING (lang, chunk_id)),
tm AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS group_id, CAST(1 AS DOUBLE) / count(*) OVER () AS w FROM (SELECT DISTINCT lang FROM documents)),
ti AS (SELECT lang, round(c - w, 12) AS lo, CASE WHEN group_id = max(group_id) OVER () THEN CAST(1 AS DOUBLE) ELSE round(c, 12) END AS hi
       FROM (SELECT *, sum(w) OVER (ORDER BY group_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM tm)),
tn AS (SELECT n, greatest(1, n // {STEPS}) AS width FROM (SELECT greatest({STEPS + 1}, CAST(ceil(sum(b) / {SEARCH.micro_batch}) AS BIGINT)) AS n
       FROM (SELECT ceil(sum(len(ids)) / {BLOCK}) AS b FROM doc_ids WHERE split = 'train' GROUP BY lang))),
td AS (SELECT range AS draw_idx, CAST(('0x' || substr(md5('{SEED}:' || range), 1, 8))::BIGINT AS DOUBLE) / CAST(4294967296 AS DOUBLE) AS u
       FROM range(0, {SEARCH.micro_batch} * (SELECT n FROM tn))),
tr AS (SELECT draw_idx, lang, row_number() OVER (PARTITION BY lang ORDER BY draw_idx) - 1 AS k FROM td JOIN ti ON u >= lo AND u < hi),
tx AS (SELECT r.draw_idx // {SEARCH.micro_batch} AS it, r.lang, unnest(list_slice(p.tokens, 2, len(p.tokens))) AS v
       FROM tr r JOIN tp p ON p.lang = r.lang AND p.position = r.k % p.n_blocks),
tc AS (SELECT it, it // width AS part, lang, v, count(*) AS n FROM tx, tn GROUP BY ALL),
tq AS (SELECT it, lang, v, n / sum(n) OVER (PARTITION BY it, lang) AS q FROM tc, (SELECT width FROM tn) WHERE it % width = 0)"""

SQL_VAL_TARGET = """g0 AS (SELECT lang, v, count(*) AS n FROM l_pairs WHERE split = 'valid' GROUP BY ALL),
gt AS (SELECT v, sum(q) / (SELECT count(DISTINCT lang) FROM g0) AS q FROM (SELECT lang, v, n / sum(n) OVER (PARTITION BY lang) AS q FROM g0) GROUP BY v)"""


def sql_qa_target() -> str:
    from blendwise.plans.qa_queries import SQL_ITEMS, SQL_QA, sql_sample

    return f"""{SQL_QA}, {sql_sample()}, {SQL_ITEMS},
g0 AS (SELECT (qa_order - 1) // 16 AS batch, unnest(targets) AS v FROM items),
g1 AS (SELECT batch, v, count(*) AS n FROM g0 WHERE v <> -100 GROUP BY ALL),
g2 AS (SELECT (qa_order - 1) // 16 AS batch, count(*) AS len FROM items GROUP BY 1),
gt AS (SELECT v, sum(n / (nb * len)) / ((SELECT count(*) FROM items) // 16) AS q
       FROM (SELECT *, sum(n) OVER (PARTITION BY batch) AS nb FROM g1) JOIN g2 USING (batch) GROUP BY v)"""


def sql_search(cfg, target: str) -> str:
    """The search with the unigram head, its steps unrolled."""
    a, adam = sql_num(cfg.alpha), cfg.optimizer
    b1, b2, eps = (sql_num(adam[k]) for k in ("beta1", "beta2", "eps"))
    one = sql_num(1.0)
    normal = f"""sqrt(-2.0 * ln((CAST(('0x' || substr(h, 1, 8))::BIGINT AS DOUBLE) + 0.5) / CAST(4294967296 AS DOUBLE)))
        * cos({sql_num(2.0 * 3.141592653589793)} * CAST(('0x' || substr(h, 9, 8))::BIGINT AS DOUBLE) / CAST(4294967296 AS DOUBLE))"""
    z0 = one if cfg.init == "ones" else f"1e-7 * {normal}"
    soft = lambda k: f"p{k} AS (SELECT *, exp(z - mz) / sum(exp(z - mz)) OVER () AS p FROM (SELECT *, max(z) OVER () AS mz FROM s{k}))"
    out = [f"s0 AS (SELECT lang, {z0} AS z, CAST(0 AS DOUBLE) AS m, CAST(0 AS DOUBLE) AS vv FROM (SELECT lang, md5('{cfg.seed}:' || lang) AS h FROM tm))", soft(0)]
    for k in range(STEPS):
        rate = sql_num(cfg.mix_lr)
        if cfg.anneal_t_max:
            rate = f"({rate} * (1.0 + cos({sql_num(math.pi)} * {k + 1} / (SELECT n FROM tn))) / 2.0)"
        before = "" if k == 0 else f" UNION ALL SELECT v, c FROM c{k - 1}"
        out.append(f"""c{k} AS (SELECT v, sum(c) AS c FROM (SELECT v, p * n AS c FROM tc JOIN p{k} USING (lang) WHERE part = {k}{before}) GROUP BY v),
x{k} AS (SELECT sum(c) + {a} * {cfg.vocab} AS zu, ({sql_num(cfg.vocab * cfg.alpha ** 2)} + {sql_num(2 * cfg.alpha)} * sum(c) + sum(c * c)) AS s FROM c{k}),
b{k} AS (SELECT lang, v, q FROM tq, tn WHERE it = {k + 1} * width),
i{k} AS (SELECT lang, (SELECT sum(q) FROM gt) * (SELECT s / (zu * zu) FROM x{k})
           - (SELECT sum(q) FROM gt) * sum(b.q * ({a} + coalesce(c.c, 0)) / zu)
           - (SELECT sum(g.q * ({a} + coalesce(c2.c, 0)) / zu) FROM gt g LEFT JOIN c{k} c2 USING (v), x{k})
           + sum(b.q * coalesce(g2.q, 0)) AS ip
         FROM b{k} b LEFT JOIN c{k} c USING (v) LEFT JOIN gt g2 USING (v), x{k} GROUP BY lang),
d{k} AS (SELECT p{k}.*, -{sql_num(cfg.learning_rate)} * coalesce(ip, 0) AS g FROM p{k} LEFT JOIN i{k} USING (lang)),
e{k} AS (SELECT *, p * (g - sum(g * p) OVER ()) AS dz FROM d{k}),
s{k + 1} AS (SELECT lang, m2 AS m, v2 AS vv, z - {rate} * (m2 / (1.0 - pow({b1}, {k + 1}))) / (sqrt(v2 / (1.0 - pow({b2}, {k + 1}))) + {eps}) AS z
  FROM (SELECT *, {b1} * m + {sql_num(1 - adam["beta1"])} * dz AS m2, {b2} * vv + {sql_num(1 - adam["beta2"])} * dz * dz AS v2 FROM e{k}))""")
        out.append(soft(k + 1))
    rows = " UNION ALL ".join(f"SELECT '{cfg.run_id}' AS run_id, CAST({k} * width AS BIGINT) AS step, lang, round(z, 9) AS z, round(p, 9) AS p "
                              f"FROM p{k}, tn WHERE {k} * width < n" for k in range(STEPS + 1))
    return with_sql(*SQL_LANG, SQL_SEARCH_BLOCKS, target, *out) + "\n" + rows


@query("l19_search", sql_search(SEARCH, SQL_VAL_TARGET))
def l19_search(spark, sf):
    cfg = whole_corpus(spark, sf, SEARCH)
    h = search(spark, lang_positioned(spark, sf), lang_mixture(spark, sf), val_target(spark, sf), cfg,
               chunk_rows=lang_chunks(spark, sf), block_size=BLOCK)
    return h.select("run_id", "step", "lang", rnd("z").alias("z"), rnd("p").alias("p"))


def sql_search_metrics(cfg, target: str) -> str:
    """Loss of every language's validation blocks under the proxy of each step."""
    sql = sql_search(cfg, target)
    sql = sql[:sql.index(f"SELECT '{cfg.run_id}' AS run_id, CAST(0 * width")].rstrip()
    a = sql_num(cfg.alpha)
    parts = " UNION ALL ".join(f"""SELECT '{cfg.run_id}' AS run_id, CAST({k + 1} * width AS BIGINT) AS step, lang,
  round(sum(vn.n * -ln(({a} + coalesce(c, 0)) / zu)) / sum(vn.n), 9) AS val_loss
FROM vn LEFT JOIN c{k} USING (v), x{k}, tn WHERE {k + 1} * width < tn.n GROUP BY lang, width""" for k in range(STEPS))
    return f"""{sql}, vn AS (SELECT lang, v, count(*) AS n FROM l_pairs WHERE split = 'valid' AND v <> -1 GROUP BY ALL)
{parts}"""


@query("l19_search_validation", sql_search_metrics(SEARCH, SQL_VAL_TARGET))
def l19_search_validation(spark, sf):
    """The loop's own output: validation loss of every language at every step."""
    cfg = whole_corpus(spark, sf, SEARCH)
    valid = lang_blocks(spark, sf).filter(F.col("split") == "valid").withColumnRenamed("lang", "set")
    counts = cut_lineage(ls.pair_counts(valid, ["set"], order="unigram"))
    run = run_search(spark, lang_positioned(spark, sf), lang_mixture(spark, sf), val_target(spark, sf), cfg,
                     chunk_rows=lang_chunks(spark, sf), block_size=BLOCK, validation=counts)
    return run.metrics.select("run_id", "step", F.col("set").alias("lang"), rnd("val_loss").alias("val_loss"))


FEATURES, HEAD_STEPS, HEAD_LR = 64, 3, 50.0


def sql_head() -> str:
    """The head's gradient steps, unrolled."""
    out = [f"""hc AS (SELECT f, v, sum(n) AS c FROM (SELECT CAST(('0x' || substr(md5(CAST(u AS VARCHAR)), 1, 8))::BIGINT % {FEATURES} AS INTEGER) AS f, v, n
           FROM lc WHERE split = 'train' AND v >= 0 AND v < {VOCAB}) GROUP BY f, v)""",
           "ht AS (SELECT f, sum(c) AS t FROM hc GROUP BY f)", "hn AS (SELECT sum(c) AS n FROM hc)",
           f"w0 AS (SELECT CAST(a.range AS INTEGER) AS f, CAST(b.range AS INTEGER) AS v, CAST(0 AS DOUBLE) AS w FROM range({FEATURES}) a, range({VOCAB}) b)"]
    for k in range(HEAD_STEPS + 1):
        out.append(f"""j{k} AS (SELECT x.f, x.v, x.w, x.w - m - ln(s) AS logp, coalesce(hc.c, 0) AS c, coalesce(ht.t, 0) AS t
          FROM (SELECT *, sum(exp(w - m)) OVER (PARTITION BY f) AS s FROM (SELECT *, max(w) OVER (PARTITION BY f) AS m FROM w{k})) x
          LEFT JOIN hc ON hc.f = x.f AND hc.v = x.v LEFT JOIN ht ON ht.f = x.f)""")
        out.append(f"w{k + 1} AS (SELECT f, v, w - {sql_num(HEAD_LR)} * (t * exp(logp) - c) / n AS w FROM j{k}, hn)")
    losses = " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS step, round(-sum(c * logp) / any_value(n), 9) AS loss FROM j{k}, hn" for k in range(HEAD_STEPS + 1))
    return with_sql(*SQL_LANG, SQL_PROXY[0], *out) + "\n" + losses


@query("l21_softmax_head", sql_head())
def l21_softmax_head(spark, sf):
    c = ls.pair_counts(lang_blocks(spark, sf).filter(F.col("split") == "train"), [])  # the head knows no languages
    _, losses = fit_softmax_head(spark, c, VOCAB, n_features=FEATURES, steps=HEAD_STEPS, lr=HEAD_LR)
    return losses.select("step", rnd("loss").alias("loss"))


R10_DELAY_MINUTES = 10


@query("r10_metrics_stream_closed", f"""
SELECT * FROM (SELECT event_type AS run_id, time_bucket(INTERVAL 1 hour, ts) AS window_start, count(*) AS batches,
       round(avg(ln(1 + value)), 9) AS mean_loss, round(exp(avg(ln(1 + value))), 9) AS ppl FROM events GROUP BY ALL)
WHERE window_start + INTERVAL 1 hour <= (SELECT max(ts) FROM events) - INTERVAL {R10_DELAY_MINUTES} minute""")
def r10_metrics_stream_closed(spark, sf):
    """The events as a stream, run to completion: the windows that the watermark has closed."""
    root = scratch_path(spark, "events")
    events = tables.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{root}/in")
    q = (metrics_stream(stream, "1 hour", f"{R10_DELAY_MINUTES} minutes").writeStream.format("parquet").option("path", f"{root}/out")
         .option("checkpointLocation", f"{root}/ckpt").outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    m = spark.read.parquet(f"{root}/out")
    return m.select("run_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "batches",
                    rnd("mean_loss").alias("mean_loss"), rnd("ppl").alias("ppl"))


@query("r10_metrics_stream", """
SELECT event_type AS run_id, time_bucket(INTERVAL 1 hour, ts) AS window_start, count(*) AS batches,
       round(count(*) / 3600.0, 9) AS batches_per_sec, count(*) * 16 AS samples, count(*) * 16 * 2048 AS tokens,
       round(avg(ln(1 + value)), 9) AS mean_loss, round(exp(avg(ln(1 + value))), 9) AS ppl
FROM events GROUP BY ALL""")
def r10_metrics_stream(spark, sf):
    m = metrics_stream(tables.table(spark, sf, "events"), "1 hour", "10 minutes")
    return m.select("run_id", "window_start", "batches", rnd("batches_per_sec").alias("batches_per_sec"),
                    "samples", "tokens", rnd("mean_loss").alias("mean_loss"), rnd("ppl").alias("ppl"))


SEARCH_QA = SearchConfig(n_iters=40, interval=10, micro_batch=16, mix_lr=0.01, order="unigram", vocab=VOCAB,
                         run_id="qa", source="lang", init="noise", optimizer=dict(op.QA_ADAM), anneal_t_max=40)


def qa_target(spark, sf, order="unigram"):
    """QA-target gradient (L11) over the pairs of the conversations, for the proxy head's context order."""
    from blendwise.operators import qa as qa_ops
    from blendwise.plans.qa_queries import items

    it = items(spark, sf)
    if order == "unigram":
        it = it.withColumn("ids", F.transform("ids", lambda x: F.lit(ls.UNIGRAM_CONTEXT)))
    return qa_ops.qa_gradient(it, check=False)


@query("l19_search_qa", sql_search(SEARCH_QA, sql_qa_target()))
def l19_search_qa(spark, sf):
    cfg = whole_corpus(spark, sf, SEARCH_QA)
    h = search(spark, lang_positioned(spark, sf), lang_mixture(spark, sf), qa_target(spark, sf), cfg,
               chunk_rows=lang_chunks(spark, sf), block_size=BLOCK)
    return h.select("run_id", "step", "lang", rnd("z").alias("z"), rnd("p").alias("p"))
