"""Registered queries for the proxy, losses, gradients and the mixture step
(L1-L10, L12-L15, L18, L20, L22).

Gradient and search queries use ``lang`` as the source column (FIXTURES.md):
documents are packed per (split, lang); the proxy is fitted on the train
pairs with weight 1/K per language; the target is the gradient of all validation
blocks of each language, averaged (its first batch of 2 blocks, the micro-batch of 16
divided by 8, is an option with a row of its own).
"""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from blendwise.operators import gradients as gr
from blendwise.operators import loss as ls
from blendwise.operators import optim as op
from blendwise.operators.packing import next_token
from blendwise.plans.common import SEED, SQL_DOC_IDS, VOCAB, sql_num, sql_pack, sql_pairs, with_sql
from blendwise.plans.common import blocks as packed_blocks
from blendwise.plans.registry import query
from blendwise.session import cut_lineage, reuse
from blendwise.sources import tables

ALPHA = 0.1
VAL_BATCH = 16 // 8
SMOOTHING = 0.1
MIX_LR = 0.01
LAMBDA = 0.1
CLIP_NORM = 0.05
LKEYS = ("split", "lang")


def rnd(c, digits: int = 9, scale: float = 1.0):
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double") * F.lit(scale), digits) if scale != 1.0 else F.round(col.cast("double"), digits)


# ---- Spark side -------------------------------------------------------------

def lang_blocks(spark, sf):
    return next_token(packed_blocks(spark, sf, keys=LKEYS))


def lang_counts(spark, sf, blocks=None, cut=True):
    """Pair counts of every (split, language).  With ``cut`` they are written to
    the shared checkpoint folder once, because the proxy, the gradients and
    the losses all read them (the plan would otherwise re-pack per branch)."""
    c = ls.pair_counts(blocks if blocks is not None else lang_blocks(spark, sf), LKEYS)
    return cut_lineage(c) if cut else c


def lang_weights(counts):
    langs = counts.filter(F.col("split") == "train").select("lang").distinct()
    return langs.withColumn("w", F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy()))  # K rows


def proxy(spark, sf, counts=None):
    c = counts if counts is not None else lang_counts(spark, sf)
    return ls.fit_proxy(c.filter(F.col("split") == "train"), lang_weights(c), alpha=ALPHA, vocab=VOCAB, source="lang")


def train_grad(counts):
    return gr.source_gradient(counts.filter(F.col("split") == "train").drop("split"), ["lang"])


def target_grad(counts, batches=None):
    """The target from the counts of every (split, language); with ``batches``, of every (split, language, block)."""
    valid = counts.filter(F.col("split") == "valid").drop("split")
    if batches is not None:
        valid = gr.first_blocks(valid, batches, VAL_BATCH).groupBy("lang", "u", "v").agg(F.sum("n").alias("n"))
    g = gr.val_gradient(valid, "lang")
    return gr.Grad(g.q.withColumn("target", F.lit("valid")), g.a.withColumn("target", F.lit("valid")), ["target"])


def inner(spark, sf):
    """Inner products of the validation target with each language's train
    gradient.  The blocks are packed once, for the counts that proxy, target and gradients share."""
    c = lang_counts(spark, sf)
    p0 = proxy(spark, sf, c)
    px = ls.Proxy(reuse(p0.pairs), reuse(p0.ctx), p0.alpha, p0.vocab)
    t0 = target_grad(c)
    tg = gr.Grad(reuse(t0.q), reuse(t0.a), t0.keys)
    return gr.inner_products(tg, train_grad(c), px), px, c


def init_lang_state(spark, sf, mode="ones", run_id="val"):
    langs = tables.documents(spark, sf).select(F.col("lang").alias("source")).distinct()
    return op.init_state(langs, mode, SEED, run_id)


def dz_table(spark, sf):
    ip, _, _ = inner(spark, sf)
    ip = cut_lineage(ip.select(F.col("lang").alias("source"), "ip"))  # K rows: every branch that reads them would compute them
    outs = []
    for run, lam in (("val", 0.0), ("val_entropy", LAMBDA)):
        st = init_lang_state(spark, sf, "ones", run)
        outs.append(op.mixture_gradient(ip.withColumn("run_id", F.lit(run)).withColumn("step", F.lit(0).cast("bigint")),
                                        st, MIX_LR, lam))
    return outs[0].unionByName(outs[1])


# ---- DuckDB side ------------------------------------------------------------

_A, _V = ALPHA, VOCAB
SQL_LANG = [SQL_DOC_IDS, *sql_pack(LKEYS, "l"), sql_pairs(LKEYS, "l")]
SQL_PROXY = [
    "lc AS (SELECT split, lang, u, v, count(*) AS n FROM l_pairs GROUP BY ALL)",
    "lw AS (SELECT lang, CAST(1 AS DOUBLE) / count(*) OVER () AS w FROM (SELECT DISTINCT lang FROM lc WHERE split = 'train'))",
    "pp AS (SELECT u, v, sum(lw.w * lc.n) AS c FROM lc JOIN lw USING (lang) WHERE split = 'train' AND v <> -1 GROUP BY u, v)",
    f"""pc AS (SELECT u, cu, cu + {sql_num(_A * _V)} AS zu,
       ({sql_num(_V * _A * _A)} + {sql_num(2 * _A)} * cu + c2) / ((cu + {sql_num(_A * _V)}) * (cu + {sql_num(_A * _V)})) AS s2,
       slog0 + ({_V} - n_seen) * ln({sql_num(_A)}) - {_V} * ln(cu + {sql_num(_A * _V)}) AS slog
  FROM (SELECT u, sum(c) AS cu, sum(c * c) AS c2, count(*) AS n_seen, sum(ln({sql_num(_A)} + c)) AS slog0 FROM pp GROUP BY u))""",
]
PROB = f"CASE WHEN pc.zu IS NULL THEN {sql_num(1.0 / _V)} ELSE ({sql_num(_A)} + coalesce(pp.c, 0)) / pc.zu END"
SLOG = f"coalesce(pc.slog, {sql_num(-_V * math.log(_V))})"
S2 = f"coalesce(pc.s2, {sql_num(1.0 / _V)})"
SQL_GRADS = [
    "gq AS (SELECT lang, u, v, n / sum(n) OVER (PARTITION BY lang) AS q FROM lc WHERE split = 'train' AND v <> -1)",
    "ga AS (SELECT lang, u, sum(q) AS a FROM gq GROUP BY ALL)",
    "vc AS (SELECT lang, u, v, count(*) AS n FROM l_pairs WHERE split = 'valid' GROUP BY ALL)",
    "vq1 AS (SELECT lang, u, v, n / sum(n) OVER (PARTITION BY lang) AS q FROM vc WHERE v <> -1)",
    "tq AS (SELECT u, v, sum(q) / (SELECT count(DISTINCT lang) FROM vq1) AS q FROM vq1 GROUP BY u, v)",
    "ta AS (SELECT u, sum(q) AS a FROM tq GROUP BY u)",
]
SQL_IP = [
    f"t1 AS (SELECT ga.lang, ta.a * ga.a * {S2} AS x FROM ta JOIN ga USING (u) LEFT JOIN pc USING (u))",
    f"t2 AS (SELECT gq.lang, -ta.a * {PROB} * gq.q AS x FROM gq JOIN ta USING (u) LEFT JOIN pp USING (u, v) LEFT JOIN pc USING (u))",
    f"t3 AS (SELECT ga.lang, -ga.a * {PROB} * tq.q AS x FROM tq JOIN ga USING (u) LEFT JOIN pp USING (u, v) LEFT JOIN pc USING (u))",
    "t4 AS (SELECT gq.lang, tq.q * gq.q AS x FROM tq JOIN gq USING (u, v))",
    "ip AS (SELECT lang, sum(x) AS ip FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3 UNION ALL SELECT * FROM t4) GROUP BY lang)",
]
SQL_DZ = [
    "runs AS (SELECT 'val' AS run_id, CAST(0.0 AS DOUBLE) AS lam UNION ALL SELECT 'val_entropy', " + sql_num(LAMBDA) + ")",
    """sp AS (SELECT r.run_id, r.lam, i.lang AS source, i.ip, CAST(1.0 AS DOUBLE) AS z,
              exp(CAST(1.0 AS DOUBLE) - 1.0) / sum(exp(CAST(1.0 AS DOUBLE) - 1.0)) OVER (PARTITION BY r.run_id) AS p
       FROM runs r, ip i)""",
    f"sg AS (SELECT *, -{sql_num(MIX_LR)} * ip AS g, -(1.0 + ln(p + {sql_num(op.LOG_EPS)})) AS h FROM sp)",
    """dz AS (SELECT run_id, source, z, p, ip,
              p * (g - sum(g * p) OVER (PARTITION BY run_id)) + lam * p * (h - sum(h * p) OVER (PARTITION BY run_id)) AS dz
       FROM sg)""",
]


def sql_adam(beta1, beta2, eps, lr) -> str:
    return f"""adam AS (SELECT run_id, source,
       {sql_num(beta1)} * 0.0 + {sql_num(1 - beta1)} * dz AS m,
       {sql_num(beta2)} * 0.0 + {sql_num(1 - beta2)} * dz * dz AS v, z FROM dz),
zn AS (SELECT run_id, source, m, v,
       z - {sql_num(lr)} * (m / (1.0 - pow({sql_num(beta1)}, 1))) / (sqrt(v / (1.0 - pow({sql_num(beta2)}, 1))) + {sql_num(eps)}) AS z
       FROM adam)"""


def lang_sql(*tail: str) -> str:
    return with_sql(*SQL_LANG, *SQL_PROXY, *tail)


# ---- queries ----------------------------------------------------------------

@query("l1_pair_counts", f"""{lang_sql()}
SELECT split, lang, u, v, n FROM lc""")
def l1_pair_counts(spark, sf):
    return lang_counts(spark, sf, cut=False).select("split", "lang", "u", "v", "n")


@query("l2_fit_proxy", f"""{lang_sql()}
SELECT pp.u, pp.v, round(pp.c, 6) AS c, round(ln({PROB}), 9) AS log_prob
FROM pp LEFT JOIN pc USING (u)""")
def l2_fit_proxy(spark, sf):
    px = proxy(spark, sf)
    d = ls.with_prob(px.pairs.withColumnRenamed("c", "cc"), px)
    return d.select("u", "v", rnd("cc", 6).alias("c"), rnd(F.log("prob")).alias("log_prob"))


@query("l3_token_loss", f"""{lang_sql()}
SELECT lc.split, lc.lang, lc.u, lc.v, lc.n, round(-ln({PROB}), 9) AS loss
FROM lc LEFT JOIN pp USING (u, v) LEFT JOIN pc USING (u)""")
def l3_token_loss(spark, sf):
    c = lang_counts(spark, sf)
    t = ls.token_loss(c, proxy(spark, sf, c))
    return t.select("split", "lang", "u", "v", "n", rnd("loss").alias("loss"))


def _masked_loss(spark, sf, ignore):
    """Losses of the masked counts; the proxy is fitted on the same counts, unmasked."""
    c = lang_counts(spark, sf)
    return ls.token_loss(ls.mask_targets(c, ignore, lambda x: x == 0), proxy(spark, sf, c), ignore=ignore)


SQL_MASKED = [
    "mc AS (SELECT split, lang, u, CASE WHEN v = 0 THEN {ig} ELSE v END AS v, count(*) AS n FROM l_pairs GROUP BY ALL)",
    f"""ml AS (SELECT mc.*, CASE WHEN mc.v = {{ig}} THEN 0 ELSE 1 END AS keep,
        CASE WHEN mc.v = {{ig}} THEN 0.0 ELSE -ln({PROB}) END AS loss
        FROM mc LEFT JOIN pp USING (u, v) LEFT JOIN pc USING (u))""",
]


def masked_sql(ig: int) -> list[str]:
    return [s.replace("{ig}", str(ig)) for s in SQL_MASKED]


@query("l4_cross_entropy", f"""{lang_sql(*masked_sql(-1))}
SELECT split, lang, round(sum(n * loss) / sum(n * keep), 9) AS loss FROM ml GROUP BY split, lang""")
def l4_cross_entropy(spark, sf):
    t = _masked_loss(spark, sf, ls.IGNORE_PLAIN)
    return ls.cross_entropy(t, ["split", "lang"]).select("split", "lang", rnd("loss").alias("loss"))


@query("l5_chunked_ce", f"""{lang_sql(*masked_sql(-1))}
SELECT split, lang, round(sum(n * loss) / sum(n), 9) AS loss FROM ml GROUP BY split, lang""")
def l5_chunked_ce(spark, sf):
    t = _masked_loss(spark, sf, ls.IGNORE_PLAIN)
    return ls.cross_entropy(t, ["split", "lang"], chunked=True).select("split", "lang", rnd("loss").alias("loss"))


@query("l6_label_smoothing", f"""{lang_sql()}
SELECT split, lang, round(sum(n * ({sql_num(1 - SMOOTHING)} * -ln({PROB}) + {sql_num(SMOOTHING)} * (-{SLOG} / {_V}))) / sum(n), 9) AS loss
FROM lc LEFT JOIN pp USING (u, v) LEFT JOIN pc USING (u) GROUP BY split, lang""")
def l6_label_smoothing(spark, sf):
    c = lang_counts(spark, sf)
    t = ls.token_loss(c, proxy(spark, sf, c), smoothing=SMOOTHING)
    return ls.cross_entropy(t, ["split", "lang"]).select("split", "lang", rnd("loss").alias("loss"))


@query("l7_weighted_ce", f"""{lang_sql(*masked_sql(-100))},
dw AS (SELECT lang, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS w FROM documents GROUP BY lang)
SELECT split, round(sum(n * w * loss * keep) / sum(n * w * keep), 9) AS loss FROM ml JOIN dw USING (lang) GROUP BY split""")
def l7_weighted_ce(spark, sf):
    t = _masked_loss(spark, sf, ls.IGNORE_WEIGHTED)
    return ls.weighted_ce(t, _doc_weights(spark, sf), ["split"], source="lang").select("split", rnd("loss").alias("loss"))


def _doc_weights(spark, sf):
    docs = tables.table(spark, sf, "documents")
    dw = docs.groupBy("lang").agg(F.count(F.lit(1)).cast("double").alias("_n"))
    return dw.withColumn("w", F.col("_n") / F.sum("_n").over(Window.partitionBy())).drop("_n")  # K rows


@query("l8_reduction_none", f"""{lang_sql()}
SELECT p.split, p.lang, p.block_no, CAST(p.pos AS INTEGER) AS pos, p.u, CASE WHEN p.v = 0 THEN -1 ELSE p.v END AS v,
       round(CASE WHEN p.v = 0 THEN 0.0 ELSE -ln({PROB}) END, 9) AS loss
FROM l_pairs p LEFT JOIN pp USING (u, v) LEFT JOIN pc USING (u)""")
def l8_reduction_none(spark, sf):
    packed = cut_lineage(packed_blocks(spark, sf, keys=LKEYS).select(*LKEYS, "block_no", "tokens"))  # read twice
    b = next_token(packed)
    px = proxy(spark, sf, lang_counts(spark, sf, b)).for_positions()
    pos = ls.positions(ls.mask_targets(b, ls.IGNORE_PLAIN, lambda x: x == 0), ["split", "lang", "block_no"])
    t = ls.cross_entropy(ls.token_loss(pos, px), reduction="none")
    return t.select("split", "lang", "block_no", "pos", "u", "v", rnd("loss").alias("loss"))


@query("l9_source_gradient", f"""{lang_sql(*SQL_GRADS)}
SELECT gq.lang, gq.u, gq.v, round((ga.a * {PROB} - gq.q) * 1e6, 6) AS g_e6
FROM gq JOIN ga USING (lang, u) LEFT JOIN pp USING (u, v) LEFT JOIN pc USING (u)""")
def l9_source_gradient(spark, sf):
    c = lang_counts(spark, sf)
    v = gr.values(train_grad(c), proxy(spark, sf, c))
    return v.select("lang", "u", "v", rnd("g", 6, 1e6).alias("g_e6"))


@query("l10_val_gradient", f"""{lang_sql(*SQL_GRADS)}
SELECT tq.u, tq.v, round((ta.a * {PROB} - tq.q) * 1e6, 6) AS g_e6
FROM tq JOIN ta USING (u) LEFT JOIN pp USING (u, v) LEFT JOIN pc USING (u)""")
def l10_val_gradient(spark, sf):
    c = lang_counts(spark, sf)
    v = gr.values(target_grad(c), proxy(spark, sf, c))
    return v.select("u", "v", rnd("g", 6, 1e6).alias("g_e6"))


@query("l10_val_gradient_first_batch", f"""{lang_sql(*[x.replace("split = 'valid' GROUP", f"split = 'valid' AND block_no < {VAL_BATCH} GROUP") for x in SQL_GRADS])}
SELECT tq.u, tq.v, round((ta.a * {PROB} - tq.q) * 1e6, 6) AS g_e6
FROM tq JOIN ta USING (u) LEFT JOIN pp USING (u, v) LEFT JOIN pc USING (u)""")
def l10_val_gradient_first_batch(spark, sf):
    # the blocks of the first batch are counted one by one, all others of a key together
    b = lang_blocks(spark, sf).withColumn("block_no", F.least("block_no", F.lit(VAL_BATCH).cast("bigint")))
    c = cut_lineage(ls.pair_counts(b, [*LKEYS, "block_no"]))
    whole = c.groupBy(*LKEYS, "u", "v").agg(F.sum("n").alias("n"))
    v = gr.values(target_grad(c, batches=1), proxy(spark, sf, whole))
    return v.select("u", "v", rnd("g", 6, 1e6).alias("g_e6"))


@query("l12_inner_products", f"""{lang_sql(*SQL_GRADS, *SQL_IP)}
SELECT lang, round(ip * 1e6, 6) AS ip_e6 FROM ip""")
def l12_inner_products(spark, sf):
    ip, _, _ = inner(spark, sf)
    return ip.select("lang", rnd("ip", 6, 1e6).alias("ip_e6"))


@query("l13_cosine", f"""{lang_sql(*SQL_GRADS, *SQL_IP)},
na AS (SELECT sqrt(greatest(sum(x), 0)) AS nt FROM (
   SELECT ta.a * ta.a * {S2} AS x FROM ta LEFT JOIN pc USING (u)
   UNION ALL SELECT -2.0 * ta.a * {PROB} * tq.q FROM tq JOIN ta USING (u) LEFT JOIN pp USING (u, v) LEFT JOIN pc USING (u)
   UNION ALL SELECT tq.q * tq.q FROM tq)),
nb AS (SELECT lang, sqrt(greatest(sum(x), 0)) AS ns FROM (
   SELECT ga.lang, ga.a * ga.a * {S2} AS x FROM ga LEFT JOIN pc USING (u)
   UNION ALL SELECT gq.lang, -2.0 * ga.a * {PROB} * gq.q FROM gq JOIN ga USING (lang, u) LEFT JOIN pp USING (u, v) LEFT JOIN pc USING (u)
   UNION ALL SELECT lang, gq.q * gq.q FROM gq) GROUP BY lang)
SELECT lang, round(ip / (nt * ns), 9) AS cosine FROM ip JOIN nb USING (lang), na""")
def l13_cosine(spark, sf):
    c = lang_counts(spark, sf)
    px = proxy(spark, sf, c)
    al = gr.alignment(target_grad(c), train_grad(c), px, metric="cosine")
    return al.select("lang", rnd("cosine").alias("cosine"))


@query("l14_mixture_gradient", f"""{lang_sql(*SQL_GRADS, *SQL_IP, *SQL_DZ)}
SELECT run_id, source, round(dz * 1e9, 6) AS dz_e9 FROM dz""")
def l14_mixture_gradient(spark, sf):
    return dz_table(spark, sf).select("run_id", "source", rnd("dz", 6, 1e9).alias("dz_e9"))


@query("l15_adam_step", f"""{lang_sql(*SQL_GRADS, *SQL_IP, *SQL_DZ, sql_adam(0.9, 0.95, 1e-8, MIX_LR))}
SELECT run_id, source, round(z, 9) AS z, round(m * 1e9, 6) AS m_e9, round(v * 1e18, 6) AS v_e18 FROM zn""")
def l15_adam_step(spark, sf):
    d = dz_table(spark, sf)
    st = d.select("run_id", "step", "source", "z", "m", "v", "t")
    out = op.adam_step(st, d.select("run_id", "source", "dz"), MIX_LR, **op.VALIDATION_ADAMW)
    return out.select("run_id", "source", rnd("z").alias("z"), rnd("m", 6, 1e9).alias("m_e9"), rnd("v", 6, 1e18).alias("v_e18"))


# Presets of the mixture optimiser, with and without weight decay.
PRESETS = {"val": op.VALIDATION_ADAMW, "qa": op.QA_ADAM, "val_decay": dict(op.VALIDATION_ADAMW, weight_decay=0.1),
           "qa_decay": dict(op.QA_ADAM, weight_decay=0.1)}
ADAM_STEPS = 3


def sql_adam_steps() -> str:
    """Several steps along one gradient for every preset."""
    out, parts = [], []
    for name, o in PRESETS.items():
        b1, b2, eps, wd = (sql_num(o[k]) for k in ("beta1", "beta2", "eps", "weight_decay"))
        out.append(f"{name}0 AS (SELECT run_id, source, dz, z, CAST(0 AS DOUBLE) AS m, CAST(0 AS DOUBLE) AS v FROM dz)")
        for k in range(1, ADAM_STEPS + 1):
            g, z = ("dz", f"z * (1.0 - {sql_num(MIX_LR)} * {wd})") if o["decoupled"] else (f"(dz + {wd} * z)", "z")
            out.append(f"""{name}{k} AS (SELECT run_id, source, dz, m, v, zd - {sql_num(MIX_LR)} * (m / (1.0 - pow({b1}, {k}))) / (sqrt(v / (1.0 - pow({b2}, {k}))) + {eps}) AS z
  FROM (SELECT run_id, source, dz, {z} AS zd, {b1} * m + {sql_num(1 - o["beta1"])} * {g} AS m, {b2} * v + {sql_num(1 - o["beta2"])} * {g} * {g} AS v FROM {name}{k - 1}))""")
        parts.append(f"SELECT '{name}' AS preset, run_id, source, round(z, 9) AS z, round(m * 1e9, 3) AS m_e9 FROM {name}{ADAM_STEPS}")
    return lang_sql(*SQL_GRADS, *SQL_IP, *SQL_DZ, *out) + "\n" + " UNION ALL ".join(parts)


@query("l15_adam_steps", sql_adam_steps())
def l15_adam_steps(spark, sf):
    d = cut_lineage(dz_table(spark, sf).select("run_id", "step", "source", "z", "m", "v", "t", "dz"))  # K rows a run
    out = None
    for name, preset in PRESETS.items():
        st = d.select("run_id", "step", "source", "z", "m", "v", "t")
        for _ in range(ADAM_STEPS):
            st = op.adam_step(st, d.select("run_id", "source", "dz"), MIX_LR, **preset)
        st = st.select(F.lit(name).alias("preset"), "run_id", "source", rnd("z").alias("z"), rnd("m", 3, 1e9).alias("m_e9"))
        out = st if out is None else out.unionByName(st)
    return out


@query("l7_weighted_ce_none", f"""{lang_sql(*masked_sql(-100))},
dw AS (SELECT lang, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS w FROM documents GROUP BY lang)
SELECT split, lang, u, v, n, round(w * loss * keep, 9) AS loss FROM ml JOIN dw USING (lang)""")
def l7_weighted_ce_none(spark, sf):
    t = _masked_loss(spark, sf, ls.IGNORE_WEIGHTED)
    return ls.weighted_ce(t, _doc_weights(spark, sf), ["split"], source="lang", reduction="none").select(
        "split", "lang", "u", "v", "n", rnd("loss").alias("loss"))


@query("l18_clip", f"""{lang_sql(*SQL_GRADS)},
nb AS (SELECT lang, sqrt(greatest(sum(x), 0)) AS ns FROM (
   SELECT ga.lang, ga.a * ga.a * {S2} AS x FROM ga LEFT JOIN pc USING (u)
   UNION ALL SELECT gq.lang, -2.0 * ga.a * {PROB} * gq.q FROM gq JOIN ga USING (lang, u) LEFT JOIN pp USING (u, v) LEFT JOIN pc USING (u)
   UNION ALL SELECT lang, gq.q * gq.q FROM gq) GROUP BY lang)
SELECT gq.lang, gq.u, gq.v, round(ns, 9) AS grad_norm, round(least(1.0, {sql_num(CLIP_NORM)} / (ns + {sql_num(op.CLIP_EPS)})), 9) AS clip_coef,
  round((ga.a * {PROB} - gq.q) * least(1.0, {sql_num(CLIP_NORM)} / (ns + {sql_num(op.CLIP_EPS)})) * 1e6, 6) AS clipped_e6
FROM gq JOIN nb USING (lang) JOIN ga USING (lang, u) LEFT JOIN pp USING (u, v) LEFT JOIN pc USING (u)""")
def l18_clip(spark, sf):
    c = lang_counts(spark, sf)
    g, px = train_grad(c), proxy(spark, sf, c)
    d = op.clip(gr.values(g, px), gr.norms(g, px), g.keys, max_norm=CLIP_NORM)
    return d.select("lang", "u", "v", rnd("norm").alias("grad_norm"), rnd("clip_coef").alias("clip_coef"),
                    rnd("clipped", 6, 1e6).alias("clipped_e6"))


@query("l20_rank_sources", f"""{lang_sql(*SQL_GRADS, *SQL_IP, *SQL_DZ, sql_adam(0.9, 0.95, 1e-8, MIX_LR))}
SELECT run_id, source, CAST(row_number() OVER (PARTITION BY run_id ORDER BY z DESC, source) AS INTEGER) AS rank FROM zn""")
def l20_rank_sources(spark, sf):
    d = dz_table(spark, sf)
    st = d.select("run_id", "step", "source", "z", "m", "v", "t")
    out = op.adam_step(st, d.select("run_id", "source", "dz"), MIX_LR, **op.VALIDATION_ADAMW)
    return op.rank_sources(out).select("run_id", "source", "rank")


@query("l22_init_state", f"""
SELECT source, round(1e-7 * sqrt(-2.0 * ln((CAST(('0x' || substr(h, 1, 8))::BIGINT AS DOUBLE) + 0.5) / CAST(4294967296 AS DOUBLE)))
             * cos({sql_num(2.0 * 3.141592653589793)} * CAST(('0x' || substr(h, 9, 8))::BIGINT AS DOUBLE) / CAST(4294967296 AS DOUBLE)) * 1e7, 9) AS z_e7
FROM (SELECT lang AS source, md5('{SEED}:' || lang) AS h FROM (SELECT DISTINCT lang FROM documents))""")
def l22_init_state(spark, sf):
    st = init_lang_state(spark, sf, "noise", "qa")
    return st.select("source", rnd("z", 9, 1e7).alias("z_e7"))


# Validation sets as mixtures of languages: (set, language, weight).  A set with a language of too few files is dropped whole.
VALID_SETS = [("broad", "en", 3.0), ("broad", "fr", 1.0), ("small", "fr", 1.0), ("small", "es", 1.0), ("english", "en", 1.0)]
VALID_MIN_FILES = 5
SQL_SETS = [
    "vs AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{x}', {sql_num(w)})" for s, x, w in VALID_SETS) + ") t(set_id, lang, weight))",
    "vf AS (SELECT lang, count(DISTINCT chunk_id) AS n_files FROM l_blocks WHERE split = 'valid' GROUP BY lang)",
    f"""vk AS (SELECT set_id, lang, weight / sum(weight) OVER (PARTITION BY set_id) AS weight FROM vs
  WHERE set_id NOT IN (SELECT set_id FROM vs LEFT JOIN vf USING (lang) WHERE coalesce(n_files, 0) < {VALID_MIN_FILES}))""",
    "vg AS (SELECT lang, u, v, count(*) AS n FROM l_pairs WHERE split = 'valid' GROUP BY ALL)",
    "vq2 AS (SELECT lang, u, v, n / sum(n) OVER (PARTITION BY lang) AS q FROM vg WHERE v <> -1)",
    "tq AS (SELECT u, v, sum(q * weight) / (SELECT count(DISTINCT set_id) FROM vk) AS q FROM vq2 JOIN vk USING (lang) GROUP BY u, v)",
    "ta AS (SELECT u, sum(q) AS a FROM tq GROUP BY u)",
]


def valid_set_tables(spark, blocks):
    """The configured sets and which of them stay, from the files of the validation split."""
    sets = spark.createDataFrame(VALID_SETS, "set_id string, lang string, weight double")
    files = blocks.filter(F.col("split") == "valid").groupBy("lang").agg(F.countDistinct("chunk_id").alias("n_files"))
    return sets, gr.valid_sets(sets, files, VALID_MIN_FILES, source="lang")


@query("m2_valid_sets", f"""{with_sql(*SQL_LANG[:-1], *SQL_SETS[:3])}
SELECT vs.set_id, vs.lang, round(vk.weight, 9) AS weight, vk.set_id IS NOT NULL AS kept FROM vs LEFT JOIN vk USING (set_id, lang)""")
def m2_valid_sets(spark, sf):
    sets, kept = valid_set_tables(spark, packed_blocks(spark, sf, keys=LKEYS))
    j = sets.select("set_id", "lang").join(kept.select("set_id", "lang", "weight"), ["set_id", "lang"], "left")
    return j.select("set_id", "lang", rnd("weight").alias("weight"), F.col("weight").isNotNull().alias("kept"))


@query("l10_weighted_sets", f"""{lang_sql(*SQL_SETS)}
SELECT tq.u, tq.v, round((ta.a * {PROB} - tq.q) * 1e6, 6) AS g_e6
FROM tq JOIN ta USING (u) LEFT JOIN pp USING (u, v) LEFT JOIN pc USING (u)""")
def l10_weighted_sets(spark, sf):
    b = lang_blocks(spark, sf)
    c = lang_counts(spark, sf, b)
    _, kept = valid_set_tables(spark, b)
    kept = cut_lineage(kept)  # K rows
    g = gr.weighted_set_gradient(c.filter(F.col("split") == "valid").drop("split"), kept, source="lang")
    return gr.values(g, proxy(spark, sf, c)).select("u", "v", rnd("g", 6, 1e6).alias("g_e6"))
