"""The mixture search loop.

Every ``interval`` training iterations (iteration 0 excluded) the current
micro-batch's per-source head gradients are compared with a target
gradient; the inner products move the mixture logits by one Adam step, and
the new logits weight the loss of the following iterations.  Sampling
weights stay as configured: learned weights change the loss weight only.

Spark plan:

1. blocks -> weighted draws -> draw-to-block -> pair counts per
   (interval, whether it is the interval's first iteration, source): one job for all iterations, written to the
   shared checkpoint folder;
2. per search step, a few small aggregates: the proxy is the previous one
   plus the iterations since the last step weighted by the current
   probabilities, the batch's source gradients, the inner products with the
   target, the softmax gradient and the Adam step on the K-row state;
   lineage is cut with reliable checkpoints at every step.

The driver holds configuration scalars only; state, proxy and history are
DataFrames.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blendwise.operators import gradients as gr
from blendwise.operators import loss as ls
from blendwise.operators import mixture as mx
from blendwise.operators import optim as op
from blendwise.operators.layout import attach_blocks
from blendwise.operators.packing import next_token
from blendwise.session import PeriodicCut, cut_lineage, reuse, scratch_path, small_broadcast
from blendwise.sources import history as hs


@dataclass
class SearchConfig:
    n_iters: int = 60
    interval: int = 20
    micro_batch: int = 16
    mix_lr: float = 0.01
    lam: float = 0.0
    alpha: float = 0.1
    vocab: int = 1024
    order: str = "unigram"
    seed: int = 3406
    init: str = "ones"
    optimizer: dict = field(default_factory=lambda: dict(op.VALIDATION_ADAMW))
    anneal_t_max: int | None = None       # cosine annealing of the mixture rate (QA target)
    learning_rate: float = 4e-4           # model rate: scales the inner products
    min_lr: float = 4e-4
    warmup_iters: int = 0
    decay_iters: int = 10**9
    run_id: str = "search"
    source: str = "source"
    checkpoint_every: int = 5             # reliable checkpoint of the iterated tables every n steps
    broadcast_rows: int = 1 << 18         # a target gradient of so many rows or fewer is broadcast, a larger one shuffled


def model_lr(it: int, cfg: SearchConfig) -> float:
    """L16 for one iteration (a configuration scalar)."""
    if it < cfg.warmup_iters:
        return cfg.learning_rate * it / cfg.warmup_iters
    if it > cfg.decay_iters:
        return cfg.min_lr
    ratio = (it - cfg.warmup_iters) / (cfg.decay_iters - cfg.warmup_iters)
    return cfg.min_lr + 0.5 * (1.0 + math.cos(math.pi * ratio)) * (cfg.learning_rate - cfg.min_lr)


def iteration_counts(spark: SparkSession, positioned_blocks: DataFrame, mixture: DataFrame, cfg: SearchConfig,
                     n_sources: int, cut: bool = True, chunk_rows: DataFrame | None = None, block_size: int = 0) -> DataFrame:
    """Pair counts ``(interval, at_step, source, u, v, n)`` of all micro-batches of the run: of the iteration that starts an
    interval (``at_step``, whose gradients the step compares) and of its other iterations together, which only the proxy needs.

    With ``chunk_rows`` the positioned blocks are a layout without ids, and draws find their ids by chunk."""
    src = cfg.source
    m = mixture.select(F.col(src).alias("source"), "group_id", "weight")
    draws = mx.draw_sources(spark, cfg.n_iters * cfg.micro_batch, m, cfg.seed, mixture_rows=n_sources)
    pb = positioned_blocks.withColumnRenamed(src, "source") if src != "source" else positioned_blocks
    mixed = mx.mix(pb, draws)
    if chunk_rows is not None:
        ch = chunk_rows.withColumnRenamed(src, "source") if src != "source" else chunk_rows
        mixed = attach_blocks(mixed, ch, block_size)
    it = F.floor(F.col("draw_idx") / cfg.micro_batch).cast("bigint")
    mixed = mixed.withColumn("interval", F.floor(it / cfg.interval).cast("bigint")).withColumn("at_step", it % cfg.interval == 0)
    counts = ls.pair_counts(next_token(mixed), ["interval", "at_step", "source"], order=cfg.order)
    return cut_lineage(counts) if cut else counts


@dataclass
class SearchRun:
    """What a search leaves: the history of the logits, the validation metrics of every step (if there is a validation
    set), and the folder of the newest full state."""

    history: DataFrame
    metrics: DataFrame | None
    state_path: str


def search(spark: SparkSession, positioned_blocks: DataFrame, mixture: DataFrame, target: gr.Grad,
           cfg: SearchConfig, resume_from: DataFrame | None = None, chunk_rows: DataFrame | None = None,
           block_size: int = 0) -> DataFrame:
    """History ``(run_id, step, source, z, m, v, t, p)`` of the mixture logits (see :func:`run_search`)."""
    return run_search(spark, positioned_blocks, mixture, target, cfg, resume_from, chunk_rows, block_size).history


def run_search(spark: SparkSession, positioned_blocks: DataFrame, mixture: DataFrame, target: gr.Grad,
               cfg: SearchConfig, resume_from: DataFrame | None = None, chunk_rows: DataFrame | None = None,
               block_size: int = 0, validation: DataFrame | None = None, root: str | None = None) -> SearchRun:
    """L19 with what the training loop does around it.

    ``mixture`` is ``(source, group_id, weight)`` (K rows, the configured
    sampling weights); ``target`` is a gradient (L10 or L11) without keys.

    Written tables in the shared checkpoint folder carry the loop: the pair
    counts of all intervals, partitioned by search interval (each step reads
    one partition), and one folder per step for the history, written as a whole and read
    back as the next step's input (a fresh, K-row lineage).  A step counts once its folder is committed; the full state is
    kept for the newest step only (E4).

    ``validation(set, u, v, n)`` are pair counts of validation sets: every step logs their loss and perplexity under the
    proxy of that step (E1).

    ``root`` names the run's folder.  A run whose driver died goes on from its committed steps when it is started again
    with the same folder; ``resume_from`` is an earlier history of the same run (same configuration but for ``n_iters``) instead.  Either
    way sources that the saved state does not know start from their initial state (S12), and the proxy is
    rebuilt from the written counts under the recorded probabilities.
    """
    src = cfg.source
    mix = reuse(mixture.select(F.col(src).alias("source"), "group_id", "weight"))  # K rows, read every step
    n_sources = mix.count()
    counts_path = scratch_path(spark, "iteration-counts")
    root = root or scratch_path(spark, "search")
    hist_path, state_path, metrics_path = (f"{root}/{x}" for x in ("history", "state", "metrics"))
    counts = iteration_counts(spark, positioned_blocks, mixture, cfg, n_sources, False, chunk_rows, block_size)
    # few files per interval, and a hot source spread over them
    salt = F.pmod(F.xxhash64("u", "v"), F.lit(8))
    counts.repartition(F.col("interval"), salt).write.partitionBy("interval").parquet(counts_path)
    counts = spark.read.parquet(counts_path)
    # the target gradient is fixed for the run: computed once, read every step
    target = gr.Grad(cut_lineage(target.q), cut_lineage(target.a), target.keys)
    small = target.q.count() <= cfg.broadcast_rows
    # the batch gradients do not depend on the state: all search steps in one job
    at_steps = counts.filter(F.col("at_step") & (F.col("interval") > 0))
    at_steps = at_steps.select((F.col("interval") * cfg.interval).alias("iter"), "source", "u", "v", "n")
    sg_all = gr.source_gradient(at_steps, ["iter", "source"])
    sg_all = gr.Grad(cut_lineage(sg_all.q), cut_lineage(sg_all.a), ["source"])
    state_cols = ["run_id", "step", "source", "z", "m", "v", "t"]

    hist_cols = ["run_id", "step", "source", "z", "p"]

    def record(state: DataFrame, step: int) -> DataFrame:
        """Commit a step: the full state first, then its line of the history, then older states go."""
        hs.commit_step(mx.softmax(state).select(*state_cols, "p"), state_path, step)
        back = hs.read_step(spark, state_path, step)
        hs.commit_step(back.select(*hist_cols, "m", "v", "t"), hist_path, step)
        hs.keep_newest(spark, state_path)
        return hs.read_step(spark, hist_path, step).select(*state_cols)  # what is computed again later still finds it

    def log_metrics(proxy: ls.Proxy, step: int) -> None:
        if validation is not None:
            losses = ls.cross_entropy(ls.token_loss(validation, proxy), ["set"])
            losses = losses.select(F.lit(cfg.run_id).alias("run_id"), "set", F.col("loss").alias("val_loss"), F.exp("loss").alias("val_ppl"))
            hs.commit_step(losses, metrics_path, step)

    fresh = op.init_state(mix.select("source"), cfg.init, cfg.seed, cfg.run_id)
    done, pairs = 0, None
    earlier = hs.committed_steps(spark, hist_path)
    if resume_from is None and not earlier:
        state = record(fresh, 0)
    else:
        if resume_from is not None:
            old = resume_from.withColumnRenamed(src, "source").filter(F.col("run_id") == cfg.run_id)
            old = reuse(old.select(*state_cols, "p"))  # K rows a step
            for s in sorted(r["step"] for r in old.select("step").distinct().collect()):
                hs.commit_step(old.filter(F.col("step") == s), hist_path, s)
            old.unpersist()
        old = hs.read_steps(spark, hist_path)
        done = hs.committed_steps(spark, hist_path)[-1]
        saved = hs.latest_state(old)
        state = record(hs.merge_state(fresh, saved).select(*state_cols[:1], F.lit(done).cast("bigint").alias("step"), *state_cols[2:]), done)
        # an interval's counts were weighted by the probabilities of the step it starts with
        weights = old.filter((F.col("step") < done) & (F.col("step") % cfg.interval == 0)).select(
            "source", F.col("p").alias("w"), (F.col("step") / cfg.interval).cast("bigint").alias("interval"))
        if done:
            past = counts.filter((F.col("interval") < done // cfg.interval) & (F.col("v") != F.lit(ls.IGNORE_PLAIN)))
            pairs = past.join(small_broadcast(weights, mx.MIXTURE_BROADCAST_ROWS), ["interval", "source"]).groupBy("u", "v").agg(
                F.sum(F.col("w") * F.col("n")).alias("c"))
    cut_pairs = PeriodicCut(cfg.checkpoint_every)
    _steps(spark, cfg, counts, target, mix, state, record, log_metrics, cut_pairs, sg_all, small, done, pairs)
    # the result reads the written history only: release what the loop kept
    if cut_pairs.prev is not None:
        cut_pairs.prev.unpersist()
    mix.unpersist()
    out = hs.read_steps(spark, hist_path).select(*state_cols, "p")
    out = out.withColumnRenamed("source", src) if src != "source" else out
    metrics = hs.read_steps(spark, metrics_path) if validation is not None and hs.committed_steps(spark, metrics_path) else None
    return SearchRun(out, metrics, state_path)


def _steps(spark, cfg, counts, target, mix, state, record, log_metrics, cut_pairs, sg_all, small, done, pairs):
    k = done // cfg.interval
    for s in range(done + cfg.interval, cfg.n_iters, cfg.interval):
        interval = s // cfg.interval
        probs = F.broadcast(mx.softmax(state).select("source", F.col("p").alias("w")))  # K rows
        new = counts.filter((F.col("interval") == interval - 1) & (F.col("v") != F.lit(ls.IGNORE_PLAIN)))
        new = new.join(probs, "source").groupBy("u", "v").agg(F.sum(F.col("w") * F.col("n")).alias("c"))
        pairs = new if pairs is None else pairs.unionByName(new).groupBy("u", "v").agg(F.sum("c").alias("c"))
        pairs = cut_pairs(pairs)
        proxy = ls.proxy_from_pairs(pairs, cfg.alpha, cfg.vocab)
        log_metrics(proxy, s)
        sg = gr.Grad(sg_all.q.filter(F.col("iter") == s).drop("iter"), sg_all.a.filter(F.col("iter") == s).drop("iter"),
                     ["source"])
        ip = gr.ip_for_sources(gr.inner_products(target, sg, proxy, small_a=small), mix, [])
        ip = ip.select(F.lit(cfg.run_id).alias("run_id"), "source", "ip")
        ip = ip.withColumn("step", F.lit(s - cfg.interval).cast("bigint"))
        st = state
        dz = op.mixture_gradient(ip, st, model_lr(s, cfg), cfg.lam)
        k += 1
        rate = op.mixture_lr(F.lit(k), cfg.mix_lr, cfg.anneal_t_max) if cfg.anneal_t_max else cfg.mix_lr
        new_state = op.adam_step(st, dz.select("run_id", "source", "dz"), rate, next_step=F.lit(s), **cfg.optimizer)
        state = record(new_state, s)
    return state, pairs, k
