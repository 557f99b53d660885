"""Mixtures: weights, surviving sources, weighted draws, draw -> block.

A mixture is a small table ``(run_id?, group_id, source, weight)``; it is the
only side ever broadcast.  Draws are counter-based (md5 of seed and draw
index), so the same draws come out on any engine and any partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blendwise.functions.hashing import md5_unit
from blendwise.functions.prefix import prefix_rank
from blendwise.operators.packing import cyclic, read_range  # noqa: F401  (read_range re-exported)

# Mixtures up to this many rows go out as broadcast; a mixture is one row per source.
MIXTURE_BROADCAST_ROWS = 100000
# Buckets of the unit interval used to turn the range join into an equi join.
DRAW_BUCKETS = 4096
# Digits kept of cumulative weights, so that both engines cut at the same points.
CUM_DIGITS = 12


def _run_keys(df: DataFrame, run_keys: Sequence[str] | None) -> list[str]:
    if run_keys is not None:
        return list(run_keys)
    return [c for c in ("run_id",) if c in df.columns]


def normalize(mixture: DataFrame, weight: str = "weight", out: str = "p", run_keys: Sequence[str] | None = None) -> DataFrame:
    """M1: ``p = w / sum(w)`` per run."""
    rk = _run_keys(mixture, run_keys)
    return mixture.withColumn(out, F.col(weight) / F.sum(weight).over(Window.partitionBy(*rk)))


def valid_sources(mixture: DataFrame, files: DataFrame, min_files: int, source: str = "source") -> DataFrame:
    """M2: drop sources with fewer than ``min_files`` files, then renumber
    ``group_id`` as the position among the survivors (original order kept)."""
    counts = files.groupBy(source).agg(F.count(F.lit(1)).alias("n_files"))
    kept = mixture.join(counts, source, "inner").filter(F.col("n_files") >= min_files)
    rk = _run_keys(mixture, None)
    w = Window.partitionBy(*rk).orderBy("group_id")
    return kept.withColumn("group_id", (F.row_number().over(w) - 1).cast("int"))


def intervals(mixture: DataFrame, weight: str = "weight", run_keys: Sequence[str] | None = None) -> DataFrame:
    """Cumulative-weight interval ``[lo, hi)`` of each source, in ``group_id`` order."""
    rk = _run_keys(mixture, run_keys)
    m = normalize(mixture, weight, "p", rk)
    w = Window.partitionBy(*rk).orderBy("group_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = Window.partitionBy(*rk)
    m = m.withColumn("_c", F.sum("p").over(w))
    m = m.withColumn("hi", F.round("_c", CUM_DIGITS)).withColumn("lo", F.round(F.col("_c") - F.col("p"), CUM_DIGITS))
    m = m.drop("_c")
    is_last = F.col("group_id") == F.max("group_id").over(last)
    return m.withColumn("hi", F.when(is_last, F.lit(1.0)).otherwise(F.col("hi")))


def draw_sources(
    spark: SparkSession, n_draws: int, mixture: DataFrame, seed: int, weight: str = "weight",
    mixture_rows: int | None = None, num_partitions: int | None = None,
) -> DataFrame:
    """M3: ``n_draws`` weighted choices with replacement: (draw_idx, group_id, source, u);
    with several runs in the mixture, ``n_draws`` for each run, with its ``run_id``.

    ``u = md5(seed:draw_idx)`` in [0, 1) falls into one source interval; the
    interval test is an equi join on a bucket of the unit interval followed by
    a filter, so the cost is O(draws) for any number of sources.
    """
    rk = _run_keys(mixture, None)
    iv = intervals(mixture, weight).filter(F.col("hi") > F.col("lo"))
    G = DRAW_BUCKETS
    iv = iv.select(
        *rk, "group_id", "source", "lo", "hi",
        F.explode(F.sequence(F.floor(F.col("lo") * G), F.ceil(F.col("hi") * G) - 1)).alias("_b"),
    )
    if mixture_rows is not None and mixture_rows <= MIXTURE_BROADCAST_ROWS:
        iv = F.broadcast(iv)
    draws = spark.range(0, n_draws, numPartitions=num_partitions).withColumnRenamed("id", "draw_idx")
    draws = draws.withColumn("u", md5_unit(F.lit(seed), F.col("draw_idx"))).withColumn("_b", F.floor(F.col("u") * G))
    j = draws.join(iv, "_b", "inner").filter((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    return j.select(*rk, "draw_idx", "group_id", "source", "u")


def mix(positioned_blocks: DataFrame, draws: DataFrame, keys: Sequence[str] = ("source",), sizes: DataFrame | None = None,
        draw_buckets: int | None = None) -> DataFrame:
    """M4: the k-th draw of a source reads that source's block ``k mod n`` (epoch ``k div n``).

    k is the rank of the draw among the draws of its source: a two-level
    prefix count over draw-index buckets, never a window over a whole source.  ``sizes`` has one row per key;
    ``draw_buckets`` bounds the (key, bucket) pairs of the draws.  ``positioned_blocks`` may be a layout without ids.
    """
    return cyclic(positioned_blocks, read_indices(draws, keys, draw_buckets), keys, sizes=sizes)


def read_indices(draws: DataFrame, keys: Sequence[str] = ("source",), draw_buckets: int | None = None) -> DataFrame:
    """``read_index``: how many draws of the same source (and run) come before each draw."""
    d = prefix_rank(draws, [*_run_keys(draws, None), *keys], "draw_idx", "_k", base_rows=draw_buckets)
    return d.withColumn("read_index", F.col("_k") - 1).drop("_k")


def sharded_mix(layout: DataFrame, draws: DataFrame, ranks: int, sizes: DataFrame, keys: Sequence[str] = ("source",),
                draw_buckets: int | None = None) -> DataFrame:
    """P7 x M4: every rank's stream ``(rank, draw_idx, keys..., read_index, epoch, chunk_id, block_in_chunk)``.

    ``layout`` gives each rank its own files in its own order.  All ranks draw the same sources (one seed for the mixture) and
    read their own blocks, so ranks never share a block.  ``sizes(keys..., rank, n_blocks)`` has one row per key and rank."""
    d = read_indices(draws, keys, draw_buckets)
    d = d.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))))
    return cyclic(layout, d, [*keys, "rank"], sizes=sizes)


def batches(mixed: DataFrame, micro_batch: int, accumulation: int, draw: str = "draw_idx") -> DataFrame:
    """M5: micro-batch id and optimiser-step id of each draw."""
    return mixed.withColumn("micro_batch", F.floor(F.col(draw) / micro_batch).cast("bigint")).withColumn(
        "opt_step", F.floor(F.col(draw) / (micro_batch * accumulation)).cast("bigint")
    )


def batch_groups(batched: DataFrame, batch: str = "micro_batch", group: str = "group_id") -> DataFrame:
    """M6: sources present in each batch with their row counts."""
    return batched.groupBy(batch, group).agg(F.count(F.lit(1)).alias("n_rows"))


def mixture_size(blocks: DataFrame, source: str = "source", tokens: str = "tokens") -> DataFrame:
    """M7: blocks and ids per source and in total (rollup; total row has source null)."""
    return blocks.rollup(source).agg(
        F.count(F.lit(1)).alias("n_blocks"), F.sum(F.size(tokens)).cast("bigint").alias("n_tokens")
    )


def proportional(mixture: DataFrame, stats: DataFrame, size: str = "n_tokens", reweight: str = "weight", source: str = "source") -> DataFrame:
    """M8: weight = size of the source x reweighting factor, then normalised."""
    j = mixture.join(stats.select(source, size), source, "inner")
    j = j.withColumn("weight", F.col(size).cast("double") * F.col(reweight))
    return normalize(j.drop(size))


def mixture_report(mixed: DataFrame, mixture: DataFrame, source: str = "source") -> DataFrame:
    """M9: expected share, drawn share, reads and epochs started per source."""
    rk = _run_keys(mixture, None)
    exp = normalize(mixture).select(*rk, source, F.col("p").alias("expected_share"))
    got = mixed.groupBy(*rk, source).agg(
        F.count(F.lit(1)).alias("reads"), (F.max("epoch") + 1).alias("epochs"),
    )
    rep = exp.join(got, [*rk, source], "left")
    w = Window.partitionBy(*rk)  # over the K-row report of a run only
    rep = rep.withColumn("reads", F.coalesce("reads", F.lit(0)).cast("bigint")).withColumn(
        "epochs", F.coalesce("epochs", F.lit(0)).cast("bigint")
    )
    return rep.withColumn("drawn_share", F.col("reads") / F.sum("reads").over(w))


def softmax(state: DataFrame, z: str = "z", out: str = "p", run_keys: Sequence[str] = ("run_id", "step")) -> DataFrame:
    """Max-shifted softmax of logits per (run, step)."""
    w = Window.partitionBy(*run_keys)
    e = F.exp(F.col(z) - F.max(z).over(w))
    return state.withColumn("_e", e).withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def sample_weights(mixed: DataFrame, probs: DataFrame, source: str = "source", p: str = "p", probs_rows: int | None = None) -> DataFrame:
    """Each row gets its source's current probability as loss weight."""
    pr = probs.select(source, F.col(p).alias("sample_weight"))
    if probs_rows is not None and probs_rows <= MIXTURE_BROADCAST_ROWS:
        pr = F.broadcast(pr)
    return mixed.join(pr, source, "left").withColumn("sample_weight", F.coalesce("sample_weight", F.lit(0.0)))


def apply_mixture(positioned_blocks: DataFrame, probs: DataFrame, budget_tokens: F.Column | int, block_tokens: int,
                  source: str = "source", p: str = "p", repeat: bool = True, sizes: DataFrame | None = None) -> DataFrame:
    """A corpus under learned weights: ``ceil(p * budget / block)`` blocks per
    source, read in stream order.  Past the end of a source they repeat (new epoch), or
    (``repeat=False``) the source gives each of its blocks once at most."""
    budget = budget_tokens if isinstance(budget_tokens, Column) else F.lit(budget_tokens)
    need = probs.withColumn("_need", F.ceil(F.col(p) * budget / F.lit(block_tokens)).cast("bigint")).select(source, "_need")
    if not repeat:
        out = positioned_blocks.join(need, source).filter(F.col("position") < F.col("_need"))
        return out.withColumn("read_index", F.col("position")).withColumn("epoch", F.lit(0).cast("bigint")).drop("_need", "n_blocks")
    reads = read_range(need.filter(F.col("_need") > 0), "_need", [source])
    return cyclic(positioned_blocks, reads, [source], sizes=sizes)


