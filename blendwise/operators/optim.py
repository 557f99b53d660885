"""Mixture-logit algebra: gradient through the softmax, Adam, schedules, ranks, init
(L14-L18, L20, L22).

The state is a long table ``(run_id, step, source, z, m, v, t)``: K rows per
run and step, so sweeps over many runs (rates, targets, lambda) are one
projection or window over the whole table, never a driver loop over sources.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blendwise.functions.hashing import md5_normal

LOG_EPS = 1e-8      # inside log(p + eps) of the entropy term
CLIP_EPS = 1e-6     # in max_norm / (norm + eps)

# Optimiser presets of the two search targets.
VALIDATION_ADAMW = dict(beta1=0.9, beta2=0.95, eps=1e-8, weight_decay=0.0, decoupled=True)
QA_ADAM = dict(beta1=0.5, beta2=0.999, eps=1e-8, weight_decay=0.0, decoupled=False)


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def init_state(mixture: DataFrame, mode: str = "ones", seed: int = 3406, run_id: str | Column = "run0",
               source: str = "source") -> DataFrame:
    """Logits at step 0: all ones, or ``1e-7 * N(0, 1)`` seeded per source."""
    if mode == "ones":
        z = F.lit(1.0)
    elif mode == "noise":
        z = F.lit(1e-7) * md5_normal(F.lit(seed), F.col(source))
    else:
        raise ValueError(f"mode must be 'ones' or 'noise', got {mode!r}")
    rid = run_id if isinstance(run_id, Column) else F.lit(run_id)
    base = mixture if "run_id" in mixture.columns else mixture.withColumn("run_id", rid)
    return base.select(
        "run_id", F.lit(0).cast("bigint").alias("step"), source, z.alias("z"),
        F.lit(0.0).alias("m"), F.lit(0.0).alias("v"), F.lit(0).cast("bigint").alias("t"),
    )


def mixture_gradient(ip: DataFrame, state: DataFrame, lr, lam=0.0, run_keys: Sequence[str] = ("run_id", "step"),
                     source: str = "source") -> DataFrame:
    """``dz_j = p_j (g_j - sum_i g_i p_i) + lam p_j (h_j - sum_i h_i p_i)``,
    ``g = -lr * ip``, ``h = -(1 + log(p + 1e-8))``, p = softmax(z).

    ``lr`` and ``lam`` are numbers or columns of ``ip`` (one per run and step).
    A source missing from ``ip`` has inner product 0.
    """
    rk = list(run_keys)
    w = Window.partitionBy(*rk)
    s = state.withColumn("_e", F.exp(F.col("z") - F.max("z").over(w)))
    s = s.withColumn("p", F.col("_e") / F.sum("_e").over(w)).drop("_e")
    j = s.join(ip, [*rk, source], "left").withColumn("ip", F.coalesce("ip", F.lit(0.0)))
    j = j.withColumn("g", -_lit(lr) * F.col("ip"))
    j = j.withColumn("h", -(F.lit(1.0) + F.log(F.col("p") + F.lit(LOG_EPS))))
    dz = F.col("p") * (F.col("g") - F.sum(F.col("g") * F.col("p")).over(w)) + _lit(lam) * F.col("p") * (
        F.col("h") - F.sum(F.col("h") * F.col("p")).over(w)
    )
    return j.withColumn("dz", dz)


def adam_step(state: DataFrame, grad: DataFrame, lr, beta1: float, beta2: float, eps: float = 1e-8,
              weight_decay: float = 0.0, decoupled: bool = True, run_keys: Sequence[str] = ("run_id",),
              source: str = "source", next_step: Column | None = None) -> DataFrame:
    """One bias-corrected Adam step on the logits.

    ``decoupled=True`` is AdamW (decay applied to z directly), ``False`` is Adam
    with the decay added to the gradient (L2).  ``grad`` holds ``dz`` per
    (run, source); ``lr`` is a number or a column of ``grad``.
    """
    g0 = grad.select(*run_keys, source, "dz", *([lr] if isinstance(lr, str) else []))
    j = state.join(g0, [*run_keys, source], "left").withColumn("dz", F.coalesce("dz", F.lit(0.0)))
    lr_c = F.col(lr) if isinstance(lr, str) else _lit(lr)
    g = F.col("dz") if decoupled or weight_decay == 0 else F.col("dz") + F.lit(weight_decay) * F.col("z")
    t = F.col("t") + 1
    m = F.lit(beta1) * F.col("m") + F.lit(1 - beta1) * g
    v = F.lit(beta2) * F.col("v") + F.lit(1 - beta2) * g * g
    z0 = F.col("z") * (F.lit(1.0) - lr_c * F.lit(weight_decay)) if decoupled and weight_decay else F.col("z")
    mhat = F.col("_m") / (F.lit(1.0) - F.pow(F.lit(beta1), F.col("_t")))
    vhat = F.col("_v") / (F.lit(1.0) - F.pow(F.lit(beta2), F.col("_t")))
    j = j.withColumn("_t", t).withColumn("_m", m).withColumn("_v", v).withColumn("_z0", z0)
    z = F.col("_z0") - lr_c * mhat / (F.sqrt(vhat) + F.lit(eps))
    step = next_step if next_step is not None else F.col("step") + 1
    out = j.select(*run_keys, step.cast("bigint").alias("step"), source, z.alias("z"), F.col("_m").alias("m"),
                   F.col("_v").alias("v"), F.col("_t").cast("bigint").alias("t"))
    return out


def lr_at(it: Column, learning_rate: float, min_lr: float, warmup_iters: int, decay_iters: int) -> Column:
    """Linear warm-up, cosine decay to ``min_lr``, then ``min_lr``."""
    if decay_iters <= warmup_iters:
        raise ValueError("decay_iters must exceed warmup_iters")
    it = it.cast("double")
    ratio = (it - F.lit(warmup_iters)) / F.lit(decay_iters - warmup_iters)
    coeff = F.lit(0.5) * (F.lit(1.0) + F.cos(F.lit(math.pi) * ratio))
    return (
        F.when(it < F.lit(warmup_iters), F.lit(learning_rate) * it / F.lit(max(warmup_iters, 1)))
        .when(it > F.lit(decay_iters), F.lit(min_lr))
        .otherwise(F.lit(min_lr) + coeff * F.lit(learning_rate - min_lr))
    )


def mixture_lr(k: Column, lr0: float, t_max: int, eta_min: float = 0.0) -> Column:
    """Cosine annealing of the mixture rate after ``k`` scheduler advances."""
    return F.lit(eta_min) + F.lit(lr0 - eta_min) * (F.lit(1.0) + F.cos(F.lit(math.pi) * k.cast("double") / F.lit(t_max))) / F.lit(2.0)


def clip(entries: DataFrame, norms: DataFrame, keys: Sequence[str], value: str = "g", max_norm: float = 1.0) -> DataFrame:
    """``entries`` plus the clip factor ``min(1, c / (norm + 1e-6))`` of their group and the clipped values.

    ``norms(keys..., norm)`` is the norm of the whole gradient (``gradients.norms``): a head gradient is
    dense over the vocabulary, so the stored entries alone would give too small a norm."""
    n = norms.withColumn("clip_coef", F.least(F.lit(1.0), F.lit(max_norm) / (F.col("norm") + F.lit(CLIP_EPS))))
    return entries.join(n, list(keys)).withColumn("clipped", F.col(value) * F.col("clip_coef"))


def rank_sources(state: DataFrame, run_keys: Sequence[str] = ("run_id", "step"), z: str = "z", source: str = "source") -> DataFrame:
    """Sources ranked by logit, highest first (ties by name)."""
    w = Window.partitionBy(*run_keys).orderBy(F.desc(z), F.asc(source))
    return state.withColumn("rank", F.row_number().over(w).cast("int"))
