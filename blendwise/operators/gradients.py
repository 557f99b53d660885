"""Head gradients of the proxy and their inner products.

For a softmax head over a one-hot context u, the gradient of the mean
cross-entropy of a group of positions is

    G(u, v) = a(u) p(v|u) - q(u, v),   q = n(u, v) / N,   a(u) = sum_v q(u, v)

(a sparse part q and a per-context part a; the dense V x V matrix is never
built).  Averages of such gradients (validation sets, question/answer
batches) have the same form with averaged q.  With
``S2(u) = sum_v p(v|u)^2`` the inner product of two gradients is

    <A, B> = sum_u aA aB S2 - sum_uv aA p qB - sum_uv aB p qA + sum_uv qA qB,

four joins on u or (u, v) and one aggregate each.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blendwise.operators.loss import IGNORE_PLAIN, Proxy, with_prob
from blendwise.session import with_scalars


@dataclass
class Grad:
    """``q(keys..., u, v, q)`` and ``a(keys..., u, a)`` of a family of gradients."""

    q: DataFrame
    a: DataFrame
    keys: list[str]


def _a_from_q(q: DataFrame, keys: Sequence[str]) -> DataFrame:
    return q.groupBy(*keys, "u").agg(F.sum("q").alias("a"))


def source_gradient(counts: DataFrame, keys: Sequence[str], ignore: int | None = IGNORE_PLAIN) -> Grad:
    """Gradient of each group's mean loss over its kept positions."""
    keys = list(keys)
    c = counts if ignore is None else counts.filter(F.col("v") != F.lit(ignore))
    tot = c.groupBy(*keys).agg(F.sum("n").alias("_N"))
    q = c.join(tot, keys).select(*keys, "u", "v", (F.col("n") / F.col("_N")).alias("q"))
    return Grad(q, _a_from_q(q, keys), keys)


def average(grad: Grad, over: str, keys: Sequence[str] = ()) -> Grad:
    """Mean of the gradients of the ``over`` groups (absent pairs count as 0)."""
    keys = list(keys)
    n_sets = grad.q.select(*keys, over).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"))
    s = grad.q.groupBy(*keys, "u", "v").agg(F.sum("q").alias("_s"))
    s = s.join(n_sets, keys) if keys else with_scalars(s, n_sets)
    q = s.select(*keys, "u", "v", (F.col("_s") / F.col("_k")).alias("q"))
    return Grad(q, _a_from_q(q, keys), keys)


def first_blocks(blocks: DataFrame, batches: int | None = None, batch_size: int = 2) -> DataFrame:
    """Blocks of the first ``batches`` batches of each set; all of them by default."""
    return blocks if batches is None else blocks.filter(F.col("block_no") < batches * batch_size)


def val_gradient(counts: DataFrame, set_key: str, keys: Sequence[str] = (), ignore: int | None = IGNORE_PLAIN) -> Grad:
    """Per-set gradient of the counted positions, averaged over the sets.

    ``counts`` holds the pair counts of all blocks of each set, or of its first
    batches (:func:`first_blocks`)."""
    per_set = source_gradient(counts, [*keys, set_key], ignore)
    return average(per_set, set_key, keys)


def valid_sets(sets: DataFrame, files: DataFrame, min_files: int, set_key: str = "set_id", source: str = "source") -> DataFrame:
    """M2 for validation sets ``(set_id, source, weight)``: a set stays only if every one of its sources has ``min_files``
    files (``files(source, n_files)``); weights are normalised within each set that stays."""
    m = sets.join(files.select(source, "n_files"), source, "left")
    good = m.groupBy(set_key).agg(F.min(F.coalesce("n_files", F.lit(0)) >= min_files).alias("_all")).filter("_all").select(set_key)
    w = Window.partitionBy(set_key)
    return m.join(good, set_key, "left_semi").withColumn("weight", F.col("weight") / F.sum("weight").over(w)).drop("n_files")


def weighted_set_gradient(counts: DataFrame, sets: DataFrame, set_key: str = "set_id", source: str = "source",
                          ignore: int | None = IGNORE_PLAIN) -> Grad:
    """L10 for weighted sets: a set's gradient is the weighted mean of its sources' gradients, the target the mean over the sets.

    Both means are linear, so each source enters once, with the mean of its weights over all sets."""
    n_sets = sets.select(set_key).distinct().agg(F.count(F.lit(1)).alias("_k"))
    share = with_scalars(sets.groupBy(source).agg(F.sum("weight").alias("_w")), n_sets)
    per_source = source_gradient(counts, [source], ignore)
    q = per_source.q.join(share.select(source, (F.col("_w") / F.col("_k")).alias("_share")), source)
    q = q.groupBy("u", "v").agg(F.sum(F.col("q") * F.col("_share")).alias("q"))
    return Grad(q, _a_from_q(q, []), [])


def values(grad: Grad, proxy: Proxy) -> DataFrame:
    """Gradient entries on the support of q: keys..., u, v, g."""
    d = with_prob(grad.q, proxy).join(grad.a, [*grad.keys, "u"])
    return d.select(*grad.keys, "u", "v", (F.col("a") * F.col("prob") - F.col("q")).alias("g"))


def _s2(df: DataFrame, proxy: Proxy) -> DataFrame:
    d = df.join(proxy.ctx.select("u", "s2"), "u", "left")
    return d.withColumn("s2", F.coalesce("s2", F.lit(1.0 / proxy.vocab)))


def inner_products(A: Grad, B: Grad, proxy: Proxy, small_a: bool = False) -> DataFrame:
    """``<A_i, B_j>`` for every group i of A and j of B (keys must differ).

    A is the target side (one or a few groups, small), B the sources (large).
    The two terms over B's support are one pass over ``qB``: A's ``a`` and
    ``q`` are joined onto it (the small side; AQE broadcasts it) and the
    proxy probability looked up once.  The other two terms only touch A's
    support and the per-context tables.
    """
    ka, kb = A.keys, B.keys
    if set(ka) & set(kb):
        raise ValueError("gradient key names must differ")
    aA = A.a.withColumnRenamed("a", "aA")
    aB = B.a.withColumnRenamed("a", "aB")
    qA = A.q.withColumnRenamed("q", "qA")
    if small_a:  # the caller has counted A's rows
        aA, qA = F.broadcast(aA), F.broadcast(qA)
    qB = B.q.withColumnRenamed("q", "qB")
    # over B's support: sum qB (qA - aA p)
    big = qB.join(aA, "u", "left") if not ka else qB.join(aA, "u", "inner")
    big = big.join(qA, [*ka, "u", "v"], "left")
    big = with_prob(big, proxy).select(
        *ka, *kb,
        (F.col("qB") * (F.coalesce("qA", F.lit(0.0)) - F.coalesce("aA", F.lit(0.0)) * F.col("prob"))).alias("x"))
    # over contexts: sum aA aB S2
    t1 = _s2(aA.join(aB, "u"), proxy).select(*ka, *kb, (F.col("aA") * F.col("aB") * F.col("s2")).alias("x"))
    # over A's support: -sum aB p qA
    t3 = with_prob(qA.join(aB, "u"), proxy).select(*ka, *kb, (-F.col("aB") * F.col("prob") * F.col("qA")).alias("x"))
    allt = big.unionByName(t1).unionByName(t3)
    return allt.groupBy(*ka, *kb).agg(F.sum("x").alias("ip"))


def materialize(G: Grad) -> Grad:
    """Write a gradient's tables to the shared checkpoint folder (read many times)."""
    from blendwise.session import cut_lineage

    return Grad(cut_lineage(G.q), cut_lineage(G.a), G.keys)


def norms(G: Grad, proxy: Proxy) -> DataFrame:
    """``||G_i||`` per group: sum a^2 S2 - 2 sum a p q + sum q^2."""
    k = G.keys
    t1 = _s2(G.a, proxy).select(*k, (F.col("a") * F.col("a") * F.col("s2")).alias("x"))
    t2 = with_prob(G.q.join(G.a, [*k, "u"]), proxy).select(*k, (F.lit(-2.0) * F.col("a") * F.col("prob") * F.col("q")).alias("x"))
    t3 = G.q.select(*k, (F.col("q") * F.col("q")).alias("x"))
    return t1.unionByName(t2).unionByName(t3).groupBy(*k).agg(F.sqrt(F.greatest(F.sum("x"), F.lit(0.0))).alias("norm"))


def alignment(A: Grad, B: Grad, proxy: Proxy, metric: str = "dot") -> DataFrame:
    """Inner product, or cosine ``<A,B> / (|A| |B|)`` (0 when a norm is 0)."""
    ip = inner_products(A, B, proxy)
    if metric == "dot":
        return ip
    if metric != "cosine":
        raise ValueError("metric must be 'dot' or 'cosine'")
    na = norms(A, proxy).withColumnRenamed("norm", "normA")
    nb = norms(B, proxy).withColumnRenamed("norm", "normB")
    d = ip.join(na, A.keys).join(nb, B.keys)
    den = F.col("normA") * F.col("normB")
    return d.withColumn("cosine", F.when(den > 0, F.col("ip") / den).otherwise(F.lit(0.0)))


def ip_for_sources(ip: DataFrame, mixture: DataFrame, keys: Sequence[str], source: str = "source") -> DataFrame:
    """Every mixture source gets a value; a source absent from the batch gets 0.0."""
    m = mixture.select(*keys, source).distinct() if keys else mixture.select(source).distinct()
    return m.join(ip, [*keys, source], "left").withColumn("ip", F.coalesce("ip", F.lit(0.0)))
