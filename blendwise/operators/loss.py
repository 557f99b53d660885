"""Proxy head, token losses and cross-entropy reductions.

The proxy is a softmax head over a one-hot context: the previous id
(``order='bigram'``) or a constant (``order='unigram'``, context id -1).
Its fitted probabilities are additive-smoothed conditional frequencies
``p(v|u) = (alpha + c(u,v)) / (c(u) + alpha V)`` of (weighted) pair counts,
which minimise the (weighted) cross-entropy.  Losses are computed on pair
counts, which are aggregated map-side before any shuffle, not on positions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blendwise.session import small_broadcast

UNIGRAM_CONTEXT = -1
IGNORE_PLAIN = -1       # ignore id of the plain loss
IGNORE_WEIGHTED = -100  # ignore id of the weighted loss


def positions(blocks: DataFrame, keys: Sequence[str], order: str = "bigram", inputs: str = "input_ids",
              targets: str = "targets") -> DataFrame:
    """One row per (input, target) position: keys..., pos, u, v."""
    z = F.posexplode(F.arrays_zip(F.col(inputs).alias("u"), F.col(targets).alias("v")))
    p = blocks.select(*keys, z.alias("pos", "_uv"))
    u = F.col("_uv.u") if order == "bigram" else F.lit(UNIGRAM_CONTEXT)
    return p.select(*keys, "pos", u.cast("int").alias("u"), F.col("_uv.v").cast("int").alias("v"))


CTX_BROADCAST_ROWS = 1 << 20  # per-context tables (<= V rows) up to this vocabulary size are broadcast
WEIGHT_BROADCAST_ROWS = 100_000  # tables of weights are counted, and broadcast up to this many sources
PAIR_SHIFT = 1 << 31
PAIR_HALF = 1 << 30  # ids in [-2^30, 2^30): any vocabulary and the ignore ids


def pair_counts(blocks: DataFrame, keys: Sequence[str], order: str = "bigram", inputs: str = "input_ids",
                targets: str = "targets") -> DataFrame:
    """L1: ``n`` = positions with context u and target v, per keys (partial + final aggregate).

    Each position is one long ``(u + 2^30) * 2^31 + (v + 2^30)`` (``zip_with``, no
    struct per position), so the exploded rows and the hash keys stay small."""
    ctx = F.col(inputs) if order == "bigram" else F.transform(inputs, lambda x: F.lit(UNIGRAM_CONTEXT))
    half = F.lit(PAIR_HALF).cast("bigint")
    code = F.zip_with(ctx, F.col(targets),
                      lambda u, v: (u.cast("bigint") + half) * F.lit(PAIR_SHIFT) + (v.cast("bigint") + half))
    c = blocks.select(*keys, F.explode(code).alias("_k")).groupBy(*keys, "_k").agg(F.count(F.lit(1)).alias("n"))
    u = (F.floor(F.col("_k") / F.lit(PAIR_SHIFT)) - half).cast("int")
    v = (F.col("_k") % F.lit(PAIR_SHIFT) - half).cast("int")
    return c.select(*keys, u.alias("u"), v.alias("v"), "n")


@dataclass
class Proxy:
    """Fitted head: ``pairs(u, v, c)`` and ``ctx(u, cu, zu, s2, n_seen, slog_seen)``."""

    pairs: DataFrame
    ctx: DataFrame
    alpha: float
    vocab: int

    def background(self) -> float:
        """p(v|u) for a context never seen: 1 / V."""
        return 1.0 / self.vocab

    def materialize(self) -> "Proxy":
        """Write both tables to the shared checkpoint folder (they are read by
        several joins of a step)."""
        from blendwise.session import cut_lineage

        return Proxy(cut_lineage(self.pairs), cut_lineage(self.ctx), self.alpha, self.vocab)

    def for_positions(self) -> "Proxy":
        """The table that rows of single positions are joined with: its at most V x V pairs are broadcast up to
        ``CTX_BROADCAST_ROWS``, so that the positions do not move."""
        if self.vocab**2 > CTX_BROADCAST_ROWS:
            return self
        return Proxy(F.broadcast(self.pairs), self.ctx, self.alpha, self.vocab)


def fit_proxy(counts: DataFrame, weights: DataFrame | None = None, alpha: float = 0.1, vocab: int = 1024,
              source: str = "source", ignore: int | None = IGNORE_PLAIN, extra_keys: Sequence[str] = ()) -> Proxy:
    """L2: weighted counts ``c(u,v) = sum w_s n_s(u,v)`` and per-context totals.

    ``weights`` is ``(source, w)`` (a K-row table); without it every count has
    weight 1.  Positions whose target is the ignore id carry no count.
    """
    if alpha <= 0:
        raise ValueError("alpha must be > 0 (a zero probability has infinite loss)")
    c = counts
    if ignore is not None:
        c = c.filter(F.col("v") != F.lit(ignore))
    if weights is not None:
        c = c.join(small_broadcast(weights.select(source, F.col("w").alias("_w")), WEIGHT_BROADCAST_ROWS), source, "inner")
        wn = F.col("_w") * F.col("n")
    else:
        wn = F.col("n").cast("double")
    keys = list(extra_keys)
    pairs = c.groupBy(*keys, "u", "v").agg(F.sum(wn).alias("c"))
    return proxy_from_pairs(pairs, alpha, vocab, keys)


def proxy_from_pairs(pairs: DataFrame, alpha: float, vocab: int, keys: Sequence[str] = ()) -> Proxy:
    """Proxy from weighted pair counts ``(keys..., u, v, c)``: per-context totals,
    ``sum_v p^2`` and ``sum_v log p`` over the whole vocabulary (unseen targets included)."""
    if alpha <= 0:
        raise ValueError("alpha must be > 0 (a zero probability has infinite loss)")
    a, V = float(alpha), int(vocab)
    keys = list(keys)
    ctx = pairs.groupBy(*keys, "u").agg(
        F.sum("c").alias("cu"), F.sum(F.col("c") * F.col("c")).alias("_c2"), F.count(F.lit(1)).alias("n_seen"),
        F.sum(F.log(F.lit(a) + F.col("c"))).alias("_slog"),
    )
    zu = F.col("cu") + F.lit(a * V)
    ctx = ctx.withColumn("zu", zu)
    ctx = ctx.withColumn("s2", (F.lit(V * a * a) + F.lit(2 * a) * F.col("cu") + F.col("_c2")) / (F.col("zu") * F.col("zu")))
    ctx = ctx.withColumn(
        "slog", F.col("_slog") + (F.lit(V) - F.col("n_seen")) * F.log(F.lit(a)) - F.lit(V) * F.log("zu")
    ).drop("_c2", "_slog")
    if not keys and V <= CTX_BROADCAST_ROWS:
        ctx = F.broadcast(ctx)  # one row per context id: at most V rows
    return Proxy(pairs, ctx, a, V)


def with_prob(df: DataFrame, proxy: Proxy, keys: Sequence[str] = ()) -> DataFrame:
    """Add ``prob`` = p(v|u) (and the context columns) to rows with u, v."""
    d = df.join(proxy.pairs, [*keys, "u", "v"], "left").join(proxy.ctx.select(*keys, "u", "zu", "slog"), [*keys, "u"], "left")
    a, V = proxy.alpha, proxy.vocab
    prob = F.when(F.col("zu").isNull(), F.lit(1.0 / V)).otherwise((F.lit(a) + F.coalesce("c", F.lit(0.0))) / F.col("zu"))
    slog = F.coalesce(F.col("slog"), F.lit(-V * math.log(V)))
    return d.withColumn("prob", prob).withColumn("slog_u", slog).drop("c", "zu", "slog")


def token_loss(df: DataFrame, proxy: Proxy, keys: Sequence[str] = (), smoothing: float = 0.0,
               ignore: int = IGNORE_PLAIN) -> DataFrame:
    """Per-row loss ``-log p(v|u)``, label-smoothed
    ``(1-eps) nll + eps (-sum_v log p(v|u) / V)``; ignored targets get 0 and ``keep`` = 0."""
    d = with_prob(df, proxy, keys)
    nll = -F.log("prob")
    loss = nll if smoothing == 0 else F.lit(1 - smoothing) * nll + F.lit(smoothing) * (-F.col("slog_u") / F.lit(proxy.vocab))
    keep = (F.col("v") != F.lit(ignore)).cast("int")
    return d.withColumn("keep", keep).withColumn("loss", F.when(F.col("keep") == 1, loss).otherwise(F.lit(0.0)))


def cross_entropy(losses: DataFrame, keys: Sequence[str] = (), n: str | None = "n", chunked: bool = False,
                  reduction: str = "mean") -> DataFrame:
    """Mean over kept positions (``chunked=False``) or over all positions
    (``chunked=True``, ignored ones count as 0); ``reduction='none'`` returns the rows.

    ``n`` names the multiplicity column of aggregated pair rows (None: one row per position).
    """
    if reduction == "none":
        return losses
    if reduction != "mean":
        raise ValueError("reduction must be 'mean' or 'none'")
    cnt = F.col(n) if n else F.lit(1)
    den = F.sum(cnt) if chunked else F.sum(cnt * F.col("keep"))
    # no kept position: null (0/0), not an error
    return losses.groupBy(*keys).agg(F.try_divide(F.sum(cnt * F.col("loss")), den).alias("loss"))


def weighted_ce(losses: DataFrame, weights: DataFrame | None, keys: Sequence[str] = (), n: str | None = "n",
                source: str = "source", reduction: str = "mean") -> DataFrame:
    """``sum(w l keep) / sum(w keep)`` with per-source sample weights ``(source, w)``."""
    d = losses if weights is None else losses.join(small_broadcast(weights.select(source, "w"), WEIGHT_BROADCAST_ROWS), source, "left")
    w = F.coalesce(F.col("w"), F.lit(1.0)) if weights is not None else F.lit(1.0)
    cnt = F.col(n) if n else F.lit(1)
    if reduction == "none":
        return d.withColumn("loss", F.col("loss") * w)
    return d.groupBy(*keys).agg(
        F.try_divide(F.sum(cnt * w * F.col("loss") * F.col("keep")), F.sum(cnt * w * F.col("keep"))).alias("loss")
    )


def mask_targets(rows: DataFrame, ignore: int, when: Column) -> DataFrame:
    """Replace targets matching ``when`` (a function of the element) by the ignore id: in blocks, or in their pair counts,
    where pairs that become one are added up."""
    if "targets" in rows.columns:
        return rows.withColumn("targets", F.transform("targets", lambda x: F.when(when(x), F.lit(ignore)).otherwise(x)))
    keys = [c for c in rows.columns if c != "n"]
    return rows.withColumn("v", F.when(when(F.col("v")), F.lit(ignore)).otherwise(F.col("v"))).groupBy(*keys).agg(F.sum("n").alias("n"))
