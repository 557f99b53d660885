"""A softmax head over hashed context features, trained by gradient steps.

Stands in for the proxy's training step.  Context u is hashed into one of
``n_features`` buckets f; the head has one logit row W[f, :] over the V
targets.  For a one-hot feature the gradient of the weighted mean
cross-entropy is ``(T_f p_f(v) - c_f(v)) / N`` with ``c_f(v)`` the weighted
counts and ``T_f`` their row total, so every step is one join of the
parameter table with the counts and one aggregate; the parameters stay a
DataFrame ``(f, v, w)`` of F x V rows (model size, not data size).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blendwise.session import cut_lineage, with_scalars


def feature_counts(pairs: DataFrame, n_features: int, weight: str | None = None) -> DataFrame:
    """Weighted counts ``(f, v, c)`` with ``f = md5(u) mod F`` (partial + final aggregate)."""
    w = F.col("n") * (F.col(weight) if weight else F.lit(1.0))
    f = (F.conv(F.substring(F.md5(F.col("u").cast("string")), 1, 8), 16, 10).cast("bigint") % n_features).cast("int")
    return pairs.groupBy(f.alias("f"), "v").agg(F.sum(w).alias("c"))


def fit_softmax_head(spark: SparkSession, pairs: DataFrame, vocab: int, n_features: int = 64, steps: int = 5,
                     lr: float = 50.0, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Gradient descent on W from zero; returns (W, per-step loss table)."""
    c = cut_lineage(feature_counts(pairs.filter((F.col("v") >= 0) & (F.col("v") < vocab)), n_features, weight))
    tot = c.groupBy("f").agg(F.sum("c").alias("T"))
    n_all = c.agg(F.sum("c").alias("N"))
    w = spark.range(n_features).select(F.col("id").cast("int").alias("f"),
                                       F.explode(F.sequence(F.lit(0), F.lit(vocab - 1))).alias("v")).withColumn("w", F.lit(0.0))
    w = cut_lineage(w)
    losses = []
    by_f = Window.partitionBy("f")  # V rows per feature
    for step in range(steps + 1):
        lp = w.withColumn("_m", F.max("w").over(by_f))
        lp = lp.withColumn("logp", F.col("w") - F.col("_m") - F.log(F.sum(F.exp(F.col("w") - F.col("_m"))).over(by_f))).drop("_m")
        j = lp.join(c, ["f", "v"], "left").withColumn("c", F.coalesce("c", F.lit(0.0))).join(tot, "f", "left")
        j = j.withColumn("T", F.coalesce("T", F.lit(0.0)))
        j = with_scalars(j, n_all)
        losses.append(j.groupBy().agg((-F.sum(F.col("c") * F.col("logp")) / F.first("N")).alias("loss"))
                      .withColumn("step", F.lit(step)))
        if step == steps:
            break
        grad = (F.col("T") * F.exp("logp") - F.col("c")) / F.col("N")
        w = cut_lineage(j.select("f", "v", (F.col("w") - F.lit(lr) * grad).alias("w")))
    out = losses[0]
    for x in losses[1:]:
        out = out.unionByName(x)
    return w, out.select("step", "loss")
