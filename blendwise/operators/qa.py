"""Question/answer target: pairs, sampling, order, masked targets, batches,
and the target gradient (Q1-Q6, L11).

A pair's text is ``question + " " + answer``; its targets are the ids
shifted left by one, with the question part and the last position set to
the ignore id -100, so pairs of a batch never reach into each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blendwise.functions.hashing import md5_key
from blendwise.functions.prefix import hashed_bucket, prefix_rank
from blendwise.operators.gradients import Grad
from blendwise.operators.loss import IGNORE_WEIGHTED
from blendwise.operators.tokens import encode, tokenize
from blendwise.session import with_scalars
from blendwise.sources.tables import qa_task

QA_BATCH = 16


def pairs_from_conversations(conv: DataFrame) -> DataFrame:
    """Q6: a user turn followed directly by an assistant turn is one pair.

    The window is one conversation (a handful of turns), not a source."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = conv.select("conv_id", "turn", "role", "text",
                    F.lead("role").over(w).alias("_nrole"), F.lead("text").over(w).alias("_ntext"))
    c = c.filter((F.col("role") == "user") & (F.col("_nrole") == "assistant"))
    return c.select(
        qa_task(F.col("conv_id")).alias("task"),
        F.concat_ws(":", "conv_id", "turn").alias("pair_id"),  # conversation and the question's turn
        F.col("text").alias("question"), F.col("_ntext").alias("answer"),
    )


def sample_per_task(qa: DataFrame, n: int, seed: int) -> DataFrame:
    """Q1: at most ``n`` pairs per task, chosen by a seeded hash order.

    ``row_number() <= n`` lets Spark keep only n rows per task in every map
    task before the shuffle (window group limit)."""
    w = Window.partitionBy("task").orderBy(md5_key(F.lit(seed), F.col("pair_id")), "pair_id")
    return qa.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def union_shuffled(tasks: Sequence[DataFrame] | DataFrame, seed: int) -> DataFrame:
    """Q2: all tasks in one seeded random order: ``qa_order`` 1..n (two-level rank)."""
    df = tasks if isinstance(tasks, DataFrame) else _union(tasks)
    d = df.withColumn("_k", md5_key(F.lit(seed), F.lit("order"), F.col("pair_id")))
    return prefix_rank(d, [], ["_k", "pair_id"], "qa_order", bucket=hashed_bucket(F.col("_k"))).drop("_k")


def _union(dfs):
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def qa_text(qa: DataFrame) -> DataFrame:
    """Q3: the prompt text ``question + " " + answer``."""
    return qa.withColumn("text", F.concat_ws(" ", "question", "answer"))


def qa_targets(qa: DataFrame, vocab_size: int) -> DataFrame:
    """Q4: ids of the text, question length, and the masked, shifted targets."""
    d = qa_text(qa)
    d = encode(tokenize(d, "text", "words"), "words", "ids", vocab_size=vocab_size)
    d = d.withColumn("qlen", F.size(F.filter(F.split("question", "[ \\t\\n\\r\\f]+"), lambda x: x != F.lit(""))))
    n = F.size("ids")
    ign = F.lit(IGNORE_WEIGHTED)
    tgt = F.transform("ids", lambda x, i: F.when((i + 1 < F.col("qlen")) | (i + 1 >= n), ign).otherwise(F.col("ids")[i + 1]))
    return d.withColumn("targets", tgt).drop("words")


def qa_batches(items: DataFrame, batch: int = QA_BATCH) -> DataFrame:
    """Q5: per batch (``(qa_order - 1) div batch``) the items' ids and targets
    concatenated in order; a group holds at most ``batch`` items."""
    b = items.withColumn("batch", F.floor((F.col("qa_order") - 1) / batch).cast("bigint"))
    agg = b.groupBy("batch").agg(
        F.array_sort(F.collect_list(F.struct("qa_order", "ids", "targets"))).alias("_it"),
        F.count(F.lit(1)).alias("n_items"),
    )
    return agg.select(
        "batch", "n_items",
        F.flatten(F.transform("_it", lambda s: s["ids"])).alias("ids"),
        F.flatten(F.transform("_it", lambda s: s["targets"])).alias("targets"),
    )


def qa_gradient(items: DataFrame, batch: int = QA_BATCH, exact: bool = False, check: bool = True) -> Grad:
    """Gradient of the question/answer loss for the proxy head.

    Reference arithmetic: per batch the token-mean loss over kept positions
    divided by the batch length, summed over batches, divided by
    ``n_items div batch``.  ``exact=True`` gives the plain token mean.  ``check`` counts the items first
    and raises when they do not fill a batch; without it (the rows) the division by no batch fails when the plan runs.
    Counts are per item (pairs never cross items) and grouped by batch.
    """
    if check:
        n_items = items.count()
        if n_items // batch == 0 and not exact:
            raise ValueError(f"no question/answer batch: {n_items} pairs for batch size {batch}")
    b = items.withColumn("batch", F.floor((F.col("qa_order") - 1) / batch).cast("bigint"))
    z = F.explode(F.arrays_zip(F.col("ids").alias("u"), F.col("targets").alias("v")))
    pos = b.select("batch", z.alias("_p")).select("batch", F.col("_p.u").alias("u"), F.col("_p.v").alias("v"))
    pos = pos.filter(F.col("v") != F.lit(IGNORE_WEIGHTED))
    cnt = pos.groupBy("batch", "u", "v").agg(F.count(F.lit(1)).alias("n"))
    if exact:
        tot = cnt.agg(F.sum("n").alias("_N"))
        q = with_scalars(cnt.groupBy("u", "v").agg(F.sum("n").alias("n")), tot)
        q = q.select("u", "v", (F.col("n") / F.col("_N")).alias("q"))
    else:
        sizes = b.groupBy("batch").agg(F.count(F.lit(1)).alias("_len"))
        n_batches = b.agg(F.floor(F.count(F.lit(1)) / batch).alias("_nb"))
        per = cnt.join(cnt.groupBy("batch").agg(F.sum("n").alias("_Nb")), "batch").join(sizes, "batch")
        per = per.withColumn("_x", F.col("n") / (F.col("_Nb") * F.col("_len")))
        q = with_scalars(per.groupBy("u", "v").agg(F.sum("_x").alias("_s")), n_batches)
        q = q.select("u", "v", (F.col("_s") / F.col("_nb")).alias("q"))
    a = q.groupBy("u").agg(F.sum("q").alias("a"))
    return Grad(q, a, [])
