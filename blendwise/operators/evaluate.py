"""Evaluation: validation loss, task scores, state retention, loss by source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def validate(batch_losses: DataFrame, eval_iters: int | None, keys: Sequence[str] = (), batch: str = "batch",
             true_mean: bool = False) -> DataFrame:
    """Loss of the first ``eval_iters`` batches summed and divided by
    ``eval_iters`` (also when fewer batches exist), or their true mean; all batches with ``eval_iters=None``."""
    if eval_iters is None:
        first, true_mean = batch_losses, True
    else:
        first = batch_losses.filter(F.col(batch) < eval_iters)
    den = F.count(F.lit(1)) if true_mean else F.lit(float(eval_iters))
    return first.groupBy(*keys).agg((F.sum("loss") / den).alias("val_loss")).withColumn("val_ppl", F.exp("val_loss"))


def task_score(results: DataFrame, tasks: Sequence[str], keys: Sequence[str] = ("run_id", "step")) -> DataFrame:
    """Sum of the listed tasks' scores per run and step (absent tasks add
    nothing), and its negation as a loss."""
    r = results.filter(F.col("task").isin(list(tasks)) & F.col("score").isNotNull())
    return r.groupBy(*keys).agg(F.sum("score").alias("perf"), F.count(F.lit(1)).alias("n_tasks")).withColumn(
        "loss", -F.col("perf"))


def retention(states: DataFrame, keys: Sequence[str] = ("run_id",), time: str = "mtime", name: str = "name") -> DataFrame:
    """Per run the newest state (by time, then name) is kept, the rest listed for deletion.

    The newest is found with a grouped ``max_by`` (an aggregate, not a sort of the run)."""
    newest = states.groupBy(*keys).agg(F.max_by(F.col(name), F.struct(time, name)).alias("_newest"))
    d = states.join(newest, list(keys))
    return d.withColumn("keep", F.col(name) == F.col("_newest")).drop("_newest")


def loss_by_source(losses: DataFrame, split: str = "split", source: str = "source", n: str = "n") -> DataFrame:
    """E5: mean loss per (split, source), per split and overall (rollup)."""
    return losses.rollup(split, source).agg((F.sum(F.col(n) * F.col("loss")) / F.sum(n)).alias("loss"),
                                            F.sum(n).alias("n"))
