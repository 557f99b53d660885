"""Streaming run metrics (R10): tumbling-window throughput and mean loss.

Events older than the watermark (max event time seen minus ``delay``) are
dropped; a window is emitted once the watermark passes its end (append
mode).  The same function on a batch DataFrame is its batch twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metrics_stream(events: DataFrame, window: str = "1 hour", delay: str = "10 minutes",
                   micro_batch: int = 16, seq_len: int = 2048) -> DataFrame:
    """Per (run, window): batches, samples, tokens, batches/s, mean loss, perplexity."""
    e = events.select(F.col("event_type").alias("run_id"), "ts", F.log1p("value").alias("loss"))
    e = e.withWatermark("ts", delay)
    g = e.groupBy("run_id", F.window("ts", window).alias("win")).agg(
        F.count(F.lit(1)).alias("batches"), F.avg("loss").alias("mean_loss"))
    secs = F.expr("timestampdiff(SECOND, win.start, win.end)")
    return g.select(
        "run_id", F.col("win.start").alias("window_start"), "batches", (F.col("batches") / secs).alias("batches_per_sec"),
        (F.col("batches") * micro_batch).alias("samples"), (F.col("batches") * micro_batch * seq_len).alias("tokens"),
        "mean_loss", F.exp("mean_loss").alias("ppl"),
    )
