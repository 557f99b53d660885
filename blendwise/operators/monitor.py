"""Run metrics: throughput, rolling loss, FLOP/s and utilisation, time, ETA
(R1-R9, E2).

A run log is ``(run_id, iter, elapsed, samples, lengths, loss)`` with
cumulative ``samples``/``lengths``.  The monitor keeps the last
``window + 1`` points, so a metric at iteration i compares it with i - w.
The log is cut into ranges of iterations, each with the last rows of the range before it, and
lags and rolling means are bounded frames over a range (never one task per run).
Metrics exist only where the window is full.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blendwise.functions.prefix import prefix_rank, prefix_sum

# Seconds per time unit of the elapsed-time metrics.
TIME_UNITS = {"seconds": 1, "minutes": 60, "hours": 60 * 60, "days": 60 * 60 * 24}

# Device peak FLOP/s by precision (data-sheet numbers, sparsity halved).
DEVICE_PEAKS = [
    ("h100-sxm", "64-true", 67e12), ("h100-sxm", "32-true", 67e12),
    ("h100-sxm", "16-true", 1.979e15 / 2), ("h100-sxm", "16-mixed", 1.979e15 / 2),
    ("h100-sxm", "bf16-true", 1.979e15 / 2), ("h100-sxm", "bf16-mixed", 1.979e15 / 2),
    ("h100-sxm", "8-true", 3.958e15 / 2), ("h100-sxm", "8-mixed", 3.958e15 / 2),
    ("h100-pcie", "64-true", 51e12), ("h100-pcie", "32-true", 51e12),
    ("h100-pcie", "16-true", 1.513e15 / 2), ("h100-pcie", "16-mixed", 1.513e15 / 2),
    ("h100-pcie", "bf16-true", 1.513e15 / 2), ("h100-pcie", "bf16-mixed", 1.513e15 / 2),
    ("h100-pcie", "8-true", 3.026e15 / 2), ("h100-pcie", "8-mixed", 3.026e15 / 2),
    ("a100", "64-true", 19.5e12), ("a100", "32-true", 19.5e12), ("a100", "16-true", 312e12),
    ("a100", "16-mixed", 312e12), ("a100", "bf16-true", 312e12), ("a100", "bf16-mixed", 312e12),
    ("a10g", "32-true", 31.2e12), ("a10g", "16-true", 125e12), ("a10g", "16-mixed", 125e12),
    ("a10g", "bf16-true", 125e12), ("a10g", "bf16-mixed", 125e12),
    ("v100-sxm", "64-true", 7.8e12), ("v100-sxm", "32-true", 15.7e12), ("v100-sxm", "16-true", 125e12),
    ("v100-sxm", "16-mixed", 125e12),
    ("v100-pcie", "64-true", 7e12), ("v100-pcie", "32-true", 14e12), ("v100-pcie", "16-true", 112e12),
    ("v100-pcie", "16-mixed", 112e12),
    ("v100s-pcie", "64-true", 8.2e12), ("v100s-pcie", "32-true", 16.4e12), ("v100s-pcie", "16-true", 130e12),
    ("v100s-pcie", "16-mixed", 130e12),
    ("t4", "32-true", 8.1e12), ("t4", "16-true", 65e12), ("t4", "16-mixed", 65e12), ("t4", "8-true", 130e12),
    ("t4", "int4", 260e12),
    ("quadro rtx 5000", "32-true", 11.2e12), ("quadro rtx 5000", "16-true", 89.2e12),
    ("quadro rtx 5000", "16-mixed", 89.2e12),
]

# Peak FLOP/s of the tensor-processor generations, the same for every precision.
TENSOR_PEAKS = [("v2", 45e12), ("v3", 123e12), ("v4", 275e12)]

# The named proxy shapes (layers, width, context, vocabulary, MLP width).
MODEL_SHAPES = [
    ("tinyllama_1M", 2, 256, 2048, 50432, 512),
    ("tinycoder_1M", 2, 256, 2048, 49152, 512),
    ("tinyllama_60M", 10, 768, 2048, 50432, 1536),
    ("tinyllama_1_1b", 22, 2048, 2048, 50432, 5632),
]

DEVICE_SCHEMA = T.StructType([
    T.StructField("device", T.StringType()), T.StructField("precision", T.StringType()),
    T.StructField("peak_flops", T.DoubleType()),
])


def llama_params(n_layer: int, n_embd: int, vocab: int, inter: int) -> int:
    """Parameters of a LLaMA-style stack with untied embedding and head: embedding and
    head ``2 V E``; per layer q, k, v, o ``4 E^2``, gated MLP ``3 E I`` and two norms ``2 E``; final norm ``E``."""
    return 2 * vocab * n_embd + n_layer * (4 * n_embd * n_embd + 3 * n_embd * inter + 2 * n_embd) + n_embd


def shapes_table(spark) -> DataFrame:
    rows = [(n, L, E, B, llama_params(L, E, V, I), 0) for n, L, E, B, V, I in MODEL_SHAPES]
    return spark.createDataFrame(rows, "name string, n_layer int, n_embd int, block_size int, n_params bigint, n_frozen bigint")


def devices_table(spark) -> DataFrame:
    """Peaks of all device families by precision; a tensor processor has one row per known precision."""
    precisions = list(dict.fromkeys(p for _, p, _ in DEVICE_PEAKS))
    return spark.createDataFrame(DEVICE_PEAKS + [(d, p, f) for d, f in TENSOR_PEAKS for p in precisions], DEVICE_SCHEMA)


def run_log(events: DataFrame, micro_batch: int = 16, seq_len: int = 2048, bucket_width_us: int = 3600 * 10**6) -> DataFrame:
    """Run log from an event table: run = ``event_type``, iteration = rank by ``ts``
    (0-based), elapsed seconds since the run's first event, cumulative samples and
    lengths, loss = ln(1 + value)."""
    e = events.select(F.col("event_type").alias("run_id"), "ts", "value", epoch_micros(events, "ts").alias("_us"))
    e = prefix_rank(e, ["run_id"], ["_us", "ts"], "_r", bucket_width=bucket_width_us, least=("_us", "_us0"))
    it = F.col("_r") - 1
    return e.select(
        "run_id", it.alias("iter"), ((F.col("_us") - F.col("_us0")) / F.lit(1e6)).alias("elapsed"),
        (F.lit(micro_batch) * (it + 1)).alias("samples"), (F.lit(seq_len) * (it + 1)).alias("lengths"),
        F.log1p("value").alias("loss"), "value",
    )


def epoch_micros(df: DataFrame, col: str) -> Column:
    """Microseconds since the epoch, without a time-zone shift for TIMESTAMP_NTZ."""
    if isinstance(df.schema[col].dataType, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {col})")
    return F.unix_micros(F.col(col))


FRAME_WIDTH = 1 << 12


def _framed(log: DataFrame, rows: int, key: str = "run_id"):
    """``log`` cut into ranges of iterations, each with the last ``rows`` rows of the range before it, and the
    window over a range: frames of up to ``rows`` preceding rows in one pass, never a whole run in one task.
    Rows with ``_own`` false are the copies."""
    width = max(FRAME_WIDTH, rows)
    b = F.floor(F.col("iter") / width)
    near_end = F.col("iter") % width >= width - rows
    d = log.withColumn("_range", F.explode(F.when(near_end, F.array(b, b + 1)).otherwise(F.array(b))))
    return d.withColumn("_own", F.col("_range") == b), Window.partitionBy(key, "_range").orderBy("iter")


def _lagged(log: DataFrame, w: int, cols: Sequence[str], key: str = "run_id") -> DataFrame:
    """Each row with the values of ``w`` iterations earlier (only full windows)."""
    d, win = _framed(log, w, key)
    for c in cols:
        d = d.withColumn(f"{c}_lag", F.lag(c, w).over(win))
    return d.withColumn("_before", F.lag("iter", w).over(win)).filter("_own and _before is not null").drop("_own", "_before", "_range")


def throughput(log: DataFrame, window: int, world_size: int = 1) -> DataFrame:
    """batches/s, samples/s, tokens/s (also per device) and total tokens."""
    d = _lagged(log, window, ["samples", "elapsed", "lengths"])
    wct = F.col("elapsed") - F.col("elapsed_lag")
    es = F.col("samples") - F.col("samples_lag")
    sps = es * F.lit(world_size) / wct
    avg_len = (F.col("lengths") - F.col("lengths_lag")) / F.lit(window)
    return d.select(
        "run_id", "iter",
        (F.lit(window * world_size) / wct).alias("batches_per_sec"), sps.alias("samples_per_sec"),
        (F.lit(window) / wct).alias("device_batches_per_sec"), (es / wct).alias("device_samples_per_sec"),
        (sps * avg_len).alias("tokens_per_sec"), (es / wct * avg_len).alias("device_tokens_per_sec"),
        (avg_len * F.lit(world_size) * F.col("samples")).alias("total_tokens"),
    )


def rolling_loss(log: DataFrame, n: int, window: int | None = None) -> DataFrame:
    """Mean of the last ``n`` losses and its perplexity; with ``window`` only
    where the throughput window is full (as the monitor reports it)."""
    d, win = _framed(log, n)
    d = d.withColumn("train_loss", F.avg("loss").over(win.rowsBetween(1 - n, 0)))
    d = d.filter("_own").select("run_id", "iter", "train_loss")
    if window is not None:
        d = d.filter(F.col("iter") >= window)
    return d.withColumn("train_ppl", F.exp("train_loss"))


def flops_per_batch(shape: DataFrame, micro_batch: int, training: bool = True) -> DataFrame:
    """R5 estimate per batch: ``(2 n block + 4 layers embd block^2)`` per parameter
    set, x3 for trainable and x2 for frozen parameters when training (x1 otherwise)."""
    def per(n: Column) -> Column:
        return F.lit(2.0) * n * F.col("block_size") + F.lit(4.0) * F.col("n_layer") * F.col("n_embd") * F.col("block_size") * F.col("block_size")

    ops_t, ops_f = (3.0, 2.0) if training else (1.0, 1.0)
    fpb = (F.lit(ops_t) * per(F.col("n_params") - F.col("n_frozen")) + F.lit(ops_f) * per(F.col("n_frozen"))) * F.lit(micro_batch)
    return shape.withColumn("flops_per_batch", fpb)


def flops_rate(log: DataFrame, window: int, flops_per_batch_: Column, world_size: int = 1) -> DataFrame:
    """FLOP/s over the last ``window`` batches (the oldest entry dropped)."""
    d = _lagged(log, window, ["elapsed"])
    fps = F.lit(window) * flops_per_batch_ * F.lit(world_size) / (F.col("elapsed") - F.col("elapsed_lag"))
    return d.select("run_id", "iter", fps.alias("flops_per_sec"), (fps / F.lit(world_size)).alias("device_flops_per_sec"))


def mfu_runs(log: DataFrame, shapes: DataFrame, devices: DataFrame, runs: DataFrame, window: int, micro_batch: int,
             world_size: int = 1) -> DataFrame:
    """R5 for runs of different models and devices: ``runs(run_id, model, device, precision)`` is joined with the
    shape and peak lists (configuration tables), the result with the log.  A run whose device has no
    peak for its precision is left out."""
    sh = flops_per_batch(shapes, micro_batch).select(F.col("name").alias("model"), "flops_per_batch")
    per_run = runs.join(F.broadcast(sh), "model").join(F.broadcast(devices), ["device", "precision"])
    return _utilisation(_lagged(log, window, ["elapsed"]).join(per_run, "run_id"), window, world_size)


def mfu(log: DataFrame, shapes: DataFrame, devices: DataFrame, model: str, device: str, precision: str,
        window: int, micro_batch: int, world_size: int = 1) -> DataFrame:
    """utilisation = device FLOP/s / device peak, with the model shape and
    the device peak joined in from their (small, known-size) tables."""
    sh = flops_per_batch(shapes.filter(F.col("name") == model), micro_batch).select(F.lit(1).alias("_k"), "flops_per_batch")
    pk = devices.filter((F.col("device") == device) & (F.col("precision") == precision)).select(F.lit(1).alias("_k"), "peak_flops")
    d = _lagged(log, window, ["elapsed"]).withColumn("_k", F.lit(1))
    return _utilisation(d.join(F.broadcast(sh), "_k").join(F.broadcast(pk), "_k"), window, world_size)


def _utilisation(d: DataFrame, window: int, world_size: int) -> DataFrame:
    fps = F.lit(window) * F.col("flops_per_batch") * F.lit(world_size) / (F.col("elapsed") - F.col("elapsed_lag"))
    dev = fps / F.lit(world_size)
    return d.select("run_id", "iter", fps.alias("flops_per_sec"), dev.alias("device_flops_per_sec"),
                    (dev / F.col("peak_flops")).alias("mfu"))


def elapsed(log: DataFrame, unit: str = "hours", eval_col: str | None = None) -> DataFrame:
    """Train, validation and total time in ``unit``; validation time is the
    running sum of ``eval_col`` (seconds), 0 without it."""
    if unit not in TIME_UNITS:
        raise ValueError(f"unknown unit {unit!r}; known are {', '.join(TIME_UNITS)}")
    div = float(TIME_UNITS[unit])
    d = log
    if eval_col:
        d = prefix_sum(d, ["run_id"], "iter", eval_col, "_ev", bucket_width=1 << 12)
    else:
        d = d.withColumn("_ev", F.lit(0.0))
    return d.select("run_id", "iter", (F.col("elapsed") / div).alias("time_train"), (F.col("_ev") / div).alias("time_val"),
                    ((F.col("elapsed") + F.col("_ev")) / div).alias("time_total"), "samples")


def every(log: DataFrame, n: int) -> DataFrame:
    """The rows logged every ``n``-th iteration."""
    return log.filter(F.col("iter") % n == 0)


def eta(log: DataFrame, max_iters: int, initial_iter: int = 0) -> DataFrame:
    """Remaining hours and days at each iteration."""
    done = F.col("iter") + 1
    hours = F.col("elapsed") / (done - F.lit(initial_iter)) * (F.lit(max_iters) - done) / F.lit(3600.0)
    return log.select("run_id", "iter", hours.alias("remaining_hours"), (hours / F.lit(24.0)).alias("remaining_days"))


def cumulative(log: DataFrame, col: str, out: str) -> DataFrame:
    """Running total of ``col`` per run (two-level prefix sum)."""
    return prefix_sum(log, ["run_id"], "iter", col, out, bucket_width=1 << 12)


def perplexity(loss: Column) -> Column:
    """E2."""
    return F.exp(loss)
