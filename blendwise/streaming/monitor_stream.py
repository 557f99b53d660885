"""Online run monitor (R1-R3 while the run goes on): every row comes out with its rolling metrics.

The state of a run is a ring of the last ``window + 1`` points, the last ``log_n`` losses, and where the run stands.  Each new
row is one iteration; its metrics compare it with the row ``window`` iterations earlier, as the batch operators
do, and exist only once the ring is full.  State and offsets are in the checkpoint, so a restarted query goes on where it was.

Rows of a micro-batch are put in time order.  A row that is not newer than the newest one its run has seen in earlier
micro-batches is late: its iteration is past, so it is left out of ring and output, and counted in ``late`` of the rows that follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from blendwise.session import ship_package
from blendwise.streaming.pack_stream import STATE_STORE

OUT = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("iter", T.LongType())] + [
    T.StructField(c, T.DoubleType()) for c in (
        "batches_per_sec", "samples_per_sec", "device_batches_per_sec", "device_samples_per_sec", "tokens_per_sec",
        "device_tokens_per_sec", "total_tokens", "train_loss", "train_ppl")] + [T.StructField("late", T.LongType())])


class RunMonitor(StatefulProcessor):
    """``rows``: run_id, time in microseconds, loss."""

    def __init__(self, window: int, log_n: int, world: int, micro_batch: int, seq_len: int):
        self.window, self.log_n, self.world = window, log_n, world
        self.micro, self.seq = micro_batch, seq_len

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "iters long, first long, last long, late long")
        self.ring = handle.getListState("ring", "at long")
        self.losses = handle.getListState("losses", "loss double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat([p[["us", "loss"]] for p in rows]).sort_values("us", kind="stable")
        us, loss = pdf["us"].to_numpy(np.int64), pdf["loss"].to_numpy(np.float64)
        iters, first, last, late = self.place.get() if self.place.exists() else (0, None, None, 0)
        if last is not None:
            fresh = us > last
            late += int((~fresh).sum())
            us, loss = us[fresh], loss[fresh]
        if not len(us):
            self.place.update((iters, first, last, late))
            return
        first = int(us[0]) if first is None else first
        ring = np.array([x[0] for x in self.ring.get()], np.int64) if self.ring.exists() else np.zeros(0, np.int64)
        old = np.array([x[0] for x in self.losses.get()], np.float64) if self.losses.exists() else np.zeros(0)
        yield self._metrics(key[0], iters, first, late, ring, us, old, loss)
        self.ring.put([(int(x),) for x in np.concatenate([ring, us])[-(self.window + 1):]])
        self.losses.put([(float(x),) for x in np.concatenate([old, loss])[-self.log_n:]])
        self.place.update((iters + len(us), first, int(us[-1]), late))

    def _metrics(self, run, iters, first, late, ring, us, old, loss) -> pd.DataFrame:
        w, it = self.window, iters + np.arange(len(us), dtype=np.int64)
        points = np.concatenate([ring, us])
        full = it >= w
        at = np.flatnonzero(full) + len(ring)
        wct = (points[at] - first) / 1e6 - (points[at - w] - first) / 1e6
        samples = w * self.micro
        with np.errstate(divide="ignore", invalid="ignore"):
            batches = w / wct
            device = samples / wct
        values = np.concatenate([old, loss])
        ends = np.flatnonzero(full) + len(old)
        # at most ``log_n`` losses a row: a window of the padded series, not of the run
        padded = np.concatenate([np.zeros(self.log_n - 1), values])
        n = np.minimum(it[full] + 1, self.log_n)
        total = np.lib.stride_tricks.sliding_window_view(padded, self.log_n)[ends].sum(axis=1)
        mean = total / n
        length = float(self.seq)
        out = {"run_id": run, "iter": it[full], "batches_per_sec": batches * self.world, "samples_per_sec": device * self.world,
               "device_batches_per_sec": batches, "device_samples_per_sec": device, "tokens_per_sec": device * self.world * length,
               "device_tokens_per_sec": device * length, "total_tokens": length * self.world * self.micro * (it[full] + 1.0),
               "train_loss": mean, "train_ppl": np.exp(mean), "late": np.full(len(at), late, np.int64)}
        return pd.DataFrame(out, columns=OUT.names)


def monitor_stream(events: DataFrame, window: int, log_n: int, world_size: int = 1, micro_batch: int = 16,
                   seq_len: int = 2048) -> DataFrame:
    """Rolling metrics per row of a stream ``(run_id, us, loss)``, in append mode."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    ship_package(spark)
    return events.select("run_id", "us", "loss").groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=RunMonitor(window, log_n, world_size, micro_batch, seq_len), outputStructType=OUT,
        outputMode="Append", timeMode="None")
