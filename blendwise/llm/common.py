"""Helpers shared by the operators: tables, scratch tables, batches, word hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blendwise.session import scratch_path, ship_package, small_batches
from blendwise.sources.tables import table

__all__ = ["table", "materialize", "row_slices", "word_hashes", "mix64", "splits_for", "fresh", "ship_package",
           "text_digest", "map_arrow", "frequent_keys", "give_back", "small_batches"]

SLICE_BYTES = 4 << 20  # Python works on at most this many text bytes at a time (or on one longer text)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps do not
    depend on executors that computed it, and nothing is computed twice."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (case-insensitive, as Spark resolves names)."""
    have = {c.lower() for c in df.columns}
    name, i = stem, 0
    while name.lower() in have:
        i += 1
        name = f"{stem}{i}"
    return name


def text_digest(c: Column) -> Column:
    """16-byte key of a text (null: of the empty text)."""
    return F.unhex(F.md5(F.coalesce(c, F.lit(""))))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` whose worker, which lives on for the next stage, gives freed memory back when a task is done."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system (no-op where the C library cannot)."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def frequent_keys(counts: DataFrame, times: str, least: int, total: str | None = None) -> DataFrame:
    """``(part, key[, total])`` of the keys that occur ``least`` times in all parts together.  ``counts`` has one row per part
    and key, so a key that every row holds is as many rows as there are parts; the window spills."""
    w = Window.partitionBy("key")
    d = counts.withColumn("_total", F.sum(times).over(w)).filter(F.col("_total") >= least)
    return d.select("part", "key", F.col("_total").alias(total)) if total else d.select("part", "key")


def splits_for(spark: SparkSession, total: int | None, per_split: int) -> int:
    """Number of partitions or key ranges for ``total`` units of data, at least the session's parallelism."""
    return max(int(spark.sparkContext.defaultParallelism), -(-int(total or 0) // per_split), 1)


def row_slices(batches: Iterable[pa.RecordBatch | pa.Table], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of a slice hold at most ``limit`` bytes (at least one row each)."""
    for big in batches:
        for batch in big.to_batches() if isinstance(big, pa.Table) else [big]:
            n = batch.num_rows
            if not n:
                continue
            sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
            cum = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < n:
                base = cum[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(cum, base + limit, side="right")))
                yield batch.slice(lo, hi - lo)
                lo = hi


_BLOCK = 1 << 20
# Fixed odd multipliers; any odd constants would do.
_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """base**j and base**-j mod 2**64 for j < n."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, _BLOCK + 1)
        base = _BASE[which]
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            p = np.empty(size, np.uint64)
            p[0] = 1
            done = 1
            while done < size:  # doubling: p[done:2*done] = p[:done] * b**done
                take = min(done, size - done)
                p[done:done + take] = p[:take] * np.uint64(pow(b, done, 1 << 64))
                done += take
            out.append(p)
        have = _POWERS[which] = (out[0], out[1])
    return have


def mix64(h: np.ndarray) -> np.ndarray:
    """Bit mixer (the public splitmix64 finaliser): every input bit moves every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


# Word separators [\x20\x09-\x0D].
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


# Separators of plain words after A-Z are lower-cased: [\x00-\x2F\x3A-\x60\x7B-\x7F].
_NOT_PLAIN = np.zeros(256, bool)
_NOT_PLAIN[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def word_hashes(texts: list[bytes | None], which: int = 0, lower: bool = False, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, and the
    first word of each text (``len(texts) + 1`` offsets).  ``lower`` folds A-Z only;
    ``plain`` takes words of ASCII letters, digits and non-ASCII characters instead (with ``lower``)."""
    data = b"\n".join([t or b"" for t in texts]) + b"\n"
    lengths = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    if lower:
        data = data.lower()  # bytes.lower() folds ASCII letters only
    buf = np.frombuffer(data, np.uint8)
    space = (_NOT_PLAIN if plain else _SPACE)[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    first = np.concatenate(([0], np.cumsum(lengths + 1)))
    word0 = np.searchsorted(starts, first)
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):  # blocks of whole words
        origin = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, origin + _BLOCK, side="right")))
        stop = ends[hi - 1]
        power, inverse = _powers(int(stop - origin) + 1, which)
        run = np.zeros(int(stop - origin) + 1, np.uint64)
        np.cumsum((buf[origin:stop].astype(np.uint64) + np.uint64(1)) * power[: stop - origin], out=run[1:])
        s, e = starts[lo:hi] - origin, ends[lo:hi] - origin
        out[lo:hi] = mix64((run[e] - run[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(_BASE[1 - which]))
        lo = hi
    return out, word0


def window_hashes(h: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hash of every ``width`` consecutive entries of ``h`` (windows may cross text borders; callers mask those)."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    out = np.empty(len(h) - width + 1, np.uint64)
    step = _BLOCK
    for lo in range(0, len(out), step):
        part = h[lo:lo + step + width - 1]
        power, inverse = _powers(len(part) + 1, which)
        run = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * power[: len(part)], out=run[1:])
        n = len(part) - width + 1
        out[lo:lo + n] = mix64((run[width:] - run[:n]) * inverse[:n])
    return out
