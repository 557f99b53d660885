"""Two-level running sums that never put one key into one task.

A plain ``sum(x) over (partition by source order by doc_id)`` sends a whole
source to a single task; a source may hold a third of the corpus.  Here the
order column is cut into buckets: per-(key, bucket) totals form a small
table whose running sum gives each bucket's base, and the running sum inside
a bucket is a window over (key, bucket), bounded by the bucket width.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blendwise.session import small_broadcast

DEFAULT_BUCKET_WIDTH = 1 << 16
# The table of bucket totals is broadcast up to this many rows, if its size is known.
BASE_BROADCAST_ROWS = 1 << 20


def prefix_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] | str,
    value: str | Column,
    out: str,
    bucket: Column | None = None,
    bucket_width: int = DEFAULT_BUCKET_WIDTH,
    inclusive: bool = True,
    total: str | None = None,
    base_rows: int | None = None,
    least: tuple[str, str] | None = None,
) -> DataFrame:
    """Add ``out`` = running sum of ``value`` within ``keys`` along ``order``.

    ``order`` must be unique within ``keys``; its first column is numeric and
    defines the bucket (``floor(order / bucket_width)``) unless ``bucket`` is
    given, which must be non-decreasing along ``order``.  ``total`` adds the
    per-key grand total.  ``base_rows`` is a known bound of the number of (key, bucket) pairs: a small base
    is broadcast, so that rows already partitioned by the bucket do not move; any other is joined by a shuffle.
    ``least=(column, name)`` adds the per-key minimum of a column, from the same bucket table.
    """
    keys = list(keys)
    order = [order] if isinstance(order, str) else list(order)
    val = F.col(value) if isinstance(value, str) else value
    b = bucket if bucket is not None else F.floor(F.col(order[0]) / F.lit(bucket_width))
    d = df.withColumn("_pb", b.cast("bigint")).withColumn("_pv", val)

    low = [F.min(least[0]).alias("_bm")] if least else []
    sums = d.groupBy(*keys, "_pb").agg(F.sum("_pv").alias("_bs"), *low)
    run = Window.partitionBy(*keys).orderBy("_pb").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("_base", F.coalesce(F.sum("_bs").over(run), F.lit(0)))
    cols = [*keys, "_pb", "_base"]
    if total:
        base = base.withColumn(total, F.sum("_bs").over(Window.partitionBy(*keys)))
        cols.append(total)
    if least:
        base = base.withColumn(least[1], F.min("_bm").over(Window.partitionBy(*keys)))
        cols.append(least[1])
    base = base.select(*cols)
    if base_rows is not None:
        base = small_broadcast(base, BASE_BROADCAST_ROWS, known_rows=base_rows)
    d = d.join(base, on=[*keys, "_pb"], how="inner")

    inner = (
        Window.partitionBy(*keys, "_pb")
        .orderBy(*[F.col(c) for c in order])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = F.col("_base") + F.sum("_pv").over(inner)
    if not inclusive:
        running = running - F.col("_pv")
    return d.withColumn(out, running).drop("_pb", "_pv", "_base")


def prefix_rank(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] | str,
    out: str,
    bucket: Column | None = None,
    bucket_width: int = DEFAULT_BUCKET_WIDTH,
    total: str | None = None,
    base_rows: int | None = None,
    least: tuple[str, str] | None = None,
) -> DataFrame:
    """1-based row number within ``keys`` along ``order`` (two-level, skew-safe)."""
    return prefix_sum(
        df, keys, order, F.lit(1).cast("bigint"), out, bucket=bucket,
        bucket_width=bucket_width, inclusive=True, total=total, base_rows=base_rows, least=least,
    )


def hashed_bucket(key: Column, bits: int = 16) -> Column:
    """Bucket for a 60-bit md5 ordering key: its top ``bits`` bits."""
    return F.shiftright(key, 60 - bits)
