"""Mixture history and metric tables: append, latest, merge, step-merge, log rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blendwise.operators.mixture import softmax


def append_history(state: DataFrame, path: str) -> None:
    """Append the logits of a search step, partitioned by run."""
    state.write.mode("append").partitionBy("run_id").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _files(spark: SparkSession, path: str):
    """Hadoop file system and path, as Spark itself resolves them (any scheme that Spark can write)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def commit_step(table: DataFrame, path: str, step: int) -> str:
    """S9 for a loop: the table of one step as a folder of its own, written as one job whose marker comes last.

    A step that is run again replaces its folder, so rows never double; a folder whose job did not finish has no
    marker and does not count."""
    folder = f"{path}/step={step:012d}"
    table.drop("step").write.mode("overwrite").parquet(folder)
    return folder


def committed_steps(spark: SparkSession, path: str) -> list[int]:
    """Steps whose folder has its marker, in order."""
    fs, p = _files(spark, path)
    if not fs.exists(p):
        return []
    names = [(s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(p)]
    return sorted(int(n[len("step="):]) for n, full in names
                  if n.startswith("step=") and fs.exists(_files(spark, f"{full}/_SUCCESS")[1]))


def read_step(spark: SparkSession, path: str, step: int) -> DataFrame:
    """One step's table; only its folder is listed."""
    return spark.read.parquet(f"{path}/step={step:012d}").withColumn("step", F.lit(step).cast("bigint"))


def read_steps(spark: SparkSession, path: str) -> DataFrame:
    """All committed steps."""
    done = committed_steps(spark, path)
    if not done:
        raise FileNotFoundError(f"no committed step under {path}")
    d = spark.read.option("basePath", path).parquet(*[f"{path}/step={s:012d}" for s in done])
    return d.withColumn("step", F.col("step").cast("bigint"))


def keep_newest(spark: SparkSession, path: str) -> list[int]:
    """E4 on the folders: only the newest committed step stays; unfinished older ones go too.  Returns what went."""
    done = committed_steps(spark, path)
    if not done:
        return []
    fs, p = _files(spark, path)
    gone = []
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if name.startswith("step=") and int(name[len("step="):]) < done[-1]:
            fs.delete(s.getPath(), True)
            gone.append(int(name[len("step="):]))
    return sorted(gone)


def latest_state(history: DataFrame, keys: Sequence[str] = ("run_id",), step: str = "step") -> DataFrame:
    """The rows of the latest step per run (``max(step)`` then a semi join;
    partition pruning applies when ``history`` is partitioned by run)."""
    last = history.groupBy(*keys).agg(F.max(step).alias(step))
    return history.join(last, [*keys, step], "left_semi")


def merge_state(init: DataFrame, saved: DataFrame, keys: Sequence[str] = ("run_id", "source"),
                cols: Sequence[str] = ("z", "m", "v", "t")) -> DataFrame:
    """Saved values over a fresh state; sources missing from the saved
    state keep their initial value, saved sources unknown to ``init`` are ignored."""
    s = saved.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in cols])
    j = init.join(s, list(keys), "left")
    for c in cols:
        j = j.withColumn(c, F.coalesce(F.col(f"_s_{c}"), F.col(c))).drop(f"_s_{c}")
    return j


def merge_by_step(metrics: DataFrame, keys_list: Sequence[str], run_keys: Sequence[str] = ("run_id",),
                  step: str = "step", seq: str = "seq") -> DataFrame:
    """One row per (run, step); columns = the metric keys (sorted); within
    a step the last value (highest ``seq``) of a key wins; ordered by step."""
    keys_sorted = sorted(keys_list)
    wide = metrics.groupBy(*run_keys, step).pivot("key", keys_sorted).agg(F.max_by("value", seq))
    return wide.orderBy(*run_keys, step)


def log_mixture(state: DataFrame, prefix: str = "probs_softmax/", source: str = "source") -> DataFrame:
    """Per-source probabilities of a state as long metric rows."""
    p = softmax(state)
    return p.select("run_id", "step", F.concat(F.lit(prefix), F.col(source)).alias("key"), F.col("p").alias("value"))
