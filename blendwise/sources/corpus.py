"""Corpus readers: JSONL/parquet documents, file subsets, source labels, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blendwise.functions.prefix import prefix_rank
from blendwise.session import cut_lineage as materialized
from blendwise.sources.tables import QA_TASKS

TEXT_SCHEMA = T.StructType([T.StructField("text", T.StringType(), True)])
QA_SCHEMA = T.StructType([
    T.StructField("question", T.StringType(), True),
    T.StructField("answer", T.StringType(), True),
])


def read_corpus(spark: SparkSession, path: str | list[str], split: str | None = None, fmt: str = "json") -> DataFrame:
    """One row per document with ``text`` and the ``file`` it came from.

    Only ``text`` is read (explicit schema, no inference).  Rows whose text is
    null carry no tokens and are dropped here.
    """
    reader = spark.read.schema(TEXT_SCHEMA)
    df = reader.json(path) if fmt == "json" else reader.format(fmt).load(path)
    # a file that Spark wrote is a folder of parts: its name is the folder's
    path_of = F.regexp_replace("_metadata.file_path", r"/(?:file=)?([^/]*\.jsonl?)/part-[^/]*$", "/$1")
    df = df.select("text", path_of.alias("file")).filter(F.col("text").isNotNull())
    if split is not None:
        df = df.withColumn("split", F.lit(split))
    return df


def file_fraction(df: DataFrame, pct: float, file: str = "file") -> DataFrame:
    """Keep the rows of the first ``floor(n_files * pct)`` files in name order.

    The distinct file list is one row per file; the kept list is joined back
    with a left-semi join (AQE broadcasts it when it is small).
    """
    files = df.select(file).distinct()
    # rank by name without one task for all names: names are dealt into ranges, ranges are counted
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = materialized(files.repartitionByRange(parts, file).select(file, F.spark_partition_id().alias("_part")))
    ranked = prefix_rank(ranged, [], ["_part", file], "_r", bucket=F.col("_part"), total="_n")
    keep = ranked.filter(F.col("_r") <= F.floor(F.col("_n") * F.lit(float(pct)))).select(file)
    return df.join(keep, file, "left_semi")


def file_stem(path: F.Column) -> F.Column:
    """File name without folders, cut at its first '.'."""
    return F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), r"^([^.]*)", 1)


def with_source(df: DataFrame, short_name: str, file: str = "file", out: str = "source") -> DataFrame:
    """S3: source label ``short_name + '_' + stem(file)``."""
    return df.withColumn(out, F.concat(F.lit(short_name + "_"), file_stem(F.col(file))))


def split_rows(df: DataFrame, split: str, col: str = "split") -> DataFrame:
    """The rows of one split (a partition filter on partitioned data)."""
    if split not in ("train", "valid"):
        raise ValueError(f"split must be 'train' or 'valid', got {split!r}")
    return df.filter(F.col(col) == F.lit(split))


def read_qa(spark: SparkSession, directory: str, tasks: list[str] | None = None) -> DataFrame:
    """question/answer pairs of ``{task}_sft.jsonl`` files; missing files are skipped.

    Returns (task, pair_id, question, answer); ``pair_id`` is the line's
    position key (file offset order), stable across re-reads.
    """
    from pyspark.errors import AnalysisException

    pattern = f"{directory.rstrip('/')}/{{{','.join(tasks or QA_TASKS)}}}_sft.jsonl"  # whichever of them exist
    try:
        df = spark.read.schema(QA_SCHEMA).json(pattern)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        raise FileNotFoundError(f"no question/answer files under {directory}") from e
    # a task file may also be a folder of part files written by Spark
    task = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)_sft\.jsonl(/|$)", 1)
    return df.select(
        task.alias("task"),
        F.monotonically_increasing_id().alias("pair_id"),
        F.coalesce("question", F.lit("")).alias("question"),
        F.coalesce("answer", F.lit("")).alias("answer"),
    )
