"""Session set-up and the few cluster-facing helpers every module shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "blendwise") -> SparkSession:
    """Session for tests and the bench; on a cluster use the one spark-submit gives you."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # iterative steps read persisted blocks: do not hold tasks back for locality
        .config("spark.locality.wait", os.environ.get("BLENDWISE_LOCALITY_WAIT", "0s"))
        .config("spark.driver.memory", os.environ.get("BLENDWISE_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; only when nothing is set
    (local tests) a fresh temporary folder is used.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="blendwise-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the shared checkpoint folder."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss).

    The frame is persisted first so that writing the checkpoint reads the
    computed rows instead of running the plan a second time."""
    from pyspark import StorageLevel

    checkpoint_root(df.sparkSession)
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = df.checkpoint(eager=True)
    df.unpersist()
    return out


def small_broadcast(df: DataFrame, max_rows: int, known_rows: int | None = None) -> DataFrame:
    """Broadcast hint only behind a size bound.

    ``known_rows`` is the size of a table built on the driver from configuration
    (a mixture, device or shape list).  Without it the table is counted; a
    table above ``max_rows`` is returned unhinted and AQE decides at run time
    from the real shuffle size.
    """
    n = known_rows if known_rows is not None else df.count()
    if n <= max_rows:
        return F.broadcast(df)
    return df


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row (broadcast
    equi join on a constant; the small side is one row by construction)."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one").drop("_one")


def spread_input(df: DataFrame, key: str, factor: int = 2) -> DataFrame:
    """Hash-repartition a scan that has fewer splits than ``factor`` x the
    cluster's parallelism (e.g. a file with one row group), so per-row work
    such as tokenizing runs on every core.  Large inputs are left as they are."""
    sc = df.sparkSession.sparkContext
    target = factor * sc.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target, key)
    return df


def reuse(df: DataFrame) -> DataFrame:
    """Keep a frame that several branches of one plan read (memory, spilling
    to disk).  Lost blocks are recomputed from lineage; use :func:`cut_lineage`
    where the lineage itself must end."""
    from pyspark import StorageLevel

    return df.persist(StorageLevel.MEMORY_AND_DISK)


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Let a batch between Spark and Python hold at most ``rows`` rows: one of whole texts stands in memory four times
    (both ways, on both sides), and ten thousand long texts are too much."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))


class PeriodicCut:
    """Iterated tables: persist and materialize each new version, write a
    reliable checkpoint every ``every`` versions (so lineage and plan size stay
    bounded), and release the version it replaces."""

    def __init__(self, every: int = 5):
        self.every = max(1, every)
        self.n = 0
        self.prev: DataFrame | None = None

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        if self.n % self.every == 0:
            out = cut_lineage(df)
        else:
            out = reuse(df)
            out.count()
        if self.prev is not None:
            self.prev.unpersist()
        self.prev = out
        return out


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``blendwise`` importable in Python workers (``addPyFile`` of a zip of
    the package, as ``--py-files`` does at submit time).  Needed by operators
    that run Python inside tasks (packed files, streaming pack).  The zip is a
    driver-side artifact; Spark copies it to every executor."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import zipfile

    import blendwise

    pkg_dir = os.path.dirname(os.path.abspath(blendwise.__file__))
    out_dir = tempfile.mkdtemp(prefix="blendwise-pyfiles-")
    zpath = os.path.join(out_dir, "blendwise.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(zpath)
    _SHIPPED.add(sc.applicationId)
