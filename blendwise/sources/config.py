"""Mixture configuration file reader.

The file maps source names to weights under ``train`` and ``valid``; every
other top-level key is an override of a run setting (batch sizes, rates,
``data_seed``).  The key ``seed`` is kept in the overrides but is not the
data seed: only ``data_seed`` is.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MIXTURE_SCHEMA = T.StructType([
    T.StructField("split", T.StringType(), False),
    T.StructField("group_id", T.IntegerType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("weight", T.DoubleType(), False),
])

DEFAULT_DATA_SEED = 3406


@dataclass
class MixtureConfig:
    mixture: DataFrame
    n_sources: int
    overrides: dict = field(default_factory=dict)
    data_seed: int = DEFAULT_DATA_SEED


def parse_mixture(text: str) -> tuple[list[tuple[str, int, str, float]], dict]:
    """Rows ``(split, group_id, source, weight)`` in file order, plus overrides."""
    import yaml

    cfg = yaml.safe_load(text) or {}
    if not isinstance(cfg, dict):
        raise ValueError("mixture config must be a mapping")
    rows = []
    for split in ("train", "valid"):
        section = cfg.get(split) or {}
        for i, (name, w) in enumerate(section.items()):
            rows.append((split, i, str(name), float(w)))
    overrides = {k: v for k, v in cfg.items() if k not in ("train", "valid")}
    return rows, overrides


def read_mixture(spark: SparkSession, path: str) -> MixtureConfig:
    """The config file (or the folder of one that Spark wrote) as a K-row mixture table plus the overrides."""
    texts = spark.read.text(path, wholetext=True).collect()  # one configuration file
    rows, overrides = parse_mixture("".join(t.value for t in texts))
    if not rows:
        raise ValueError(f"{path}: no train or valid sources")
    df = spark.createDataFrame(rows, MIXTURE_SCHEMA)
    seed = int(overrides.get("data_seed", DEFAULT_DATA_SEED))
    return MixtureConfig(df, len(rows), overrides, seed)


def overrides_table(spark: SparkSession, config: MixtureConfig) -> DataFrame:
    """``(setting, value, data_seed, n_sources)``: one row per overridden run setting."""
    rows = [(k, str(v), config.data_seed, config.n_sources) for k, v in config.overrides.items()]
    return spark.createDataFrame(rows, "setting string, value string, data_seed bigint, n_sources bigint")
