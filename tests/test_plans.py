"""Plan shape: pruning reaches the scan, no single-partition exchange over
documents, small sides broadcast, no theta or cartesian joins (SURVEY section 5, item 5)."""

import re

from conftest import SF01


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _formatted(df) -> str:
    mode = df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_pack_reads_only_needed_columns_and_never_gathers(spark):
    import __spark_entry__ as e

    df = e.queries()["p2_pack"](spark, SF01)
    plan = _formatted(df)
    schemas = re.findall(r"ReadSchema: (struct<[^\n]*>)", plan)
    assert schemas and all("lang" not in s and "n_chars" not in s for s in schemas)
    assert "SinglePartition" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_pair_counts_aggregate_partially_before_the_shuffle(spark):
    import __spark_entry__ as e

    plan = _formatted(e.queries()["l1_pair_counts"](spark, SF01))
    assert "partial_count" in plan
    assert "SinglePartition" not in plan


def test_draws_broadcast_the_mixture_and_use_an_equi_join(spark):
    from pyspark.sql import functions as F

    from blendwise.operators import mixture as mx

    mix = spark.createDataFrame([(i, f"s{i}", 1.0 + i) for i in range(5)], "group_id int, source string, weight double")
    plan = _plan(mx.draw_sources(spark, 1000, mix, 3, mixture_rows=5))
    assert "BroadcastHashJoin" in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_prefix_match_is_an_equi_join(spark):
    from blendwise.operators import packing as pk

    files = spark.createDataFrame([("train_a_0_0000000001.bin",)], "file string")
    mix = spark.createDataFrame([("train_a",)], "prefix string")
    plan = _plan(pk.match_sources(files, mix))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_streaming_metrics_twin_prunes_columns(spark):
    import __spark_entry__ as e

    plan = _formatted(e.queries()["r10_metrics_stream"](spark, SF01))
    schemas = re.findall(r"ReadSchema: (struct<[^\n]*>)", plan)
    assert schemas and all("props" not in s and "user_id" not in s for s in schemas)


def test_per_task_sampling_limits_before_the_shuffle(spark):
    import __spark_entry__ as e

    plan = _plan(e.queries()["q1_sample_per_task"](spark, SF01))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def _exchanges(plan: str) -> list[str]:
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan.split("== Initial Plan ==")[0])


def test_packing_moves_ids_once(spark):
    """Texts are dealt by ranges of ids; offsets are added where they are, and only the chunks' pieces carry ids through an exchange."""
    import __spark_entry__ as e

    plan = _plan(e.queries()["p2_pack"](spark, SF01))
    keys = _exchanges(plan)
    assert sum(k.startswith("source") and "chunk_id" in k for k in keys) == 1
    assert len([k for k in keys if "doc_bucket" in k]) <= 2 and len(keys) <= 4, keys
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_mixing_plan_is_short(spark):
    import __spark_entry__ as e

    plan = _plan(e.queries()["m4_mix"](spark, SF01))
    assert plan.count("FileScan parquet") <= 3
    assert len(_exchanges(plan)) <= 8, _exchanges(plan)
