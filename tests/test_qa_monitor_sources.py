"""Question/answer target (Q1-Q6, L11), run metrics (R1-R9, E1-E5) and sources."""

import json
import os
import struct
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from blendwise.operators import evaluate as ev
from blendwise.operators import monitor as mon
from blendwise.operators import qa
from blendwise.sources import config as cf
from blendwise.sources import corpus as cp
from blendwise.sources import history as hs
from blendwise.sources import packed as pf


def _items(spark, n, answer="b c"):
    rows = [(t, i, f"q{i} w", answer) for i, t in zip(range(n), ["hellaswag", "piqa"] * n)]
    d = spark.createDataFrame(rows, "task string, pair_id long, question string, answer string")
    return qa.qa_targets(qa.union_shuffled(d, 3), 64)


def test_targets_mask_question_and_last(spark):
    it = _items(spark, 1).first()
    # ids: [q, w, b, c]; question has 2 tokens -> targets [-100, b, c, -100]
    assert it.qlen == 2
    assert it.targets == [-100, it.ids[2], it.ids[3], -100]
    empty = _items(spark, 1, answer="").first()
    assert empty.targets == [-100, -100]


@pytest.mark.parametrize("n", [15, 16, 17])
def test_qa_gradient_batches(spark, n):
    items = _items(spark, n)
    if n < 16:
        with pytest.raises(ValueError):
            qa.qa_gradient(items)
        return
    g = qa.qa_gradient(items).q.toPandas()
    # brute force of the reference arithmetic
    rows = items.orderBy("qa_order").collect()
    acc = {}
    for b in range(0, n, 16):
        batch = rows[b:b + 16]
        pairs = [(u, v) for r in batch for u, v in zip(r.ids, r.targets) if v != -100]
        for u, v in pairs:
            acc[(u, v)] = acc.get((u, v), 0.0) + 1.0 / (len(pairs) * len(batch))
    exp = {k: v / (n // 16) for k, v in acc.items()}
    got = {(r.u, r.v): r.q for r in g.itertuples()}
    assert got.keys() == exp.keys()
    assert all(abs(got[k] - exp[k]) < 1e-15 for k in exp)


def test_sample_per_task_and_batches(spark):
    d = spark.createDataFrame([(t, i, "q", "a") for i in range(30) for t in ["x"]] + [("y", 100, "q", "a")],
                              "task string, pair_id long, question string, answer string")
    s = qa.sample_per_task(d, 10, 1).groupBy("task").count().toPandas().set_index("task")["count"]
    assert s["x"] == 10 and s["y"] == 1
    b = qa.qa_batches(_items(spark, 17)).orderBy("batch").toPandas()
    assert list(b["n_items"]) == [16, 1]


def test_pairs_from_conversations(spark):
    conv = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q1"), (1, 2, "assistant", "a1"),
                                  (1, 3, "user", "q2"), (2, 0, "user", "q3"), (2, 1, "user", "q4")],
                                 "conv_id long, turn long, role string, text string")
    p = qa.pairs_from_conversations(conv).collect()
    assert [(r.question, r.answer, r.task) for r in p] == [("q1", "a1", "arc_challenge")]


def _log(spark, n=12):
    rows = [("r", i, float(i * i), 16 * (i + 1), 2048 * (i + 1), float(i) / 10, 1.0) for i in range(n)]
    return spark.createDataFrame(rows, "run_id string, iter long, elapsed double, samples long, lengths long, loss double, value double")


def test_throughput_window_and_rolling_loss(spark):
    t = mon.throughput(_log(spark), 2, world_size=2).orderBy("iter").toPandas()
    assert list(t["iter"]) == list(range(2, 12))  # only once window + 1 points exist
    i = 5
    wct = i * i - (i - 2) ** 2
    row = t[t["iter"] == i].iloc[0]
    assert abs(row["batches_per_sec"] - 2 * 2 / wct) < 1e-12
    assert abs(row["tokens_per_sec"] - 32 * 2 / wct * 2048) < 1e-9
    r = mon.rolling_loss(_log(spark), 3).orderBy("iter").toPandas()
    exp = [np.mean([j / 10 for j in range(max(0, k - 2), k + 1)]) for k in range(12)]
    assert np.allclose(r["train_loss"], exp)


def test_elapsed_units_eta_every(spark):
    with pytest.raises(ValueError):
        mon.elapsed(_log(spark), "weeks")
    e = mon.elapsed(_log(spark), "minutes", eval_col="value").orderBy("iter").toPandas()
    assert abs(e.iloc[3]["time_val"] - 4 / 60) < 1e-12
    assert mon.every(_log(spark), 5).count() == 3
    eta = mon.eta(_log(spark), 100).orderBy("iter").toPandas()
    assert abs(eta.iloc[4]["remaining_hours"] - 16.0 / 5 * 95 / 3600) < 1e-12


def test_mfu_from_shapes_and_peaks(spark):
    m = mon.mfu(_log(spark), mon.shapes_table(spark), mon.devices_table(spark), "tinyllama_1M", "a100", "bf16-mixed", 2, 16)
    r = m.orderBy("iter").first()
    L, E, B = 2, 256, 2048
    n = mon.llama_params(L, E, 50432, 512)
    fpb = 16 * (3 * (2 * n * B + 4 * L * E * B * B) + 2 * (4 * L * E * B * B))
    assert abs(r["mfu"] - 2 * fpb / 4.0 / 312e12) < 1e-18


def test_validate_divides_by_eval_iters(spark):
    bl = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0)], "lang string, batch long, loss double")
    assert ev.validate(bl, 4, ["lang"]).first()["val_loss"] == 1.0
    assert ev.validate(bl, 4, ["lang"], true_mean=True).first()["val_loss"] == 2.0


def test_task_score_retention_loss_by_source(spark):
    res = spark.createDataFrame([("r", 0, "a", 0.5), ("r", 0, "b", 0.25), ("r", 0, "zzz", 9.0)],
                                "run_id string, step long, task string, score double")
    s = ev.task_score(res, ["a", "b", "c"]).first()
    assert s["perf"] == 0.75 and s["loss"] == -0.75 and s["n_tasks"] == 2
    st = spark.createDataFrame([("r", "x", 1), ("r", "y", 3), ("r", "z", 2)], "run_id string, name string, mtime long")
    kept = [r.name for r in ev.retention(st).filter("keep").collect()]
    assert kept == ["y"]
    losses = spark.createDataFrame([("train", "a", 1.0, 1), ("train", "b", 3.0, 3), ("valid", "a", 2.0, 2)],
                                   "split string, source string, loss double, n long")
    lb = ev.loss_by_source(losses).toPandas()
    total = lb[lb["split"].isna()].iloc[0]
    assert abs(total["loss"] - (1 + 9 + 4) / 6) < 1e-12


def test_history_merge_latest_and_metric_table(spark, tmp_path):
    st = spark.createDataFrame([("r", 0, "a", 1.0), ("r", 0, "b", 2.0)], "run_id string, step long, source string, z double")
    path = str(tmp_path / "hist")
    hs.append_history(st, path)
    hs.append_history(st.withColumn("step", F.lit(5).cast("long")).withColumn("z", F.col("z") + 1), path)
    latest = hs.latest_state(hs.read_history(spark, path)).orderBy("source").toPandas()
    assert list(latest["step"]) == [5, 5] and list(latest["z"]) == [2.0, 3.0]
    init = spark.createDataFrame([("r", "a", 0.0, 0.0, 0.0, 0), ("r", "c", 0.0, 0.0, 0.0, 0)],
                                 "run_id string, source string, z double, m double, v double, t long")
    merged = {r.source: r.z for r in hs.merge_state(init, latest.assign(m=0.0, v=0.0, t=1).pipe(spark.createDataFrame)).collect()}
    assert merged == {"a": 2.0, "c": 0.0}
    m = spark.createDataFrame([("r", 1, "loss", 1.0, 1), ("r", 1, "loss", 2.0, 2), ("r", 1, "acc", 0.5, 1), ("r", 0, "acc", 0.1, 0)],
                              "run_id string, step long, key string, value double, seq long")
    wide = hs.merge_by_step(m, ["loss", "acc"]).collect()
    assert [r.step for r in wide] == [0, 1]
    assert wide[1]["loss"] == 2.0 and wide[0]["loss"] is None and wide[1].__fields__[2:] == ["acc", "loss"]


def test_read_mixture_config(spark, tmp_path):
    p = tmp_path / "mix.yaml"
    p.write_text("train:\n  src_a: 1.0\n  src_b: 3\nvalid:\n  valid_a: 1.0\nseed: 42\ndata_seed: 7\nmicro_batch_size: 4\n")
    cfg = cf.read_mixture(spark, str(p))
    rows = cfg.mixture.orderBy("split", "group_id").collect()
    assert [(r.split, r.group_id, r.source, r.weight) for r in rows] == [
        ("train", 0, "src_a", 1.0), ("train", 1, "src_b", 3.0), ("valid", 0, "valid_a", 1.0)]
    assert cfg.data_seed == 7 and cfg.overrides["seed"] == 42


def _chunks(spark, n=2, size=12, source="s"):
    rows = [(source, i, list(range(1 + size * i, 1 + size * (i + 1)))) for i in range(n)]
    return spark.createDataFrame(rows, "source string, chunk_id long, tokens array<int>")


def test_packed_files_u16_i32_and_bad_magic(spark, tmp_path):
    d = str(tmp_path)
    pf.write_packed_files(_chunks(spark), os.path.join(d, "u16"), vocab_size=1000, chunk_size=12)
    pf.write_packed_files(_chunks(spark), os.path.join(d, "i32"), vocab_size=100000, chunk_size=12)
    for sub, width in (("u16", 2), ("i32", 4)):
        f = sorted(x for x in os.listdir(os.path.join(d, sub)) if x.endswith(".bin"))
        assert f == ["train_s_0_0000000000.bin", "train_s_0_0000000001.bin"]
        raw = open(os.path.join(d, sub, f[0]), "rb").read()
        assert raw[:7] == b"LITPKDS" and struct.unpack("<Q", raw[16:24])[0] == 12
        assert len(raw) == 24 + 12 * width
        b = pf.read_packed_files(spark, "file:" + os.path.join(d, sub), 5).orderBy("file", "block_in_chunk").collect()
        assert [r.tokens for r in b] == [[1, 2, 3, 4, 5], [6, 7, 8, 9, 10], [13, 14, 15, 16, 17], [18, 19, 20, 21, 22]]
        assert [(r.split, r.source, r.process_id, r.chunk_id) for r in b][::2] == [("train", "s", 0, 0), ("train", "s", 0, 1)]
    bad = os.path.join(d, "bad")
    os.makedirs(bad)
    with open(os.path.join(bad, "x.bin"), "wb") as fh:
        fh.write(b"NOTPKDS" + b"\0" * 40)
    with pytest.raises(Exception, match="wrong magic bytes"):
        pf.read_packed_files(spark, bad, 4).collect()


def test_a_large_packed_file_is_read_by_several_tasks(spark, tmp_path):
    d = str(tmp_path / "big")
    size, block = 40_000, 7
    pf.write_packed_files(_chunks(spark, 1, size), d, vocab_size=100000, chunk_size=size)
    df = pf.read_packed_files(spark, d, block, partition_bytes=10_000)  # 160,024 bytes
    assert df.rdd.getNumPartitions() == 17
    rows = df.orderBy("block_in_chunk").collect()
    assert [r.block_in_chunk for r in rows] == list(range(size // block))
    assert [x for r in rows for x in r.tokens] == list(range(1, 1 + size // block * block))
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() == 16  # the last 24 bytes begin no block
    many = [(f"f{i}", 3000) for i in range(1000)]
    dealt = pf.deal_ranges(many, 64 << 20)
    assert len(dealt) < 20 and sorted(r for x in dealt for r in x.ranges) == sorted((f, 0, 3000) for f, _ in many)


def test_small_packed_files_reach_spark_in_few_batches(spark, tmp_path):
    d = str(tmp_path / "small")
    pf.write_packed_files(_chunks(spark, 40, 12), d, vocab_size=1000, chunk_size=12)
    reader = pf.PackedReader({"path": d, "blockSize": "4"})
    parts = reader.partitions()
    batches = [b for p in parts for b in reader.read(p)]
    assert len(parts) == len(batches) == 1 and batches[0].num_rows == 120
    assert pf.read_packed_files(spark, d, 4).select("chunk_id", "block_in_chunk").distinct().count() == 120


def test_packed_files_are_pruned_by_name(spark, tmp_path):
    d = str(tmp_path / "pruned")
    for source in ("a", "b", "a_b"):
        pf.write_packed_files(_chunks(spark, 2, 12, source), d, vocab_size=1000, chunk_size=12)
    with open(os.path.join(d, "train_c_0_0000000000.bin"), "wb") as f:
        f.write(b"a broken file that must not be opened")
    got = pf.read_packed_files(spark, d, 4).filter(F.col("source").isin("a", "a_b") & (F.col("chunk_id") == 1))
    assert sorted({r.file for r in got.collect()}) == ["train_a_0_0000000001.bin", "train_a_b_0_0000000001.bin"]
    reader = pf.PackedReader({"path": d, "blockSize": "4"})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    other = GreaterThan(("block_in_chunk",), 1)
    assert list(reader.pushFilters([EqualTo(("source",), "a"), other])) == [other]
    assert [r[0].rsplit("/", 1)[1] for p in reader.partitions() for r in p.ranges] == ["train_a_0_0000000000.bin", "train_a_0_0000000001.bin"]


def test_failed_and_repeated_writes_leave_nothing_visible(spark, tmp_path, monkeypatch):
    d = str(tmp_path / "sink")
    good, bad = _chunks(spark, 6), spark.createDataFrame([("s", 99, [1, 2])], "source string, chunk_id long, tokens array<int>")
    with pytest.raises(Exception, match="expected 12"):
        pf.write_packed_files(good.unionByName(bad).repartition(7), d, vocab_size=1000, chunk_size=12)
    # other tasks had written theirs, and one that outlives the job may leave its attempt hidden, but nothing is in place
    assert [x for x in os.listdir(d) if x != "_temporary"] == []
    assert pf.PackedReader({"path": d, "blockSize": "3"}).partitions() == []
    # two attempts of a task: only the one that is committed appears
    import pyarrow as pa
    from pyspark import TaskContext

    class Context:
        attempt = 0

        def partitionId(self):
            return 0

        def taskAttemptId(self):
            Context.attempt += 1
            return Context.attempt

    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: Context()))
    writer = pf.PackedWriter({"path": d, "chunkSize": "3", "vocabSize": "1000"}, False)
    batch = pa.RecordBatch.from_arrays([pa.array(["train"]), pa.array(["s"]), pa.array([0]), pa.array([5]), pa.array([[7, 8, 9]])],
                                       ["split", "source", "process_id", "chunk_id", "tokens"])
    first, second = writer.write(iter([batch])), writer.write(iter([batch]))
    assert first.folder != second.folder and pf.PackedReader({"path": d, "blockSize": "3"}).partitions() == []
    writer.commit([second])
    assert sorted(x for x in os.listdir(d) if x != "_temporary") == ["_SUCCESS", "train_s_0_0000000005.bin"]
    monkeypatch.undo()
    pf.write_packed_files(_chunks(spark, 1, 3), d, vocab_size=1000, chunk_size=3, mode="overwrite")
    assert [r.file for r in pf.read_packed_files(spark, d, 3).collect()] == ["train_s_0_0000000000.bin"]


def test_read_qa_skips_missing_and_file_fraction(spark, tmp_path):
    with open(tmp_path / "piqa_sft.jsonl", "w") as f:
        f.write(json.dumps({"question": "q", "answer": "a"}) + "\n")
    q = cp.read_qa(spark, str(tmp_path)).collect()
    assert [(r.task, r.question) for r in q] == [("piqa", "q")]
    docs = spark.createDataFrame([(i, f"f{i % 7}") for i in range(70)], "doc_id long, file string")
    kept = cp.file_fraction(docs, 0.5).select("file").distinct().orderBy("file").collect()
    assert [r.file for r in kept] == ["f0", "f1", "f2"]
