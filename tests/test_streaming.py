"""Streaming pack (P11) equals the batch pack; streaming metrics (R10) drop late rows."""

import datetime as dt
import os
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from blendwise.operators import packing as pk
from blendwise.streaming.metrics_stream import metrics_stream
from blendwise.streaming.pack_stream import pack_stream, with_end_markers

SCHEMA = "doc_id long, source string, ids array<int>"


def _write_parts(spark, root, parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(os.path.join(root, f"part{i}"))
    return [os.path.join(root, f"part{i}") for i in range(len(parts))]


def _arrive(spark, src, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA + ", expected long").coalesce(1).write.parquet(os.path.join(src, f"batch={k}"))


def _run_pack(spark, root, C, B, remainder="keep", keys=("source",)):
    stream = spark.readStream.schema(SCHEMA + ", expected long, batch int").option("maxFilesPerTrigger", 1).parquet(os.path.join(root, "in"))
    q = (pack_stream(stream.drop("batch"), C, B, keys=keys, remainder=remainder).writeStream.format("parquet")
         .option("path", os.path.join(root, "out")).option("checkpointLocation", os.path.join(root, "ckpt"))
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(120)
    return _blocks(spark.read.schema("source string, chunk_id long, block_in_chunk long, tokens array<int>").parquet(os.path.join(root, "out")))


def _blocks(df):
    return sorted((r.source, r.chunk_id, r.block_in_chunk, list(r.tokens)) for r in df.collect())


def _documents(lengths, source=lambda i: "a" if i % 3 else "b"):
    rows, tok = [], 1
    for i, n in enumerate(lengths):
        rows.append((i, source(i), list(range(tok, tok + n)), None))
        tok += n
    return rows


@pytest.mark.parametrize("remainder", ["keep", "pad", "drop"])
@pytest.mark.parametrize("marker_first", [True, False])
def test_stream_pack_equals_batch_pack(spark, remainder, marker_first):
    rows = _documents([7, 30, 2, 55, 9, 13, 40, 1, 26, 18, 0, 16])
    ends = [(None, s, None, sum(r[1] == s for r in rows)) for s in ("a", "b")]
    C, B = 16, 4
    root = tempfile.mkdtemp(prefix="bw-stream-")
    # micro-batches arrive in document order; the end markers before or after all documents
    batches = [rows[:3], rows[3:7], rows[7:]]
    _arrive(spark, os.path.join(root, "in"), [ends, *batches] if marker_first else [*batches, ends])
    got = _run_pack(spark, root, C, B, remainder)
    batch = pk.pack(spark.createDataFrame([r[:3] for r in rows], SCHEMA), C, B, remainder=remainder)
    assert got == _blocks(batch.select("source", "chunk_id", "block_in_chunk", "tokens")) and got
    if remainder == "keep":
        assert sorted(x for r in got for x in r[3]) == sorted(x for r in rows for x in r[2])  # no id is lost


def test_stream_pack_without_markers_keeps_the_chunk_open(spark):
    rows = _documents([5, 4, 30], lambda i: "a")
    root = tempfile.mkdtemp(prefix="bw-open-")
    _arrive(spark, os.path.join(root, "in"), [rows])
    assert [len(r[3]) for r in _run_pack(spark, root, 16, 16)] == [16, 16]  # 7 ids wait for more
    more = [(3, "a", [1000, 1001], None), (None, "a", None, 4)]
    spark.createDataFrame(more, SCHEMA + ", expected long").coalesce(1).write.parquet(os.path.join(root, "in", "batch=1"))
    assert [len(r[3]) for r in _run_pack(spark, root, 16, 16)] == [16, 16, 9]
    late = [(4, "a", [2000], None), (None, "a", None, 5)]  # after the key was complete: its next chunk
    spark.createDataFrame(late, SCHEMA + ", expected long").coalesce(1).write.parquet(os.path.join(root, "in", "batch=2"))
    assert [(r[1], r[3]) for r in _run_pack(spark, root, 16, 16)][3:] == [(3, [2000])]


def test_stream_pack_restarts_from_its_checkpoint(spark):
    rows = _documents([12, 5, 33, 8, 21, 17, 9, 40], lambda i: "a")
    C, B = 16, 4
    root = tempfile.mkdtemp(prefix="bw-restart-")
    _arrive(spark, os.path.join(root, "in"), [rows[:4]])
    _run_pack(spark, root, C, B)  # first query: packs the first documents, keeps the open chunk in its state
    spark.createDataFrame([*rows[4:], (None, "a", None, 8)], SCHEMA + ", expected long").coalesce(1).write.parquet(os.path.join(root, "in", "batch=1"))
    got = _run_pack(spark, root, C, B)  # restarted from the checkpoint: state and offsets are recovered
    batch = pk.pack(spark.createDataFrame([r[:3] for r in rows], SCHEMA), C, B)
    assert got == _blocks(batch.select("source", "chunk_id", "block_in_chunk", "tokens"))


def test_files_of_a_large_table_arrive_in_few_batches(spark, monkeypatch):
    from blendwise.plans import source_queries as sq

    assert [-(-n // sq.files_per_batch(n)) for n in (1, 16, 17, 40, 128, 129, 2000, 12000)] == [1, 1, 2, 3, 8, 8, 8, 8]
    monkeypatch.setattr(sq, "PART_DOCS", 8)  # 125 files
    monkeypatch.setattr(sq, "MOST_BATCHES", 2)
    roots, scratch = [], sq.scratch_path
    monkeypatch.setattr(sq, "scratch_path", lambda *a: roots.append(scratch(*a)) or roots[-1])
    got = sq.p11_pack_stream(spark, "/root/testdata/sf0.001").collect()
    fs = spark._jvm.org.apache.hadoop.fs.Path(f"{roots[0]}/ckpt/commits")
    names = [x.getPath().getName() for x in fs.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(fs)]
    assert sorted(x for x in names if x.isdigit()) == ["0", "1"]
    assert sorted(got) == sorted(sq.p2_pack_per_file(spark, "/root/testdata/sf0.001").collect())


def test_end_markers_count_documents(spark):
    d = with_end_markers(spark.createDataFrame([r[:3] for r in _documents([3, 4, 5, 0])], SCHEMA))
    assert {(r.source, r.expected) for r in d.collect() if r.ids is None} == {("a", 2), ("b", 2)}


def test_metrics_stream_windows_and_late_rows(spark):
    root = tempfile.mkdtemp(prefix="bw-metrics-")
    t0 = dt.datetime(2024, 1, 1, 0, 0, 0)
    b1 = pd.DataFrame({"event_type": ["r"] * 3, "ts": [t0 + dt.timedelta(minutes=m) for m in (1, 2, 70)], "value": [0.0, 1.0, 2.0]})
    # arrives after the watermark passed the first window: dropped
    b2 = pd.DataFrame({"event_type": ["r", "r"], "ts": [t0 + dt.timedelta(minutes=3), t0 + dt.timedelta(minutes=200)], "value": [5.0, 1.0]})
    schema = "event_type string, ts timestamp, value double"
    spark.createDataFrame(b1, schema).coalesce(1).write.parquet(os.path.join(root, "in", "b=0"))
    stream = spark.readStream.schema(schema + ", b int").parquet(os.path.join(root, "in"))
    out = metrics_stream(stream.drop("b"), "1 hour", "10 minutes")
    q = (out.writeStream.format("memory").queryName("run_metrics").outputMode("append")
         .option("checkpointLocation", os.path.join(root, "ckpt")).start())
    q.processAllAvailable()
    spark.createDataFrame(b2, schema).coalesce(1).write.parquet(os.path.join(root, "in", "b=1"))
    q.processAllAvailable()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM run_metrics ORDER BY window_start").toPandas()
    first = got.iloc[0]
    assert first["batches"] == 2  # the late row at minute 3 was dropped
    assert abs(first["mean_loss"] - (0.0 + 0.6931471805599453) / 2) < 1e-12
    batch = metrics_stream(spark.createDataFrame(pd.concat([b1, b2]), schema), "1 hour").orderBy("window_start").toPandas()
    assert batch.iloc[0]["batches"] == 3  # the batch twin has no lateness


def test_monitor_equals_the_batch_operators_and_counts_late_rows(spark):
    from blendwise.operators import monitor as mon
    from blendwise.streaming.monitor_stream import OUT, monitor_stream

    root = tempfile.mkdtemp(prefix="bw-monitor-")
    schema = "run_id string, us long, loss double"
    rows = [(run, 1_000_000 * (i * i + 3 * i), float((i * 7) % 5)) for run in ("a", "b") for i in range(23)]

    def arrive(k, part):
        spark.createDataFrame(part, schema).repartition(2).write.parquet(os.path.join(root, "in", f"b={k}"))
        stream = spark.readStream.schema(schema + ", b int").parquet(os.path.join(root, "in"))
        q = (monitor_stream(stream, 3, 4, 2, 16, 8).writeStream.format("parquet").option("path", os.path.join(root, "out"))
             .option("checkpointLocation", os.path.join(root, "ckpt")).outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination(120)

    arrive(0, [r for r in rows if r[1] < 20_000_000])
    arrive(1, [r for r in rows if 20_000_000 <= r[1] < 25_000_000] + [("a", 5_000_000, 99.0)])  # one row too late
    arrive(2, [r for r in rows if r[1] >= 25_000_000])
    got = {(r.run_id, r.iter): r for r in spark.read.schema(OUT).parquet(os.path.join(root, "out")).collect()}
    log = spark.createDataFrame([(run, i, us / 1e6, 16 * (i + 1), 8 * (i + 1), loss) for run in ("a", "b")
                                 for i, (_, us, loss) in enumerate(r for r in rows if r[0] == run)],
                                "run_id string, iter long, elapsed double, samples long, lengths long, loss double")
    want = mon.throughput(log, 3, 2).join(mon.rolling_loss(log, 4, 3), ["run_id", "iter"]).collect()
    assert len(got) == len(want) == 40
    for r in want:
        g = got[r.run_id, r.iter]
        for c in OUT.names[2:-1]:
            assert abs(g[c] - r[c]) < 1e-9 * max(1, abs(r[c])), c
    assert got["a", 22].late == 1 and got["b", 22].late == 0
