"""Removal of repeated byte strings against a direct dictionary of all windows."""

import hashlib
import random

import numpy as np
import pytest
from helpers import SF, edge_documents

from blendwise.llm import suffixes


def direct(rows, length):
    """Kept bytes per row of (id, text)."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        i = suffixes.NO_ID if i is None else i
        for s in range(len(b) - length + 1):
            w = b[s:s + length]
            if (i, s) < first.get(w, (1 << 70, 0)):
                first[w] = (i, s)
    out = []
    for i, t in rows:
        b, i = (t or "").encode(), suffixes.NO_ID if i is None else i
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if first[b[s:s + length]] < (i, s):
                gone[s:s + length] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate(([False], gone)).astype(np.int8)) == 1))
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((None if i == suffixes.NO_ID else i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, rows, length, **options):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = suffixes.removed_bytes(df, length=length, **options)
    return [tuple(r) for r in suffixes.with_copies(df, found, length=length).collect()]


def corpus(seed, length, n=100):
    rng = random.Random(seed)
    letters = ["a", "b", "c", "é", " ", "\n", "\x00", "日"]
    passages = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 3 * length))) for _ in range(10)]
    passages += ["a" * 2 * length, "ab" * length, " " * length]
    rows = []
    for i in range(n):
        t = "".join(rng.choice(passages) if rng.random() < 0.6 else "".join(rng.choice(letters) for _ in range(rng.randint(1, length)))
                    for _ in range(rng.randint(0, 5)))
        rows.append((i * 7 % 101, t))
    return rows


@pytest.mark.parametrize("length", [1, 2, 5, 16, 40, 100])
@pytest.mark.parametrize("hot", [0, 50_000])
def test_random_corpora(spark, length, hot):
    rows = corpus(length, length)
    rows += [(1000 + i, t) for i, (_, t) in enumerate(rows[:8])] + [(None, rows[3][1]), (5, rows[4][1]), rows[6], (-4, rows[9][1])]
    rows += [(7, None), (8, "")]
    assert sorted(run(spark, rows, length, hot=hot), key=repr) == sorted(direct(rows, length), key=repr)


def test_segments_and_blocks_are_seamless(spark, monkeypatch):
    monkeypatch.setattr(suffixes.Part.segments, "__defaults__", (64,))
    rows = corpus(11, 40, 30) + [(500, "".join(chr(97 + i * i % 23) for i in range(5000)) * 2)]
    part = suffixes.Part(_table(rows))
    pieces = list(part.segments(suffixes.Shape(40)))
    assert len(pieces) > 50
    starts = np.concatenate([np.arange(a, a + n) for s in pieces for a, n in zip(s.at, s.n) if n > 0])
    want = [b + k for b, t in zip(part.base, part.texts) for k in range(len(t) - 39)]
    assert sorted(starts.tolist()) == want
    monkeypatch.setattr(suffixes, "BLOCK", 16)
    assert sorted(_local(rows, 40), key=repr) == sorted(direct(rows, 40), key=repr)


def _table(rows):
    import pyarrow as pa

    b = [(t or "").encode() for _, t in rows]
    return pa.table({"digest": pa.array([hashlib.md5(x).digest() for x in b]), "id": pa.array([i for i, _ in rows], pa.int64()),
                     "text": pa.array(b, pa.binary())})


def _local(rows, length):
    """The passes over one part, without Spark; ids must be distinct and copies are left to the caller."""
    import pyarrow as pa

    t, key = _table(rows), (pa.scalar(0, pa.int32()),)
    keys = suffixes._send_keys(length)(key, t).to_pandas()
    keys = pa.table({"key": pa.array(keys["key"]), "total": pa.array(keys["times"])})
    runs = suffixes._send_runs(length, 50_000)(key, t, keys).sort_by([(c, "ascending") for c in ("key", "kind", "low", "id", "place")])
    marks = pa.Table.from_batches(suffixes._compare(length)(runs.to_batches(max_chunksize=7)), schema=pa.schema(
        [("part", pa.int32()), ("at", pa.int64()), ("n", pa.int32())]))
    found = {r["digest"]: r for r in suffixes._remover(length, False)(key, t, marks).to_pylist()}
    out = []
    for i, text in rows:
        r = found[hashlib.md5((text or "").encode()).digest()]
        copy = i > r["least_id"] and r["n_bytes"] >= length
        out.append((i, r["n_bytes"], r["n_bytes"], 1, hashlib.sha256(b"").hexdigest()) if copy
                   else (i, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
    return out


def test_intervals_of_equal_windows():
    """Dictionary and parse intervals against the strings themselves."""
    rng = random.Random(3)
    length, span = 12, 6
    n = np.array([rng.randint(1, 4) for _ in range(400)])
    before = np.array([rng.randint(x - 1, span - 1) for x in n])
    bodies = ["".join(rng.choice("ab\x00") for _ in range(2)) * 20 for _ in n]
    bodies = [b[:length - 1 + k].encode() for b, k in zip(bodies, n)]
    ids, places = np.array([rng.randint(0, 50) for _ in n]), np.array([rng.randint(0, 50) for _ in n])
    got = suffixes.repeated_starts(bodies, before, n, ids, places, length, span)
    first = {}
    for b, p, k, i, x in zip(bodies, before, n, ids, places):
        for s in range(k):
            w = (b[s:s + length], p - s)
            first[w] = min(first.get(w, (1 << 60, 0)), (i, x))
    for row, (b, p, k, i, x) in enumerate(zip(bodies, before, n, ids, places)):
        for s in range(k):
            assert got[row, s] == (first[b[s:s + length], p - s] < (i, x))


def test_query_on_a_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = suffixes.op12_suffix_array_dedup(spark, SF)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(direct(rows, 100))


def test_edge_cases(spark):
    docs = edge_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = suffixes.removed_bytes(docs, with_text=True)
    got = [tuple(r) for r in suffixes.with_copies(docs, found).collect()]
    assert sorted(got, key=repr) == sorted(direct(rows, 100), key=repr)
    for r in found.collect():
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.removed) == r.n_spans
    empty = docs.limit(0)
    assert suffixes.with_copies(empty, suffixes.removed_bytes(empty)).count() == 0


def test_long_and_periodic_texts(spark):
    rows = [(1, "a" * 300_000), (2, "ab" * 100_000 + "x"), (3, "\n" * 200_000), (4, "line of text\n" * 20_000)]
    assert sorted(run(spark, rows, 100)) == sorted(direct(rows, 100))


def test_one_line_in_a_third_of_all_rows(spark):
    line = "this very common line stands in a third of all rows, between texts that differ from row to row everywhere else."
    rows = [(i, (line if i % 3 == 0 else "") + hashlib.sha256(str(i).encode()).hexdigest() * 3) for i in range(600)]
    rows = [(i, hashlib.md5(str(i).encode()).hexdigest() + t) for i, t in rows]
    want = sorted(direct(rows, 100))
    assert sorted(run(spark, rows, 100)) == want and sorted(run(spark, rows, 100, hot=100)) == want
