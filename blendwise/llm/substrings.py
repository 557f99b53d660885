"""Substring dedup with fixed-block anchors.

A window is ``width`` consecutive words of one text.  Every word covered by a window whose
word sequence also starts anywhere else is removed.

1. Index: the non-overlapping blocks of ``(width + 1) // 2`` words of every text.  A window of
   ``width`` words always contains one whole block, so a repeated window has a block that occurs
   again at any offset of the other text.
2. Probe: every rolling window of a block's length, of every text, is looked up in the index.  The lookup
   needs no positions, only whether a key is a block somewhere and occurs twice: tasks send
   sorted, distinct 32-bit keys per key range, and get back the keys that hit.
3. Extend: round every hit, the ``width``-word windows that contain it are compared in the same
   way, with 128-bit keys; runs of windows that repeat are the maximal exact repeats.  Extension is
   done by grouping equal windows, not pair by pair, so a passage in m texts costs
   m entries and not m squared, and a key that a third of all rows share
   reaches a task once per part of the corpus, not once per row.

Exact copies are folded first: a text that occurs in several rows is worked on once and
counts twice.  Texts are dealt once, by digest, into parts of a few megabytes; the three passes read the
same shuffle.  Probe and extension keys are dealt by key range, in as many ranges as the corpus needs.

Defined results: null and empty texts have no words; repeated rows are copies, so all their
words go if there are at least ``width`` of them; an empty table gives an empty result; extra columns
are kept by ``dedup_substrings``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blendwise.llm.common import (fresh, map_arrow, mix64, row_slices, ship_package, splits_for, table, text_digest,
                                  window_hashes, word_hashes)

WIDTH = 35
PART_BYTES = 6 << 20
PARTS_PER_TASK = 4
RANGE_KEYS = 2_000_000  # keys that one task compares at a time, on average
LOW = np.uint64(0xFFFFFFFF)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the copies of a text in this task: the first with its text, the second as a mark without, no more."""
    seen: dict[bytes, int] = {}
    for b in row_slices(batches, "text"):
        digests = b.column("digest").to_pylist()
        keep, text = [], []
        for i, d in enumerate(digests):
            n = seen.get(d, 0)
            if n < 2:
                seen[d] = n + 1
                keep.append(i)
                text.append(n == 0)
        out = b.take(pa.array(keep, pa.int32()))
        texts = pc.if_else(pa.array(text, pa.bool_()), out.column("text"), pa.scalar(None, pa.string()))
        yield pa.RecordBatch.from_arrays([out.column("part"), out.column("digest"), texts], ["part", "digest", "text"])


def _distinct(rows: pa.Table) -> tuple[list[bytes], list[bytes], np.ndarray]:
    """Digests, texts and "has a copy" of the different texts of a part."""
    text, n = {}, {}
    for b in rows.select(["digest", "text"]).to_batches():
        for d, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
            n[d] = n.get(d, 0) + 1
            if t is not None:
                text[d] = t
    digests = sorted(text)
    return digests, [text[d] for d in digests], np.array([n[d] > 1 for d in digests], bool)


def _slices(texts: list[bytes], limit: int = 2 << 20) -> Iterator[slice]:
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield slice(lo, i + 1)
            lo, size = i + 1, 0
    if lo < len(texts):
        yield slice(lo, len(texts))


def _starts(word0: np.ndarray, total: int, width: int) -> np.ndarray:
    """Which of the ``total - width + 1`` windows lie inside one text."""
    ok = np.ones(max(0, total - width + 1), bool)
    for k in range(1, width):  # windows that begin less than ``width`` words before a border cross it
        at = word0[1:-1] - k
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok


def _rolling(texts: list[bytes], copied: np.ndarray, block: int):
    """Word hashes, text borders, keys of all rolling blocks and which of them are inside one text."""
    h, word0 = word_hashes(texts)
    return h, word0, window_hashes(h, block), _starts(word0, len(h), block)


def _text_of(word0: np.ndarray, total: int) -> np.ndarray:
    return np.repeat(np.arange(len(word0) - 1), np.diff(word0))[:total]


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(ranges)).astype(np.int64)


def _blobs(part: int, ranges: np.ndarray, columns: dict[str, np.ndarray], flags: dict[str, np.ndarray], names: list[str]):
    """One row per key range that has keys; ``ranges`` is sorted."""
    cut = np.flatnonzero(np.concatenate(([True], ranges[1:] != ranges[:-1]))) if len(ranges) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(ranges))
    made = {"range": pa.array(ranges[cut], pa.int32()), "part": pa.array(np.full(len(cut), part), pa.int32())}
    for k, v in columns.items():
        pack = pack_keys if k == "keys" else np.ndarray.tobytes
        made[k] = pa.array([pack(v[a:b]) for a, b in zip(cut, ends)], pa.binary())
    for k, v in flags.items():
        made[k] = pa.array([np.packbits(v[a:b]).tobytes() for a, b in zip(cut, ends)], pa.binary())
    return pa.table([made[n] for n in names], names=names)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 32-bit keys as gaps: the two high bytes of the gaps are mostly small and compress, the low ones do not."""
    gaps = np.diff(keys.astype("<u4"), prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4)
    return len(keys).to_bytes(4, "little") + gaps[:, :2].tobytes() + zlib.compress(gaps[:, 2:].T.tobytes(), 1)


def unpack_keys(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    gaps = np.empty((n, 4), np.uint8)
    gaps[:, :2] = np.frombuffer(blob, np.uint8, 2 * n, 4).reshape(n, 2)
    gaps[:, 2:] = np.frombuffer(zlib.decompress(blob[4 + 2 * n:]), np.uint8).reshape(2, n).T
    return np.cumsum(gaps.view("<u4").ravel(), dtype=np.uint32)


def _unflag(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


PROBES = "range int, part int, keys binary, is_block binary, twice binary"
HITS = "range int, part int, keys binary"
SPANS = "range int, part int, high binary, low binary, twice binary"
REPEATS = "range int, part int, high binary, low binary"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _prober(block: int, ranges: int):
    def probe(key, rows):
        _, texts, copied = _distinct(rows)
        all_keys, all_block, all_twice = [], [], []
        for s in _slices(texts):
            _, word0, keys, inside = _rolling(texts[s], copied[s], block)
            place = np.flatnonzero(inside)
            text = _text_of(word0, len(keys))[place]
            all_keys.append(keys[place])
            all_block.append((place - word0[text]) % block == 0)
            all_twice.append(copied[s][text])
        keys = np.concatenate(all_keys or [np.zeros(0, np.uint64)])
        r = _range_of(keys, ranges)
        sort_by = (r.astype(np.uint64) << np.uint64(32)) | (keys & LOW)
        order = np.argsort(sort_by, kind="stable")
        sort_by = sort_by[order]
        first = np.flatnonzero(np.concatenate(([True], sort_by[1:] != sort_by[:-1]))) if len(keys) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(keys)))
        if len(first):
            is_block = np.logical_or.reduceat(np.concatenate(all_block)[order], first)
            twice = np.logical_or.reduceat(np.concatenate(all_twice)[order], first) | (count > 1)
        else:
            is_block = twice = np.zeros(0, bool)
        kept = sort_by[first]
        return _blobs(key[0].as_py(), (kept >> np.uint64(32)).astype(np.int64), {"keys": (kept & LOW).astype("<u4")},
                      {"is_block": is_block, "twice": twice}, _names(PROBES))
    return probe


def _match_probes(key, rows):
    """Keys of one range that are a block somewhere and occur at least twice, back to the parts that sent them."""
    parts = rows.column("part").to_pylist()
    sent = [unpack_keys(x) for x in rows.column("keys").to_pylist()]
    n = [len(x) for x in sent]
    is_block = np.concatenate([_unflag(x, k) for x, k in zip(rows.column("is_block").to_pylist(), n)])
    twice = np.concatenate([_unflag(x, k) for x, k in zip(rows.column("twice").to_pylist(), n)])
    keys = np.concatenate(sent)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    count = np.diff(np.append(first, len(keys)))
    hit = np.logical_or.reduceat(is_block[order], first) & ((count > 1) | np.logical_or.reduceat(twice[order], first))
    back = np.zeros(len(keys), bool)
    back[order] = np.repeat(hit, count)
    return _replies(key, parts, n, back, {"keys": keys}, HITS)


def _replies(key, parts, n, back, columns, schema) -> pa.Table:
    at = np.concatenate(([0], np.cumsum(n)))
    out = {name: [] for name in _names(schema)}
    for i, p in enumerate(parts):
        mask = back[at[i]:at[i + 1]]
        if mask.any():
            out["range"].append(key[0].as_py())
            out["part"].append(p)
            for k, v in columns.items():
                out[k].append(v[at[i]:at[i + 1]][mask].tobytes())
    kinds = {"range": pa.int32(), "part": pa.int32()}
    return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in out.items()})


def _hit_keys(rows: pa.Table) -> np.ndarray:
    """Sorted (range, key) pairs of a part's hits."""
    keys = [(np.uint64(r) << np.uint64(32)) | np.frombuffer(k, "<u4").astype(np.uint64)
            for r, k in zip(rows.column("range").to_pylist(), rows.column("keys").to_pylist())]
    return np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)


def _member(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_keys, x)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == x


def _spread(marks: np.ndarray, before: int, after: int, total: int) -> np.ndarray:
    """True at ``i - before .. i + after`` for every marked ``i``."""
    i = np.flatnonzero(marks)
    edge = np.zeros(total + 1, np.int32)
    np.add.at(edge, np.clip(i - before, 0, total), 1)
    np.add.at(edge, np.clip(i + after + 1, 0, total), -1)
    return np.cumsum(edge[:-1]) > 0


def _extender(width: int, block: int, ranges: int):
    def extend(key, rows, hits):
        _, texts, copied = _distinct(rows)
        hit = _hit_keys(hits)
        high, low, twice = [], [], []
        for s in _slices(texts) if len(hit) else ():
            h, word0, keys, inside = _rolling(texts[s], copied[s], block)
            marks = inside & _member(hit, (_range_of(keys, ranges).astype(np.uint64) << np.uint64(32)) | (keys & LOW))
            whole = _starts(word0, len(h), width)
            place = np.flatnonzero(_spread(marks, width - block, 0, len(marks))[: len(whole)] & whole)
            if len(place):
                high.append(window_hashes(h, width)[place])
                low.append(window_hashes(word_hashes(texts[s], 1)[0], width, 1)[place])
                twice.append(copied[s][_text_of(word0, len(h))[place]])
        if not high:
            return _blobs(key[0].as_py(), np.zeros(0, np.int64), dict.fromkeys(("high", "low"), np.zeros(0, "<u8")),
                          {"twice": np.zeros(0, bool)}, _names(SPANS))
        high, low, twice = np.concatenate(high), np.concatenate(low), np.concatenate(twice)
        r = _range_of(high, ranges)
        order = np.lexsort((low, high, r))
        high, low, r, twice = high[order], low[order], r[order], twice[order]
        first = np.flatnonzero(np.concatenate(([True], (high[1:] != high[:-1]) | (low[1:] != low[:-1]))))
        count = np.diff(np.append(first, len(high)))
        twice = np.logical_or.reduceat(twice, first) | (count > 1)
        return _blobs(key[0].as_py(), r[first], {"high": high[first].astype("<u8"), "low": low[first].astype("<u8")},
                      {"twice": twice}, _names(SPANS))
    return extend


def _match_spans(key, rows):
    parts = rows.column("part").to_pylist()
    sent = [np.frombuffer(x, "<u8") for x in rows.column("high").to_pylist()]
    n = [len(x) for x in sent]
    high, low = np.concatenate(sent), np.concatenate([np.frombuffer(x, "<u8") for x in rows.column("low").to_pylist()])
    twice = np.concatenate([_unflag(x, k) for x, k in zip(rows.column("twice").to_pylist(), n)])
    order = np.lexsort((low, high))
    a, b = high[order], low[order]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    count = np.diff(np.append(first, len(a)))
    back = np.zeros(len(high), bool)
    back[order] = np.repeat((count > 1) | np.logical_or.reduceat(twice[order], first), count)
    return _replies(key, parts, n, back, {"high": high, "low": low}, REPEATS)


RESULT = ("digest binary, n_words bigint, n_removed bigint, kept_sha256 string, "
          "repeats array<struct<start:int,length:int>>, kept string")
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))


def _remover(width: int, with_text: bool):
    def remove(key, rows, repeats):
        digests, texts, _ = _distinct(rows)
        wanted = [np.frombuffer(x, "<u8") for x in repeats.column("high").to_pylist()]
        high = np.concatenate(wanted) if wanted else np.zeros(0, np.uint64)
        low = np.concatenate([np.frombuffer(x, "<u8") for x in repeats.column("low").to_pylist()]) if wanted else high
        # both halves folded into one sorted key, then checked on both halves
        order = np.argsort(mix64(high) ^ low)
        folded, high, low = (mix64(high) ^ low)[order], high[order], low[order]
        out = []
        for s in _slices(texts):
            part = texts[s]
            h, word0 = word_hashes(part)
            gone = np.zeros(len(h), bool)
            if len(folded) and len(h) >= width:
                a, b = window_hashes(h, width), window_hashes(word_hashes(part, 1)[0], width, 1)
                f = mix64(a) ^ b
                at = np.searchsorted(folded, f)
                at[at == len(folded)] = 0
                marks = (folded[at] == f) & (high[at] == a) & (low[at] == b) & _starts(word0, len(h), width)
                gone = _spread(marks, 0, width - 1, len(h))
            for i, t in enumerate(part):
                words = t.split()
                g = gone[word0[i]:word0[i + 1]]
                n = int(np.count_nonzero(g))
                spans = None
                if n:
                    kept = b" ".join(compress(words, (~g).tolist()))
                    edge = np.flatnonzero(np.diff(np.concatenate(([False], g, [False])).astype(np.int8)))
                    spans = [{"start": x, "length": y - x} for x, y in zip(edge[0::2].tolist(), edge[1::2].tolist())]
                else:
                    kept = b" ".join(words)
                out.append((digests[s.start + i], len(words), n, hashlib.sha256(kept).hexdigest(), spans,
                            kept.decode() if with_text and n else None))
        cols = list(zip(*out)) if out else [[]] * 6
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), _SPAN, pa.string()]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["digest", "n_words", "n_removed", "kept_sha256", "repeats", "kept"])
    return remove


def repeated_spans(texts: DataFrame, text: str = "text", width: int = WIDTH, with_text: bool = False) -> DataFrame:
    """Per distinct text: digest, word count, removed words, digest of the kept words, the maximal
    repeats as word spans and (``with_text``, where words go) the kept words."""
    spark = texts.sparkSession
    ship_package(spark)
    block = (width + 1) // 2
    total = texts.agg(F.sum(F.octet_length(text))).first()[0] or 0  # one number: how finely to deal
    parts = splits_for(spark, total, PART_BYTES)
    tasks = max(spark.sparkContext.defaultParallelism, -(-parts // PARTS_PER_TASK),
                int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = splits_for(spark, total // 6, RANGE_KEYS)
    d = texts.select(text_digest(F.col(text)).alias("digest"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = d.withColumn("part", F.pmod(F.xxhash64("digest"), F.lit(parts)).cast("int"))
    dealt = map_arrow(d.select("part", "digest", "text"), _fold, "part int, digest binary, text string").repartition(tasks, "part")
    probes = dealt.groupBy("part").applyInArrow(_prober(block, ranges), PROBES)
    hits = probes.groupBy("range").applyInArrow(_match_probes, HITS)
    spans = dealt.groupBy("part").cogroup(hits.groupBy("part")).applyInArrow(_extender(width, block, ranges), SPANS)
    repeats = spans.groupBy("range").applyInArrow(_match_spans, REPEATS)
    return dealt.groupBy("part").cogroup(repeats.groupBy("part")).applyInArrow(_remover(width, with_text), RESULT)


def dedup_substrings(docs: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with repeated words taken out of ``text`` (texts without any stay as they are, white space included)."""
    d = fresh(docs, "_digest")
    k = fresh(docs, "_kept")
    changed = repeated_spans(docs, text, width, with_text=True).filter("n_removed > 0").select(
        F.col("digest").alias(d), F.col("kept").alias(k))
    out = docs.withColumn(d, text_digest(F.col(text))).join(changed, d, "left")
    return out.withColumn(text, F.coalesce(F.col(k), F.col(text))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = repeated_spans(docs).select("digest", "n_words", "n_removed", "kept_sha256")
    return docs.select("doc_id", text_digest(F.col("text")).alias("digest")).join(found, "digest").drop("digest")
