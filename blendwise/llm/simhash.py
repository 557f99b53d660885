"""Document fingerprints by SimHash, and all fingerprints within a Hamming radius.

The terms of a text are its pairs of neighbouring words (ASCII letters
lower-cased; a one-word text has that word), weighted by how often they occur.  Each term's
64-bit hash votes with its weight for or against every bit, so texts that share most terms
get fingerprints that differ in few bits.

``find_near`` cuts fingerprints into ``blocks`` blocks.  If two differ in at most ``radius``
bits, at least ``blocks - radius`` blocks are equal, so they meet in the table that is permuted to lead
with those blocks; there is one table per choice.  Equal fingerprints are folded
first, a candidate pair is kept only in the first table in which it meets, and the distance is
checked exactly.  Nothing within the radius is missed.

The query also fingerprints an edited text, which needs the next document by id.  Documents are
dealt into id ranges at quantiles, each range also gets the first document of the
next one, and one streaming pass over the sorted range sees each document with its
successor; the texts are shuffled once.

Defined results: null and empty texts (and those without words) have the fingerprint of no
terms, all zero bits; rows with a null id come first; rows with the same id are ordered by the
digest of their text; a single row is its own successor; an empty table gives an empty
result; extra columns are ignored.  A null id is no query of the neighbour search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blendwise.llm.common import map_arrow, materialize, row_slices, ship_package, table, text_digest, word_hashes, window_hashes

BITS = 64
RADIUS = 3
BLOCKS = 6

# For every byte its 8 bits (least significant first) as 8 one-byte counters of a 64-bit lane.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def vote(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Fingerprints of groups of hashes; group ``i`` is ``hashes[first[i]:first[i + 1]]``.  A bit is set if more than half vote for it."""
    n = np.diff(first)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    # segments of at most 255 hashes, so that one-byte counters cannot overflow
    pieces = -(-n[full] // 255)
    seg0 = np.concatenate(([0], np.cumsum(pieces)))
    within = np.arange(seg0[-1]) - np.repeat(seg0[:-1], pieces)
    starts = np.repeat(first[:-1][full], pieces) + 255 * within
    hashes = hashes[: first[-1]]
    raw = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    for k in range(8):
        lanes = np.add.reduceat(_LANES[raw[:, k]], starts)
        ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), seg0[:-1], axis=0)
        bits = (2 * ones > n[full][:, None]).astype(np.uint64)
        for j in range(8):
            out[full] |= bits[:, j] << np.uint64(8 * k + j)
    return out


def fingerprints(texts: list[bytes | None]) -> np.ndarray:
    """SimHash of each text."""
    h, word0 = word_hashes(texts, lower=True)
    n = np.diff(word0)
    pairs = window_hashes(h, 2)
    keep = np.ones(len(h), bool)  # entry i: the pair that starts at word i, or the word of a one-word text
    last = word0[1:][n > 0] - 1
    keep[last] = False
    terms = np.empty(len(h), np.uint64)
    terms[: len(pairs)] = pairs
    single = word0[:-1][n == 1]
    terms[single], keep[single] = h[single], True
    count = np.where(n > 1, n - 1, n)
    return vote(terms[keep], np.concatenate(([0], np.cumsum(count))))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal fingerprints, 0 for opposite ones."""
    return 1.0 - np.bitwise_count(a ^ b) / BITS


def add_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` plus its 64-bit fingerprint as a signed long."""
    ship_package(df.sparkSession)

    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        done, lo, size = [], 0, 0
        data = [None if t is None else t.encode() for t in texts]
        for i, t in enumerate(data):
            size += len(t or b"")
            if size > 4 << 20:
                done.append(fingerprints(data[lo:i + 1]))
                lo, size = i + 1, 0
        done.append(fingerprints(data[lo:]))
        return pd.Series(np.concatenate(done).view(np.int64))

    return df.withColumn(out, of(F.col(text)))


def find_near(queries: DataFrame, fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``(fingerprint, near, distance)``: for every distinct fingerprint of ``queries`` all others of ``fps`` within ``radius`` bits."""
    if blocks <= radius:
        raise ValueError("needs more blocks than the radius")
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    tables = [signed(sum(masks[i] for i in chosen)) for chosen in combinations(range(blocks), blocks - radius)]

    def keyed(df: DataFrame, name: str) -> DataFrame:
        # a permuted table leads with its chosen blocks; masking the others out gives the same order of equals
        rows = F.array(*[F.struct(F.lit(t).alias("t"), F.col(name).bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(tables)])
        return df.select(F.col("fingerprint").alias(name)).filter(F.col(name).isNotNull()).distinct().select(name, F.inline(rows))

    q, f = keyed(queries, "fingerprint"), keyed(fps, "near")
    pairs = q.join(f, ["t", "k"])
    x = F.col("fingerprint").bitwiseXOR(F.col("near"))

    def first_table(x: Column) -> Column:
        return F.coalesce(*[F.when(x.bitwiseAND(F.lit(m)) == 0, F.lit(t)) for t, m in enumerate(tables)])

    return (pairs.filter((F.col("fingerprint") != F.col("near")) & (F.bit_count(x) <= radius) & (F.col("t") == first_table(x)))
            .select("fingerprint", "near", F.bit_count(x).alias("distance")))


def with_successors(docs: DataFrame, key: str, text: str, ranges: int) -> DataFrame:
    """``(_r, _halo, _id, _tie, _text)`` sorted inside partitions: id ranges in order, each followed by the first row of the next."""
    spark = docs.sparkSession
    d = docs.select(F.col(key).cast("bigint").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn(
        "_tie", text_digest(F.col("_text")))
    cuts = np.array(sorted(set(docs.select(F.col(key).cast("double").alias("k")).approxQuantile(
        "k", [i / ranges for i in range(1, ranges)], 0.2 / ranges))))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:  # nulls come first
        x = ids.to_numpy(dtype=np.float64, na_value=-np.inf)
        return pd.Series(np.searchsorted(cuts, x, side="right").astype(np.int32))

    d = d.withColumn("_r", range_of("_id"))
    # one row per range (their number is chosen here, not by the data)
    firsts = sorted((r["_r"], r["f"]["n"], r["f"]["_id"], r["f"]["_tie"]) for r in d.groupBy("_r").agg(
        F.min(F.struct(F.col("_id").isNotNull().alias("n"), "_id", "_tie")).alias("f")).collect())
    halo_of = [(firsts[i][0], r, n, i_, bytes(t)) for i, (r, n, i_, t) in enumerate(firsts[1:] + firsts[:1])]
    to = F.broadcast(spark.createDataFrame(halo_of, "_to int, _r int, n boolean, _i bigint, _t binary"))
    halo = d.join(to, "_r").filter(F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_tie") == F.col("_t")))
    # rows equal in id and text are interchangeable: any of them serves as the successor
    halo = halo.select(F.col("_to").alias("_r"), F.lit(1).alias("_halo"), "_id", "_tie", "_text")
    both = d.select("_r", F.lit(0).alias("_halo"), "_id", "_tie", "_text").unionByName(halo)
    return both.repartition(ranges, "_r").sortWithinPartitions("_r", "_halo", "_id", "_tie")


EDITED = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in EDITED.split(", ")]
    prev = None  # range, halo, id, text, fingerprint
    for b in row_slices(batches, "_text"):
        r, halo, ids = (b.column(c).to_pylist() for c in ("_r", "_halo", "_id"))
        texts = b.column("_text").to_pylist()
        own = fingerprints([t.encode() for t in texts])
        todo, edited = [], []
        for cur in zip(r, halo, ids, texts, own):
            if prev is not None and prev[0] == cur[0] and not prev[1]:
                t, n = prev[3], len(prev[3])
                todo.append((prev[2], n, prev[4], cur[4]))
                edited.append((t[: n - n // 4] + cur[3][: n // 4]).encode())
            prev = cur
        if todo:
            made = fingerprints(edited)
            mine = np.array([x[2] for x in todo], np.uint64)
            following = np.array([x[3] for x in todo], np.uint64)
            yield pa.RecordBatch.from_arrays([
                pa.array([x[0] for x in todo], pa.int64()), pa.array([x[1] for x in todo], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in edited]),
                pa.array([f"{x:016x}" for x in mine.tolist()]), pa.array([f"{x:016x}" for x in made.tolist()]),
                pa.array(likeness(mine, made)), pa.array(likeness(mine, following))], names)


def compare_edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit (last quarter replaced by the start of the next text)."""
    spark = docs.sparkSession
    ship_package(spark)
    ranges = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return map_arrow(with_successors(docs, key, text, ranges), _edit, EDITED)


def with_near_counts(made: DataFrame, key: str = "doc_id", fingerprint: str = "fingerprint", every: int = 20,
                     radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``made`` plus ``n_near``: for the rows whose id is divisible by ``every`` (the stated queries), how many other rows
    have a fingerprint within ``radius`` bits, equal ones included; null for the others.  Rows are counted per fingerprint before anything is
    joined, so copies are never expanded into pairs."""
    stored = F.conv(F.col(fingerprint), 16, -10).cast("bigint")  # as a signed number
    asked = F.coalesce(F.col(key) % every == 0, F.lit(False))
    queries, rest = made.filter(asked).withColumn("_fp", stored), made.filter(~asked)
    rows = made.groupBy(stored.alias("near")).agg(F.count("*").alias("_rows")).filter(F.col("near").isNotNull())
    near = find_near(queries.select(F.col("_fp").alias("fingerprint")), made.select(stored.alias("fingerprint")), radius, blocks)
    # how many fingerprints are near grows with the data: these joins shuffle
    others = near.join(rows.hint("merge"), "near").select(F.col("fingerprint").alias("_fp"), "_rows")
    counts = others.unionByName(rows.select(F.col("near").alias("_fp"), "_rows")).groupBy("_fp").agg(F.sum("_rows").alias("_rows"))
    found = queries.join(counts.hint("merge"), "_fp", "left").withColumn("n_near", F.col("_rows") - 1).drop("_fp", "_rows")
    return found.unionByName(rest.withColumn("n_near", F.lit(None).cast("bigint")))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = materialize(compare_edited(table(spark, sf_dir, "documents").select("doc_id", "text")), "fingerprints")
    return with_near_counts(made)
