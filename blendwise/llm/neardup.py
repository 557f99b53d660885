"""Near-duplicate documents by a multi-index Hamming join over b-bit MinHash signatures.

A text's set holds its distinct shingles of k words (A-Z lower-cased).  Its signature has
``CHUNKS * CHUNK`` symbols of 16 bits, one per MinHash function; two texts differ in a symbol with
probability 1 - J.  The signature is split into chunks of ``CHUNK`` symbols.  If two signatures differ in fewer
than ``CHUNKS * (ERRORS + 1)`` symbols, some chunk has at most ``ERRORS`` differing symbols (pigeonhole); a
chunk's allowed errors are enumerated by masking every choice of ``ERRORS`` symbols, so such a pair shares a key.
With 10 chunks of 4 symbols and one error, all pairs up to distance 19 of 40 meet.  At the lowest linked
similarity (0.8) the expected distance is 8; the chance that a linked pair shares no key is 4e-8.

Before two sets are compared, an odd sketch rules most unlinked pairs out for sure: 2048 parities of the
set's elements.  Every element of only one of two sets flips one bit, so the sketches differ in no more
bits than the sets differ in elements, and a linked pair's sets differ in at most a ninth of their summed sizes.

Links are confirmed on the full sets.  No group is expanded into all of its pairs up front:

1. Texts with equal sets are one class.
2. Every key group compares its members with one centre (a star); links make components.  While the groups
   hold very many pairs in different components, further star rounds with other centres follow.
3. Pairs of one key group that are in different components are compared with each other, block by block, by
   signature distance, sketch and set size.  First each component's nearest pair of a group is confirmed
   and joins components; then all pairs that are still in different components are.  Two members of one
   component need no further link, so nothing is lost.

Hot groups: keys are counted by partial aggregates, joins on keys or centres are ones that adaptive execution
splits, and blocks bound what one task compares.  Only counts reach the driver.

Defined results: a text without words (or null) has an empty set and is linked with nothing; with
fewer words than a shingle the whole sequence is one shingle; rows with equal ids are rows of their own,
linked by their texts; a null id never is a component's smallest unless all its ids are null; repeated
rows are copies; an empty table gives an empty result; extra columns are kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blendwise.llm.common import (fresh, map_arrow, materialize, mix64, row_slices, table, text_digest, window_hashes,
                                  word_hashes)
from blendwise.llm.components import components

CHUNKS, CHUNK, ERRORS = 10, 4, 1
SYMBOLS = CHUNKS * CHUNK
EXTRA = 24  # further symbols that are only compared, not indexed: 64 in all
ODD_BITS = 2048
LIKENESS = 80  # percent
BLOCK = 2048  # members of a key group that one task compares with as many others
STAR_ROUNDS_WHILE = 1000  # another star round while the groups hold more open pairs than this times their members
STAR_ROUND_GAIN = 0.9  # and while the last one brought the open pairs below this share

_rng = np.random.Generator(np.random.PCG64(20240229))
_XOR = _rng.integers(0, 1 << 63, SYMBOLS + EXTRA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLY = _rng.integers(0, 1 << 63, SYMBOLS + EXTRA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MASKS = [(c, tuple(i for i in range(CHUNK) if i not in m)) for c in range(CHUNKS) for m in combinations(range(CHUNK), ERRORS)]


def max_distance(percent: int = LIKENESS) -> int:
    """Largest signature distance that is still confirmed on the sets: 6.5 standard deviations above that of ``percent``."""
    n, p = SYMBOLS + EXTRA, 1 - percent / 100
    return min(n, int(np.ceil(n * p + 6.5 * np.sqrt(n * p * (1 - p)))))


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, word0 = word_hashes(texts, lower=True)
    windows = window_hashes(h, k)
    out = []
    for a, b in zip(word0[:-1].tolist(), word0[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(windows[a:b - k + 1]))
        elif b > a:
            out.append(window_hashes(h[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """16 bits of each function's smallest value."""
    low = np.full(SYMBOLS + EXTRA, np.iinfo(np.uint64).max)
    for i in range(0, len(s), 8192):
        part = s[i:i + 8192]
        np.minimum(low, ((part[None, :] ^ _XOR[:, None]) * _MULTIPLY[:, None]).min(axis=1), out=low)
    return (mix64(low) & np.uint64(0xFFFF)).astype("<u2")


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the number of elements that fall on each bit."""
    at = (mix64(s ^ _XOR[0]) & np.uint64(ODD_BITS - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=ODD_BITS) & 1).astype(bool))


def possible(odd_a: np.ndarray, odd_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs can reach the similarity: their sets differ in at least as many elements as their sketches in bits."""
    differ = np.bitwise_count(odd_a ^ odd_b).sum(axis=1, dtype=np.int64)
    return differ * (100 + percent) <= (n_a + n_b) * (100 - percent)


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """(n, masks) keys of an (n, symbols) signature matrix."""
    out = np.empty((len(sig), len(MASKS)), np.uint64)
    for j, (c, keep) in enumerate(MASKS):
        key = np.full(len(sig), j + 1, np.uint64)
        for i in keep:
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, c * CHUNK + i].astype(np.uint64))
        out[:, j] = key
    return out


def _first_mask(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """First mask in which the signatures of each pair agree."""
    same = a == b
    out = np.full(len(a), len(MASKS))
    for j in range(len(MASKS) - 1, -1, -1):
        c, keep = MASKS[j]
        out[same[:, [c * CHUNK + i for i in keep]].all(axis=1)] = j
    return out


def _describer(k: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches, "text"):
            # copies next to each other in a slice are worked on once
            digests = b.column("digest").to_pylist()
            texts = b.column("text").cast(pa.binary()).to_pylist()
            first: dict[bytes, int] = {}
            place = [first.setdefault(d, len(first)) for d in digests]
            unique = [None] * len(first)
            for p, t in zip(place, texts):
                unique[p] = t
            sets = shingle_sets(unique, k)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            sigs = [signature(s).tobytes() + odd_sketch(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([
                b.column("id"), b.column("digest"), pa.array([keys[p] for p in place], pa.binary()),
                pa.array([len(sets[p]) for p in place], pa.int64()), pa.array([sigs[p] for p in place], pa.binary())],
                ["id", "digest", "set", "n", "sig"])
    return describe


def _once_per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first of the copies of a text in this task, so that copies do not meet in a shuffle."""
    seen: set[bytes] = set()
    for b in row_slices(batches, "text"):
        keep = []
        for i, d in enumerate(b.column("digest").to_pylist()):
            if d not in seen:
                seen.add(d)
                keep.append(i)
        yield b.take(pa.array(keep, pa.int32()))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for lo in range(0, big.num_rows, 2000):
            b = big.slice(lo, 2000)
            sig = _matrix(b.column("sig"))
            keys = chunk_keys(sig)
            n = len(MASKS)
            yield pa.RecordBatch.from_arrays([
                pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(np.arange(n, dtype=np.int8), len(sig))),
                pa.array(np.repeat(b.column("cls").to_numpy(), n))], ["key", "mask", "cls"])


def _matrix(column) -> np.ndarray:
    """MinHash symbols of a column of signatures."""
    return _bytes(column)[:, :2 * (SYMBOLS + EXTRA)].copy().view("<u2")


def _odd(column) -> np.ndarray:
    """Odd sketches of a column of signatures, 64 bits at a time."""
    return _bytes(column)[:, 2 * (SYMBOLS + EXTRA):].copy().view("<u8")


def _bytes(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 2 * (SYMBOLS + EXTRA) + ODD_BITS // 8)


def _plausible(limit: int, percent: int):
    """Keep the pairs that can be linked by signature distance, odd sketch and set sizes."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big, lo in ((big, lo) for big in batches for lo in range(0, big.num_rows, 20_000)):
            b = big.slice(lo, 20_000)
            far = (_matrix(b.column("sig_u")) != _matrix(b.column("sig_v"))).sum(axis=1)
            x, y = b.column("n_u").to_numpy(), b.column("n_v").to_numpy()
            ok = (far <= limit) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))
            ok &= possible(_odd(b.column("sig_u")), _odd(b.column("sig_v")), x, y, percent)
            yield pa.RecordBatch.from_arrays([b.column("u").filter(pa.array(ok)), b.column("v").filter(pa.array(ok))], ["u", "v"])
    return keep


def _confirmer(k: int, percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[int, np.ndarray] | None = None  # rows come sorted by centre
        for b in row_slices(batches, "text_u"):
            us, vs = b.column("u").to_pylist(), b.column("v").to_pylist()
            mine = shingle_sets(b.column("text_u").cast(pa.binary()).to_pylist(), k)
            out = []
            for i, (u, v, a) in enumerate(zip(us, vs, mine)):
                if known is None or known[0] != v:
                    known = (v, shingle_sets([b.column("text_v")[i].as_py().encode()], k)[0])
                c = known[1]
                both = len(np.intersect1d(a, c, assume_unique=True))
                if 100 * both >= percent * (len(a) + len(c) - both):
                    out.append((u, v))
            cols = list(zip(*out)) if out else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64())], ["u", "v"])
    return confirm


PAIRS_AT_A_TIME = 1_000_000
SKETCHES_AT_A_TIME = 100_000
_RUN = ("key", "block", "other")


def _nearest(run: np.ndarray, i: np.ndarray, j: np.ndarray, label: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Of the pairs (i, j), those that are the nearest one of their run for the label of either side."""
    at = np.tile(np.arange(len(i)), 2)
    side = np.concatenate([label[i], label[j]])
    order = np.lexsort((differ[at], side, run[i][at]))
    first = np.ones(len(order), bool)
    a, b = run[i][at][order], side[order]
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return np.unique(at[order][first])


def _block_pairs(limit: int, percent: int, nearest: bool):
    """Pairs of one (key, block, block) run that are in different components and can be linked: each
    component's ``nearest`` one, or all of them, in the first group in which they meet."""
    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        col = {c: t.column(c).to_numpy() for c in (*_RUN, "side", "mask", "cls", "label", "n")}
        sig, odd = _matrix(t.column("sig")), _odd(t.column("sig"))
        rows = np.arange(len(sig))
        start = np.flatnonzero(np.concatenate(([True], np.any([col[c][1:] != col[c][:-1] for c in _RUN], axis=0))))
        end = np.repeat(np.append(start[1:], len(sig)), np.diff(np.append(start, len(sig))))
        # inside a block every row meets the rows after it; between two blocks those of the first side meet the second
        second = np.repeat(np.add.reduceat((col["side"] == 0).astype(np.int64), start) + start, np.diff(np.append(start, len(sig))))
        crossing = col["block"] != col["other"]
        lo = np.where(crossing, np.where(col["side"] == 0, second, end), rows + 1)
        count = end - lo
        cum = np.concatenate(([0], np.cumsum(count)))
        at = 0
        while at < len(rows):
            stop = max(at + 1, int(np.searchsorted(cum, cum[at] + PAIRS_AT_A_TIME, side="right")) - 1)
            i = np.repeat(rows[at:stop], count[at:stop])
            j = np.arange(len(i)) - np.repeat(cum[at:stop] - cum[at], count[at:stop]) + np.repeat(lo[at:stop], count[at:stop])
            a, b = col["n"][i], col["n"][j]
            ok = (col["label"][i] != col["label"][j]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
            all_i, all_j, some = i[ok], j[ok], []
            for k in range(0, len(all_i), SKETCHES_AT_A_TIME):
                i, j = all_i[k:k + SKETCHES_AT_A_TIME], all_j[k:k + SKETCHES_AT_A_TIME]
                ok = possible(odd[i], odd[j], col["n"][i], col["n"][j], percent)
                i, j = i[ok], j[ok]
                ok = (sig[i] != sig[j]).sum(axis=1) <= limit
                if not nearest:
                    ok[ok] = _first_mask(sig[i[ok]], sig[j[ok]]) == col["mask"][i[ok]]
                some.append((i[ok], j[ok]))
            i, j = (np.concatenate(x) for x in zip(*some)) if some else (i[:0], j[:0])
            if nearest and len(i):
                ok = _nearest(end, i, j, col["label"], (sig[i] != sig[j]).sum(axis=1))
                i, j = i[ok], j[ok]
            if len(i):
                i, j = col["cls"][i], col["cls"][j]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(i, j)), pa.array(np.minimum(i, j))], ["u", "v"])
            at = stop

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            at = np.stack([b.column(c).to_numpy().astype(np.int64) for c in _RUN], axis=1)
            # the last run of a batch may go on in the next one
            cut = np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1
            last = int(cut[-1]) if len(cut) else 0
            if held and any(held[-1].column(c)[-1].as_py() != b.column(c)[0].as_py() for c in _RUN):
                yield from compare(pa.Table.from_batches(held))
                held = []
            if last:
                yield from compare(pa.Table.from_batches([*held, b.slice(0, last)]))
                held = []
            held.append(b.slice(last))
        if held:
            yield from compare(pa.Table.from_batches(held))
    return pairs


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 2,
                    percent: int = LIKENESS) -> DataFrame:
    """``(id, digest, n_shingles, component_id, component)`` per row; ``component_id`` is the smallest id reachable over
    links, ``component`` names the component even if ids are not unique (null without a set)."""
    spark = docs.sparkSession
    source = docs.select(F.col(key).alias("id"), text_digest(F.col(text)).alias("digest"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    id_type = docs.schema[key].dataType.simpleString()
    rows = materialize(map_arrow(source, _describer(shingle), f"id {id_type}, digest binary, set binary, n bigint, sig binary"), "near-rows")
    # a class: the rows with equal sets, represented by one text
    classes = materialize(rows.filter("n > 0").groupBy("set").agg(
        F.min(F.struct("digest", "n", "sig")).alias("x"), F.min("id").alias("least")).select(
        F.monotonically_increasing_id().alias("cls"), "set", "x.digest", "x.n", "x.sig", "least"), "near-classes")
    keys = map_arrow(classes.select("cls", "sig"), _keys, "key bigint, mask tinyint, cls bigint")
    groups = keys.groupBy("key", "mask").agg(F.min("cls").alias("centre"), F.count("*").alias("size")).filter("size > 1")
    members = materialize(keys.join(groups.drop("size"), ["key", "mask"]), "near-members")
    limit = max_distance(percent)

    sizes = classes.select("cls", "n", "sig")
    u_side = sizes.select(F.col("cls").alias("u"), F.col("n").alias("n_u"), F.col("sig").alias("sig_u"))
    v_side = sizes.select(F.col("cls").alias("v"), F.col("n").alias("n_v"), F.col("sig").alias("sig_v"))
    used = members.select("cls").distinct()
    wanted = classes.join(used, "cls").select("cls", "digest")
    once = map_arrow(source.select("digest", "text"), _once_per_task, "digest binary, text string")
    texts = materialize(once.join(wanted, "digest").groupBy("cls").agg(F.first("text").alias("text")), "near-texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        t = pairs.join(texts.select(F.col("cls").alias("u"), F.col("text").alias("text_u")), "u")
        t = t.join(texts.select(F.col("cls").alias("v"), F.col("text").alias("text_v")), "v").select("u", "v", "text_u", "text_v")
        return map_arrow(t.sortWithinPartitions("v"), _confirmer(shingle, percent), "u bigint, v bigint")

    def star(pairs: DataFrame) -> DataFrame:
        p = pairs.filter("u <> v").distinct().join(u_side, "u").join(v_side, "v")
        return confirmed(map_arrow(p, _plausible(limit, percent), "u bigint, v bigint"))

    links = materialize(star(members.select(F.col("cls").alias("u"), F.col("centre").alias("v"))), "near-links")
    # the smallest centre that a member is linked with, or that centre's own: connected for sure
    to = links.groupBy("u").agg(F.min("v").alias("v"))
    labels = to.join(to.select(F.col("u").alias("v"), F.col("v").alias("next")), "v", "left").select(
        F.col("u").alias("id"), F.coalesce("next", "v").alias("label"))

    def still_open() -> DataFrame:
        labelled = members.join(labels.withColumnRenamed("id", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        counts = labelled.groupBy("key", "mask", "label").agg(F.count("*").alias("n"))
        groups = counts.groupBy("key", "mask").agg(F.sum("n").alias("size"), F.sum(F.col("n") * F.col("n")).alias("closed")).filter(
            "closed < size * size")
        return materialize(labelled.join(groups, ["key", "mask"]), "near-open")

    def compared(of: DataFrame, nearest: bool) -> DataFrame:
        b = of.join(sizes, "cls").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn(
            "mine", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
        b = b.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        b = b.select("key", F.least("mine", "to").alias("block"), F.greatest("mine", "to").alias("other"),
                     (F.col("mine") > F.col("to")).cast("int").alias("side"), "mask", "cls", "label", "n", "sig")
        b = b.repartition("key", "block", "other").sortWithinPartitions("key", "block", "other", "side", "cls")
        found = map_arrow(b, _block_pairs(limit, percent, nearest), "u bigint, v bigint")
        return confirmed(found.distinct() if nearest else found)

    opened = still_open()
    turn, before = 0, float("inf")
    while True:
        rows_open, pairs_open = opened.agg(  # two numbers: how much is left to compare
            F.count("*"), F.sum((F.col("size") - F.col("closed") / F.col("size")) / 2)).first()
        if not rows_open or pairs_open <= STAR_ROUNDS_WHILE * rows_open or pairs_open > STAR_ROUND_GAIN * before:
            break
        turn, before = turn + 1, pairs_open
        order = F.xxhash64("cls", F.lit(turn))
        centres = opened.groupBy("key", "mask").agg(F.min_by("cls", order).alias("v"), F.min_by("label", order).alias("of"))
        again = opened.join(centres, ["key", "mask"]).filter("label <> of").select(F.col("cls").alias("u"), "v")
        links = materialize(links.unionAll(star(again)), "near-links")
        labels = components(links)
        opened = still_open()
    if rows_open:
        links = links.unionAll(compared(opened, nearest=True))
    labels = components(links)
    if rows_open:
        # components of components: the last links join few of them
        of_u, of_v = (labels.select(F.col("id").alias(x), F.col("label").alias(f"l{x}")) for x in "uv")
        new = compared(still_open(), nearest=False).join(of_u, "u", "left").join(of_v, "v", "left").select(
            F.coalesce("lu", "u").alias("u"), F.coalesce("lv", "v").alias("v"))
        joined = components(new).select(F.col("id").alias("label"), F.col("label").alias("into"))
        labels = labels.join(joined, "label", "left").select("id", F.coalesce("into", "label").alias("label")).unionAll(
            joined.select(F.col("label").alias("id"), F.col("into").alias("label")))

    named = classes.join(labels.withColumnRenamed("id", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of_set = named.join(least, "label").select("set", "label", "component_id")
    out = rows.join(of_set, "set", "left")
    # rows without a set are their own component
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select("id", "digest", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("label").alias("component"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5,
                         percent: int = LIKENESS) -> DataFrame:
    """One row of each component (that of the smallest id; of equal ids, the first by text digest) with all its columns."""
    found = near_duplicates(docs, key, text, shingle, percent)
    k, d = fresh(docs, "_id"), fresh(docs, "_digest")
    # rows without a set are only compared with rows of the same id and text
    group = [F.col("component"), F.when(F.col("component").isNull(), F.struct("id", "digest")).alias("own")]
    mine = found.groupBy(*group, "id", "digest").agg(F.count("*").alias("copies"))
    keep = materialize(mine.groupBy("component", "own").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "digest", "copies")).alias("x")).select(
        F.col("x.id").alias(k), F.col("x.digest").alias(d), F.col("x.copies").alias("copies")), "near-keep")
    # rows repeated with id and text: few if any, so their list is small and its join needs no shuffle of the texts
    repeated = materialize(keep.filter("copies > 1").select(k, d), "near-repeated")
    own = docs.withColumn(d, text_digest(F.col(text)))
    columns = [F.col(f"`{c}`") for c in docs.columns]

    def rows_of(wanted: DataFrame) -> DataFrame:
        return own.join(wanted, own[key].eqNullSafe(wanted[k]) & (own[d] == wanted[d]), "left_semi")

    once = rows_of(keep.filter("copies = 1").select(k, d)).select(*columns)
    if repeated.isEmpty():
        return once
    return once.unionByName(rows_of(repeated).dropDuplicates([key, d]).select(*columns))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = near_duplicates(docs, shingle=2)
    return d.select(F.col("id").alias("doc_id"), "n_shingles", "component_id",
                    F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
