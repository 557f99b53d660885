"""Benchmark decontamination by SimHash over item-sized windows.

Words are lower-cased runs of letters, digits and non-ASCII characters; shingles have five of them
(a shorter item is one shingle).  Every benchmark item gets a 64-bit SimHash of its shingles, each
weighted by its occurrences, and every window of a document that is as long as an item gets a rolling SimHash.  With
``short_documents``, as in the query and the pipeline, a document shorter than the item is one window as a whole;
otherwise it has no window.

The block tables name the candidates.  Fingerprints are cut into 8 blocks of 8 bits; two within ``RADIUS`` bits differ in at
most ``RADIUS // 8`` bits in some block, so every item is entered in each table under all block values that close to
its own (beside its length), a window asks each table once, and no item within the radius is missed.  Candidates are verified by the exact
weighted similarity of shingle bags, sum of minima over sum of maxima, at 0.8 or more.  At that similarity fingerprints
differ in 10 bits on average, so a radius of 20 loses few windows, and a leak has several.

Windows that cannot qualify for any item are not fingerprinted: bags of m and M shingles that reach 0.8 share at least
4 (m + M) / 9 of them, and running counts of the shingles that occur anywhere in the benchmark tell which windows hold as many.
Equal windows of a document are asked once (the first counts), and the bags of neighbouring windows slide, so that the work on a text
of one repeated sentence is linear in its length.

The documents are read once and not shuffled.  The benchmark is sent to the tasks in slices of at most
``SLICE_WORDS`` words, as arrays (about 1.2 KB an item); a larger one takes several passes.  Its size is counted first.

Defined results: null or empty texts and items have no windows; repeated documents give a row
each, repeated items (equal ids) a row each per text; an empty table on either side gives no leaks; extra columns are kept
by ``drop_contaminated`` and ignored by ``find_leaks``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blendwise.llm.common import map_arrow, mix64, row_slices, table, window_hashes, word_hashes
from blendwise.llm.simhash import vote

SHINGLE = 5
RADIUS = 20
BLOCKS = 8
LIKENESS = 0.8
SLICE_WORDS = 2_000_000
SLICE_ROWS = 50_000
_FILTER_BITS = 22
_WINDOWS = 4096  # asked at a time, and no more than _PAIRS with the items of a length
_PAIRS = 1 << 20


class BlockTables:
    """Fingerprints of items by kind (their length), each entered in every table under all block values that are close to its own."""

    def __init__(self, prints: np.ndarray, kind: np.ndarray):
        near = np.array([sum(1 << i for i in c) for e in range(RADIUS // BLOCKS + 1) for c in combinations(range(64 // BLOCKS), e)])
        items = np.repeat(np.arange(len(prints), dtype=np.int32), len(near))
        self.prints, self.tables = prints, []
        for j in range(BLOCKS):
            value = ((self._block(prints, j) ^ near[:, None]) + 256 * kind).T.ravel()
            order = np.argsort(value, kind="stable")
            self.tables.append((np.searchsorted(value[order], np.arange(256 * (kind.max(initial=-1) + 1) + 1)), items[order]))

    @staticmethod
    def _block(prints: np.ndarray, j: int) -> np.ndarray:
        return (prints >> np.uint64(8 * j) & np.uint64(0xFF)).astype(np.int64)

    def within(self, probes: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(item, probe, distance)`` of all pairs of one kind within the radius, by item and probe: all that some table offers,
        then the exact distance."""
        pairs = []
        for j, (first, items) in enumerate(self.tables):
            value = self._block(probes, j) + 256 * kind
            n = first[value + 1] - first[value]
            at = np.arange(n.sum()) + np.repeat(first[value] - np.cumsum(n) + n, n)
            pairs.append(items[at].astype(np.int64) * len(probes) + np.repeat(np.arange(len(value)), n))
        item, probe = np.divmod(np.unique(np.concatenate(pairs)), max(1, len(probes)))
        distance = np.bitwise_count(probes[probe] ^ self.prints[item])
        near = distance <= RADIUS
        return item[near], probe[near], distance[near]


class ItemIndex:
    """Shingles, fingerprints and block tables of one slice of the benchmark."""

    def __init__(self, items: list[tuple[int, bytes]]):
        h, word0 = word_hashes([text for _, text in items], lower=True, plain=True)
        n = np.diff(word0)
        self.ids = [item_id for (item_id, _), words in zip(items, n.tolist()) if words]
        shingles = [window_hashes(h[lo:lo + words], min(SHINGLE, words)) for lo, words in zip(word0.tolist(), n.tolist()) if words]
        self.shingles = np.concatenate([np.zeros(0, np.uint64), *shingles])
        self.first = np.concatenate(([0], np.cumsum([len(x) for x in shingles], dtype=np.int64)))
        self.sizes, kind, self.alike = np.unique(n[n > 0], return_inverse=True, return_counts=True)
        self.prints = vote(self.shingles, self.first)
        self.tables = BlockTables(self.prints, kind)
        self.keys, self.maybe = {}, {}  # per shingle length: all shingles, and a bit filter before them
        of = np.minimum(SHINGLE, n[n > 0])
        for k in np.unique(of).tolist():
            keys = self.keys[k] = np.unique(np.concatenate([shingles[i] for i in np.flatnonzero(of == k)]))
            bits = self.maybe[k] = np.zeros(1 << _FILTER_BITS, bool)
            bits[keys & np.uint64((1 << _FILTER_BITS) - 1)] = True

    def within(self, print_: int) -> set[int]:
        """Items of any length within the radius of a fingerprint."""
        return set(self.tables.within(np.full(len(self.sizes), print_, np.uint64), np.arange(len(self.sizes)))[0].tolist())

    def leaks(self, texts: list[bytes | None], short_documents: bool = False) -> list[list[tuple[int, int, int, float, int]]]:
        """Per text: (item, first word, words, similarity, distance) of the best window of every leaked item."""
        h, word0 = word_hashes(texts, lower=True, plain=True)
        best: dict[tuple[int, int], tuple] = {}  # by text and item
        for k in self.keys:
            w = window_hashes(h, k)
            for windows in self._windows(k, h, w, word0, short_documents):
                self._verify(k, w, word0, *windows, best)
        out: list[list] = [[] for _ in texts]
        for t, n in sorted(best):
            out[t].append(best[t, n])
        return out

    def _windows(self, k: int, h: np.ndarray, w: np.ndarray, word0: np.ndarray, short_documents: bool) -> Iterator[tuple]:
        """Windows that hold enough shingles of the benchmark, some thousands at a time: text, kind, first word and fingerprint.
        Of equal windows among them the first."""
        place = np.flatnonzero(self.maybe[k][w & np.uint64((1 << _FILTER_BITS) - 1)])
        at = np.searchsorted(self.keys[k], w[place])
        at[at == len(self.keys[k])] = 0
        place = place[self.keys[k][at] == w[place]]
        of = np.searchsorted(word0, place, side="right") - 1
        inside = place + k <= word0[of + 1]
        place, of = place[inside], of[inside]
        kinds = [(i, size) for i, size in enumerate(self.sizes.tolist()) if min(SHINGLE, size) == k]
        part, waiting = [], 0
        cut = np.flatnonzero(np.diff(of, prepend=-1))
        for t, known in zip(of[cut].tolist(), np.split(place, cut[1:])):
            lo, hi = int(word0[t]), int(word0[t + 1])
            run = np.zeros(hi - lo - k + 2, np.int64)
            run[known - lo + 1] = 1
            np.cumsum(run, out=run)
            for kind, size in kinds:
                span = min(size, hi - lo)
                width = span - k + 1
                least = -(-4 * (width + size - k + 1) // 9)
                if least > len(known) or size > span and not short_documents:
                    break  # and so for all longer items
                for a, b in _runs(np.flatnonzero(run[width:] - run[:-width] >= least) + lo):
                    part.append((np.full(b + 1 - a, t), np.full(b + 1 - a, kind), np.arange(a, b + 1),
                                 _rolling_prints(w[a:b + width], width), window_hashes(h[a:b + span], span)))
                    waiting += b + 1 - a
                    if waiting >= _WINDOWS:
                        yield self._first_of_equals(part)
                        part, waiting = [], 0
        if part:
            yield self._first_of_equals(part)

    def _first_of_equals(self, part: list[tuple]) -> tuple[np.ndarray, ...]:
        text, kind, start, prints, words = (np.concatenate(x) for x in zip(*part))
        group = (text * len(self.sizes) + kind).astype(np.uint64)
        first = np.sort(np.unique(words ^ mix64(group), return_index=True)[1])
        return text[first], kind[first], start[first], prints[first]

    def _verify(self, k: int, w: np.ndarray, word0: np.ndarray, text: np.ndarray, kind: np.ndarray, start: np.ndarray,
                prints: np.ndarray, best: dict[tuple[int, int], tuple]) -> None:
        """Ask the tables for the items near each window, and keep the most similar window of every text and item."""
        step = max(1, _PAIRS // int(self.alike[kind].max()))
        for i in range(0, len(start), step):
            item, probe, distance = self.tables.within(prints[i:i + step], kind[i:i + step])
            probe += i
            cut = np.flatnonzero(np.diff(item * len(word0) + text[probe], prepend=-1))  # one group per item and text
            for n, at, bits in zip(item[cut].tolist(), np.split(probe, cut[1:]), np.split(distance, cut[1:])):
                t = int(text[at[0]])
                lo = int(word0[t])
                mine = self.shingles[self.first[n]:self.first[n + 1]]
                span = min(len(mine) + k - 1, int(word0[t + 1]) - lo)
                for s, both, d in zip(start[at].tolist(), _overlaps(w, start[at], span - k + 1, mine), bits.tolist()):
                    similarity = both / (span - k + 1 + len(mine) - both)
                    if similarity >= LIKENESS and ((t, n) not in best or similarity > best[t, n][3]):
                        best[t, n] = (self.ids[n], s - lo, span, similarity, d)


def _runs(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of consecutive numbers as (first, last), at most 4096 long."""
    cut = np.flatnonzero(np.diff(starts, prepend=-2) != 1)
    for a, b in zip(starts[cut].tolist(), starts[np.append(cut[1:], len(starts)) - 1].tolist() if len(cut) else ()):
        for s in range(a, b + 1, 4096):
            yield s, min(b, s + 4095)


def _rolling_prints(shingles: np.ndarray, width: int) -> np.ndarray:
    """SimHash of every ``width`` consecutive shingles, from running bit counts."""
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    run = np.zeros((len(bits) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=run[1:])
    ones = run[width:] - run[:-width]
    return np.packbits(2 * ones > width, axis=1, bitorder="little").view("<u8").ravel()


def _overlaps(shingles: np.ndarray, starts: np.ndarray, width: int, item: np.ndarray) -> Iterator[int]:
    """Sum of minima of the item's bag and the bag of each window; ``starts`` ascend, near windows slide."""
    bag = Counter(item.tolist())
    at = None
    for s in starts.tolist():
        if at is None or s - at > width // 2:
            mine = Counter(shingles[s:s + width].tolist())
            both = (mine & bag).total()
        else:
            for gone, come in zip(shingles[at:s].tolist(), shingles[at + width:s + width].tolist()):
                both -= mine[gone] <= bag[gone]
                mine[gone] -= 1
                both += mine[come] < bag[come]
                mine[come] += 1
        at = s
        yield both


def _slices(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark in slices of bounded size, each small enough to be sent to every task."""
    b = benchmark.select(F.col(item).cast("bigint").alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows, size = b.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    n = max(1, -(-int(size or 0) // (6 * SLICE_WORDS)), -(-int(rows) // SLICE_ROWS))
    for i in range(n):
        part = b if n == 1 else b.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i)
        yield [(r["item"], r["text"].encode()) for r in part.collect()]


LEAKS = "id bigint, item_id bigint, start_word bigint, n_words bigint, similarity double, distance int"


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
               item_text: str = "text", short_documents: bool = False) -> DataFrame:
    """One row per document and leaked item: the place of its most similar window (the first of equals)."""
    source = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    out = None
    for items in _slices(benchmark, item, item_text):
        index = source.sparkSession.sparkContext.broadcast(ItemIndex(items))

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            names = [x.split()[0] for x in LEAKS.split(", ")]
            kinds = [pa.int64()] * 4 + [pa.float64(), pa.int32()]
            for b in row_slices(batches, "text"):
                found = index.value.leaks(b.column("text").cast(pa.binary()).to_pylist(), short_documents)
                rows = [(i, *x) for i, xs in zip(b.column("id").to_pylist(), found) for x in xs]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        part = map_arrow(source, scan, LEAKS)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
                      short_documents: bool = False) -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark."""
    for items in _slices(benchmark, item, item_text):
        index = docs.sparkSession.sparkContext.broadcast(ItemIndex(items))

        def clean(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in row_slices(batches, text):
                found = index.value.leaks(b.column(text).cast(pa.binary()).to_pylist(), short_documents)
                yield b.filter(pa.array([not x for x in found], pa.bool_()))

        docs = map_arrow(docs, clean, T.StructType(docs.schema.fields))
    return docs


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), short_documents=True)
    return found.withColumnRenamed("id", "doc_id")
