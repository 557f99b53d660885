"""Phrase collocation mining with Rabin-Karp fingerprints.

Texts are lower-cased (A-Z), split into pieces and words.  A prefix polynomial over the bytes gives every word's hash, a
second one over the word hashes gives the fingerprint of every n-gram by one subtraction and one multiplication, in
numpy.  Languages never meet: the language is part of each word's hash.

1. Texts are cut at piece borders into slices of bounded length and joined into compressed batches, a few of which are a part.
   All passes read the same shuffle of parts.
2. Phrases of two words or more are counted by bucket of their fingerprint first (the hash filter of Park, Chen and Yu): a part
   sends the counts of its buckets as compressed arrays and gets back which of them reach the least count in total.  A
   bucket holds at least as many as each phrase in it, so this drops no frequent one, and rare ones are not sent one by one.
   Then a part's fingerprints are counted and one row per part and different fingerprint is shuffled: a key of 48 bits, a check of
   32 and the count; of words all, of longer phrases those of filled buckets whose phrases of a word less are in such ones too
   (a phrase is never more frequent than a phrase inside it).  Keys that reach the least count in total are frequent.
3. The occurrence pointer of a key is one of the parts that sent it, by hash.  That part alone reads the phrase, at its first
   place, and takes over the total.  Where the checks of a key differ, phrases collide: every part that holds the key reads the
   texts, and counts are summed again by text, so that the text decides.  Only phrases of frequent keys ever exist as text.
4. Scores and the rule of contained phrases are joins of the frequent phrases, in exact decimal arithmetic.

A fingerprint that a third of all texts share is one row per part, and it is summed in the JVM with spilling.  Nothing but the
number of bytes comes to the driver; no set of words or phrases is broadcast.

Defined results: null and empty texts have no words, a null language is ``und``; repeated rows count each time; ties in
score are ordered by count, then phrase; a very long text is many slices (one piece without a separator stays
whole); an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blendwise.llm.common import (_BASE, _powers, map_arrow, materialize, mix64, row_slices, ship_package, splits_for,
                                  table, window_hashes)

LEAST = 100
LONGEST = 5
TOP = 2000
SLICE_BYTES = 1 << 19
BATCH_BYTES = 1 << 20
PART_BATCHES = 8
TOP_BUCKETS = 64
RANGE_BITS = 18  # buckets are summed in ranges of 2**RANGE_BITS
LEAST_BITS = 10  # of the number of buckets of each phrase length

# Separators of pieces [.,;:!?\x0A-\x0D] and of words [\x20\x09] (fixed values of the contract).
PIECE_END = b".,;:!?\n\x0b\x0c\r"
_PIECE = np.zeros(256, bool)
_PIECE[list(PIECE_END)] = True
_BREAK = _PIECE.copy()
_BREAK[list(b" \t")] = True


def _piece_slices(data: bytes, limit: int = SLICE_BYTES) -> Iterator[bytes]:
    """A text's bytes cut after piece separators, into slices of about ``limit`` bytes."""
    if len(data) <= limit:
        yield data
        return
    ends = np.flatnonzero(_PIECE[np.frombuffer(data, np.uint8)]) + 1
    lo = 0
    while lo < len(data):
        k = np.searchsorted(ends, lo + limit, side="right") - 1  # the last border within the limit, else the next one
        if k < 0 or ends[k] <= lo:
            k += 1
        hi = int(ends[k]) if k < len(ends) else len(data)
        yield data[lo:hi]
        lo = hi


DEALT = "part bigint, langs array<string>, sizes array<int>, times array<bigint>, data binary"


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compressed batches of slices; equal slices of a batch are folded into one with its number."""
    from pyspark import TaskContext

    task, made, zip_ = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=3)
    fold: dict[tuple[str, bytes], int] = {}
    size = 0

    def batch() -> pa.RecordBatch:
        part = (task << 24) + made // PART_BATCHES
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int64()), pa.array([[k[0] for k in fold]], pa.list_(pa.string())),
             pa.array([[len(k[1]) for k in fold]], pa.list_(pa.int32())), pa.array([list(fold.values())], pa.list_(pa.int64())),
             pa.array([zip_.compress(b"".join(k[1] for k in fold))], pa.binary())], ["part", "langs", "sizes", "times", "data"])

    for b in row_slices(batches, "text"):
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
            for s in _piece_slices((text or b"").lower()):  # bytes.lower() folds A-Z only
                if not s:
                    continue
                if (lang, s) not in fold:
                    if fold and size + len(s) > BATCH_BYTES:
                        yield batch()
                        made, size = made + 1, 0
                        fold.clear()
                    size += len(s)
                fold[lang, s] = fold.get((lang, s), 0) + 1
    if fold:
        yield batch()


def _batches(rows: pa.Table) -> Iterator[tuple[list[bytes], list[str], list[int]]]:
    unzip = zstandard.ZstdDecompressor()
    for b in rows.select(["langs", "sizes", "times", "data"]).to_batches():
        for langs, sizes, times, data in zip(*(c.to_pylist() for c in b.columns)):
            data, ends = unzip.decompress(data), np.cumsum(sizes).tolist()
            yield [data[e - n:e] for e, n in zip(ends, sizes)], langs, times


class Words:
    """The words of some slices: bounds in the joined bytes, hashes, pieces and how often each counts."""

    def __init__(self, slices: list[bytes], langs: list[int], times: list[int], which: int = 0):
        self.data = b"\n".join(slices) + b"\n"
        buf = np.frombuffer(self.data, np.uint8)
        gap = _BREAK[buf]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], gap)).view(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        border = np.cumsum([len(s) + 1 for s in slices])
        at = np.searchsorted(border, self.start, side="right")
        ends = np.flatnonzero(_PIECE[buf])
        self.piece = np.searchsorted(ends, self.start)
        self.times = np.asarray(times, np.int64)[at]
        self.lang = np.asarray(langs, np.int64)[at]
        self.hash = self._hashes(buf, which)

    def _hashes(self, buf: np.ndarray, which: int) -> np.ndarray:
        power, inverse = _powers(len(buf) + 1, which)
        run = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[:len(buf)], out=run[1:])
        h = (run[self.end] - run[self.start]) * inverse[self.start]
        return mix64(mix64(h + (self.end - self.start).astype(np.uint64) * np.uint64(_BASE[1 - which])) ^ LANG_HASH(self.lang))

    def inside(self, n: int) -> np.ndarray:
        """Which n-grams stand inside one piece."""
        return self.piece[n - 1:] == self.piece[:max(0, len(self.piece) - n + 1)] if len(self.piece) >= n else np.zeros(0, bool)

    def text(self, at: int, n: int) -> bytes:
        return b" ".join(self.data[a:b] for a, b in zip(self.start[at:at + n].tolist(), self.end[at:at + n].tolist()))

    def grams(self, n: int, which: int = 0) -> np.ndarray:
        return mix64(window_hashes(self.hash, n, which) + np.uint64(n))


def LANG_HASH(lang: np.ndarray) -> np.ndarray:
    return mix64(lang.astype(np.uint64) * np.uint64(_BASE[0]) + np.uint64(1))


def _lang_id(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=7).digest(), "little")


def _key_and_check(w: Words, n: int, at: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
    """Keys (48 bits; the lowest two say whether there are one, two or more words) and checks (32 bits) of the n-grams at ``at``."""
    h = w.grams(n)[at]
    key = (h >> np.uint64(16)) & ~np.uint64(3) | np.uint64(min(n, 3))
    return key, mix64(h ^ np.uint64(_BASE[1])) >> np.uint64(32)


COUNTS = "part bigint, a bigint, b bigint"


class Counter:
    """A part's counts, one row per key and check, packed so that a row's random bytes stand together:
    ``a`` = key and low half of the check, ``b`` = count and high half."""

    def __init__(self):
        self.keys, self.checks, self.times = [], [], []

    def add(self, key: np.ndarray, check: np.ndarray, times: np.ndarray) -> None:
        k, c, t = _summed(key, check, times)
        self.keys.append(k)
        self.checks.append(c)
        self.times.append(t)

    def _all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = np.zeros(0, np.uint64)
        made = [np.concatenate(x or [none]) for x in (self.keys, self.checks, self.times)]
        self.keys, self.checks, self.times = [], [], []
        return _summed(*made)

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        k, _, t = self._all()
        return k, t

    def rows(self, part) -> pa.Table:
        k, c, t = self._all()
        a = (k << np.uint64(16)) | (c & np.uint64(0xFFFF))
        b = (t.astype(np.uint64) << np.uint64(16)) | (c >> np.uint64(16))
        return pa.table({"part": pa.array(np.full(len(a), part.as_py(), np.int64)), "a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})


def _summed(key, check, times):
    """Sums by key and check; a key whose checks differ may give several rows for one pair, which are summed later."""
    order = np.argsort(key, kind="stable")
    k, c, t = key[order], check[order], times[order]
    if not len(k):
        return k, c, t.astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1]))))
    return k[first], c[first], np.add.reduceat(t, first)


def _words_of(rows: pa.Table) -> Iterator[Words]:
    for slices, langs, n in _batches(rows):
        yield Words(slices, [_lang_id(x) for x in langs], n)


def _count_short(key, rows, longest: int = 2, buckets: int = 0, filled: np.ndarray | None = None):
    """Words of a part, and phrases of up to ``longest`` words (with ``filled``: those that stand in filled buckets, and
    so do the phrases inside them)."""
    made = [Counter() for _ in range(longest)]
    for w in _words_of(rows):
        made[0].add(*_key_and_check(w, 1, slice(None)), w.times)
        good = np.ones(len(w.hash), bool)
        for size in range(2, longest + 1):
            good = _longer(w, size, good)
            at = np.flatnonzero(good)
            k, c = _key_and_check(w, size, at)
            if filled is not None:
                good[at] = hit = _is_in(filled, _bucket(k, size, buckets))
                k, c, at = k[hit], c[hit], at[hit]
            made[size - 1].add(k, c, w.times[at])
    return pa.concat_tables([m.rows(key[0]) for m in made])


def _filled_counter(longest: int, buckets: int):
    return lambda key, rows, filled: _count_short(key, rows, longest, buckets, _places(filled))


def _is_in(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    at = np.searchsorted(known, x)
    at[at == len(known)] = 0
    return known[at] == x


def _longer(w: Words, n: int, good: np.ndarray) -> np.ndarray:
    """Which phrases of ``n`` words hold two ``good`` ones of a word less."""
    return good[:-1] & good[1:] & w.inside(n)


def _longer_counter(shorter: int, longest: int):
    """Phrases of ``shorter + 1`` to ``longest`` words whose phrases of ``shorter`` words are all frequent, without buckets."""
    def count(key, rows, known):
        known = np.unique(known.column("key").to_numpy()).astype(np.uint64) if known.num_rows else np.zeros(0, np.uint64)
        made = Counter()
        for w in _words_of(rows) if len(known) else ():
            good = w.inside(shorter)
            good[good] = _is_in(known, _key_and_check(w, shorter, np.flatnonzero(good))[0])
            for size in range(shorter + 1, longest + 1):
                good = _longer(w, size, good)
                at = np.flatnonzero(good)
                made.add(*_key_and_check(w, size, at), w.times[at])
        return made.rows(key[0])
    return count


FILLED = "part bigint, range bigint, places binary"
BUCKETS = FILLED + ", times binary"


def _bucket(key: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """Buckets of pairs, then those of triples, and so on."""
    return (key >> np.uint64(2)) % np.uint64(buckets) + np.uint64((n - 2) * buckets)


def _pack(x: np.ndarray) -> bytes:
    """32-bit numbers, compressed by byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(x: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _gaps(places: np.ndarray) -> bytes:
    return _pack(np.diff(places, prepend=places.dtype.type(0)))


def _places(rows: pa.Table) -> np.ndarray:
    """The places of all of a part's ranges, in order."""
    held = zip(rows.column("range").to_pylist(), rows.column("places").to_pylist())
    return np.sort(np.concatenate([np.zeros(0, np.uint64)] + [np.cumsum(_unpack(x), dtype=np.uint64) + np.uint64(r << RANGE_BITS) for r, x in held]))


def _bucket_counter(longest: int, buckets: int, least: int):
    """What a part's buckets of phrases of 2 to ``longest`` words hold: one row per range of buckets, with the places that
    are not empty and their counts (no more than ``least`` each, which is all that a bucket needs)."""
    def count(key, rows):
        made = {size: Counter() for size in range(2, longest + 1)}
        for w in _words_of(rows):
            for size, counter in made.items():
                at = np.flatnonzero(w.inside(size))
                b = _bucket(_key_and_check(w, size, at)[0], size, buckets)
                counter.add(b, np.zeros(len(b), np.uint8), w.times[at])
        out = []
        for counter in made.values():
            b, t = counter.sums()
            t = np.minimum(t, min(least, (1 << 32) - 1))
            of = b >> np.uint64(RANGE_BITS)
            cut = np.flatnonzero(np.diff(of, prepend=of[:1] + np.uint64(1))).tolist()
            inside = b & np.uint64((1 << RANGE_BITS) - 1)
            out += [(int(of[lo]), _gaps(inside[lo:hi]), _pack(t[lo:hi])) for lo, hi in zip(cut, [*cut[1:], len(b)])]
        return pa.table({"part": pa.array([key[0].as_py()] * len(out), pa.int64()), "range": pa.array([x for x, _, _ in out], pa.int64()),
                         "places": pa.array([x for _, x, _ in out], pa.binary()), "times": pa.array([x for _, _, x in out], pa.binary())})
    return count


def _filled(least: int):
    """The buckets of a range that reach ``least`` in all parts, for each part that counts in them."""
    def add(key, rows):
        total = np.zeros(1 << RANGE_BITS, np.int64)
        held = [(p, np.cumsum(_unpack(x), dtype=np.int64)) for p, x in zip(*(rows.column(c).to_pylist() for c in ("part", "places")))]
        for (_, places), times in zip(held, rows.column("times").to_pylist()):
            total[places] += _unpack(times)  # places of a part differ
        full = total >= min(least, (1 << 32) - 1)
        held = [(p, x[full[x]]) for p, x in held]
        held = [(p, x) for p, x in held if len(x)]
        return pa.table({"part": pa.array([p for p, _ in held], pa.int64()), "range": pa.array([key[0].as_py()] * len(held), pa.int64()),
                         "places": pa.array([_gaps(x) for _, x in held], pa.binary())})
    return add


def frequent(counts: DataFrame, least: int) -> DataFrame:
    """``(part, key, check, total, own)`` of the keys with ``least`` occurrences in all parts: ``own`` is 1 in one of the
    parts that hold the key, and 2 in all of them where checks differ."""
    w = Window.partitionBy("key")
    d = counts.withColumn("key", F.shiftrightunsigned("a", 16))
    check = F.shiftleft(F.col("b").bitwiseAND(0xFFFF), 16) + F.col("a").bitwiseAND(0xFFFF)
    d = d.withColumn("total", F.sum(F.shiftrightunsigned("b", 16)).over(w)).withColumn("check", F.min(check).over(w))
    turn = F.xxhash64("part", "key")
    d = d.withColumn("own", F.when(F.max(check).over(w) != F.col("check"), 2).when(F.min(turn).over(w) == turn, 1).otherwise(0))
    return d.filter(F.col("total") >= least).select("part", "key", "check", "total", "own")


PHRASES = "lang string, n_words int, phrase string, times bigint"


def _reader(longest: int):
    """Texts of the frequent keys that a part owns, read at their first place, with their totals (own counts by text where
    phrases collide); the empty phrase of no words stands for all words of a language."""
    def read(key, rows, keys):
        known, first = np.unique(keys.column("key").to_numpy().astype(np.uint64), return_index=True)
        check, total, own = (keys.column(c).to_numpy()[first] for c in ("check", "total", "own"))
        done = np.zeros(len(known), bool)
        found: dict[tuple[str, int, bytes], int] = {}
        for slices, langs, n in _batches(rows):
            ids = [_lang_id(x) for x in langs]
            w = Words(slices, ids, n)
            name_of = dict(zip(ids, langs))
            for i, name in name_of.items():
                found[name, 0, b""] = found.get((name, 0, b""), 0) + int(w.times[w.lang == i].sum())
            for size in range(1, longest + 1) if len(known) else ():
                at = np.flatnonzero(w.inside(size))
                k, c = _key_and_check(w, size, at)
                slot = np.searchsorted(known, k)
                slot[slot == len(known)] = 0
                hit = (known[slot] == k) & ((own[slot] == 2) | ((check[slot] == c.astype(np.int64)) & ~done[slot]))
                at, slot = at[hit], slot[hit]
                collide = own[slot] == 2
                one, where = np.unique(slot[~collide], return_index=True)
                done[one] = True
                for s, p in zip(one.tolist(), at[~collide][where].tolist()):
                    found[name_of[int(w.lang[p])], size, w.text(p, size)] = int(total[s])
                for p in at[collide].tolist():
                    name = (name_of[int(w.lang[p])], size, w.text(p, size))
                    found[name] = found.get(name, 0) + int(w.times[p])
        return pa.table({"lang": pa.array([k[0] for k in found], pa.string()), "n_words": pa.array([k[1] for k in found], pa.int32()),
                         "phrase": pa.array([k[2].decode() for k in found], pa.string()), "times": pa.array(list(found.values()), pa.int64())})
    return read


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST,
                     longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """``(lang, n_words, phrase, f)`` of every phrase of 1 to ``longest`` words with ``f >= least``, and ``(lang, n)``; the counts are a written table."""
    spark = docs.sparkSession
    ship_package(spark)
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0  # one number: how finely to deal
    tasks = max(splits_for(spark, total, 2 * PART_BATCHES * BATCH_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = map_arrow(d, _deal, DEALT).repartition(tasks, "part")
    by_part = dealt.groupBy("part")
    buckets = 1 << max(LEAST_BITS, (2 * total // max(1, least)).bit_length())  # with words of six bytes, a bucket's mean is a twelfth of ``least``
    counted = by_part.applyInArrow(_bucket_counter(longest, buckets, least), BUCKETS)
    filled = counted.groupBy("range").applyInArrow(_filled(least), FILLED)
    counts = by_part.cogroup(filled.groupBy("part")).applyInArrow(_filled_counter(longest, buckets), COUNTS)
    owned = materialize(frequent(counts, least).filter("own > 0"), "frequent")
    read = by_part.cogroup(owned.groupBy("part")).applyInArrow(_reader(longest), PHRASES)
    found = materialize(read.groupBy("lang", "n_words", "phrase").agg(F.sum("times").alias("f"))
                        .filter((F.col("f") >= least) | (F.col("n_words") == 0)), "phrases")
    return found.filter("n_words > 0"), found.filter("n_words = 0").select("lang", F.col("f").alias("n"))


def _part(words, start, length):
    return F.array_join(F.slice(words, start, length), " ")


def score_collocations(phrases: DataFrame, n: DataFrame, top: int | None = TOP) -> DataFrame:
    """Candidates of two words or more by their lowest-scoring cut, without those contained in an equally frequent
    longer one; ``rank`` counts within a language.  All products are exact decimals of 38 digits."""
    words = F.split("phrase", " ")
    big = phrases.filter("n_words >= 2").withColumn("w", words)
    cuts = big.select("lang", "phrase", "n_words", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part("w", F.lit(1), F.col("k")).alias("p1"),
                       _part("w", F.col("k") + 1, F.col("n_words") - F.col("k")).alias("p2"))
    f = phrases.select("lang", "phrase", "f")
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("p1"), F.col("f").alias("l")), ["lang", "p1"])
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("p2"), F.col("f").alias("r")), ["lang", "p2"])
    cuts = cuts.join(n, "lang").withColumn("score", F.expr(
        "(1000 * cast(a as decimal(18,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b"))
    best = best.select("lang", "phrase", *[F.col("b")[c].alias(c) for c in ("a", "l", "r", "n", "score")])
    # contained phrases: every part of two words or more of a longer phrase, with the longer one's count
    inner = big.filter("n_words >= 3").select("lang", "w", "n_words", F.col("f").alias("fl"),
                                              F.explode(F.expr("sequence(2, n_words - 1)")).alias("m"))
    inner = inner.select("lang", "w", "fl", "m", F.explode(F.expr("sequence(1, n_words - m + 1)")).alias("s"))
    inner = inner.select("lang", _part("w", F.col("s"), F.col("m")).alias("phrase"), "fl").groupBy("lang", "phrase").agg(F.max("fl").alias("fl"))
    kept = best.join(inner, ["lang", "phrase"], "left").filter("fl is null or fl < a").drop("fl")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:  # a bucket of a language first, so that no task sorts a whole language
        w = Window.partitionBy("lang", "_b").orderBy(*order)
        kept = kept.withColumn("_b", F.pmod(F.xxhash64("phrase"), F.lit(TOP_BUCKETS))).withColumn("_r", F.row_number().over(w))
        kept = kept.filter(F.col("_r") <= top).drop("_b", "_r")
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    if top is not None:
        kept = kept.filter(F.col("rank") <= top)
    return kept.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST,
                 top: int | None = TOP) -> DataFrame:
    return score_collocations(*frequent_phrases(docs, text, lang, least, longest), top)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


OP11_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY lang),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, count(*) AS f
      FROM s, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
b AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM g WHERE k >= 2),
c AS (SELECT lang, phrase, f AS a, unnest(range(1, k)) AS cut, k, w FROM b),
d AS (SELECT c.lang, c.phrase, c.a, cut, x.f AS l, y.f AS r, n.n,
        (CAST(1000 AS HUGEINT) * c.a * n.n) // (CAST(x.f AS HUGEINT) * y.f) AS score
      FROM c JOIN g x ON x.lang = c.lang AND x.k = cut AND x.phrase = array_to_string(list_slice(w, 1, cut), ' ')
      JOIN g y ON y.lang = c.lang AND y.k = c.k - cut AND y.phrase = array_to_string(list_slice(w, cut + 1, c.k), ' ')
      JOIN n ON n.lang = c.lang),
e AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, w, f, k, unnest(range(2, k)) AS m FROM b),
j AS (SELECT lang, w, f, m, unnest(range(1, k - m + 2)) AS st FROM i),
o AS (SELECT lang, array_to_string(list_slice(w, st, st + m - 1), ' ') AS phrase, max(f) AS f FROM j GROUP BY ALL),
t AS (SELECT e.* FROM e LEFT JOIN o ON o.lang = e.lang AND o.phrase = e.phrase WHERE o.f IS NULL OR 100 * o.f < 100 * e.a),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM t)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM q WHERE rank <= 2000"""
