"""Best-fit-decreasing packing of token pieces into fixed-size sequences.

Each document becomes its token ids plus an end id and is cut into pieces of at most
``capacity`` ids only if it is longer; the first piece is the shorter one.

Best fit decreasing looks at one piece at a time, longest first, and puts it
into the open bin with the least room that still holds it.  There are only
``capacity`` different lengths and room sizes, so the same packing is computed from the
histogram of lengths: a segment tree over the room sizes finds the tightest open
bins in logarithmic time, and all pieces of one length that go the same way are placed
at once, as a run.  Bins with equal room are interchangeable, so this gives exactly as many bins as piece-by-piece best fit.  The
histogram (at most ``capacity`` numbers) is the only thing the driver sees; the plan it
returns has a few runs per length, whatever the corpus size.

Pieces are numbered within their length by a two-level rank (length, hash
range), so a length that a third of all pieces share is spread over many tasks, and find their
run by binary search in the plan.

Defined results: null and empty texts are the end id alone; texts of any length and content, white space without end
included, have the tokenizer's ids; repeated rows are packed once each; an empty table gives an empty result; extra columns pass through ``tokenize_pieces``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blendwise.functions.prefix import prefix_rank
from blendwise.llm.common import map_arrow, materialize, row_slices, table

CAPACITY = 1024
END_ID = 2
RANK_BUCKETS = 256

# Words, numbers, punctuation and white space runs of byte-level BPE (fixed value of the vocabulary).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PieceEncoder:
    """Token ids of whole texts as little-endian 32-bit bytes.

    ``tokenizer`` is a ``tokenizers`` file, ``ranks`` the same vocabulary as ranks.  Both give the same ids; the second
    form needs a third of the CPU time on words that were never seen before.  Texts with a special
    token's string, which only the first form knows, go there, and so do texts that the second form's pattern gives up
    on (white space without end) and the first text of every task, to be compared."""

    _made: dict[tuple[str, str], PieceEncoder] = {}

    def __init__(self, tokenizer: str, ranks: str):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as f:
            table_of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=table_of, special_tokens={})
        self.compared = False

    @classmethod
    def of(cls, tokenizer: str, ranks: str) -> PieceEncoder:
        if (tokenizer, ranks) not in cls._made:
            cls._made[tokenizer, ranks] = cls(tokenizer, ranks)
        return cls._made[tokenizer, ranks]

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if any(x in text for x in self.special):
            return self.plain(text)
        try:
            ids = self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        except ValueError:  # its backtracking is bounded, the tokenizer's is not
            return self.plain(text)
        if not self.compared:
            if ids != self.plain(text):
                raise ValueError("the two forms of the vocabulary do not agree")
            self.compared = True
        return ids


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be shorter than ``capacity``."""
    head = n % capacity or min(n, capacity)
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


def tokenize_pieces(df: DataFrame, text: str, vocabulary: tuple[str, str], keep: list[str], capacity: int = CAPACITY,
                    end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces ``(keep..., piece, start, length, ids_crc32[, ids])`` of every row; ids as little-endian 32-bit bytes.
    ``vocabulary`` names the two files of a :class:`PieceEncoder`."""
    fields = [df.schema[k] for k in keep] + [
        T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(*vocabulary)
        for b in row_slices(batches, "_text"):
            at, out = [], []
            for i, t in enumerate(b.column("_text").to_pylist()):
                ids = encoder.encode(t or "") + end
                for k, (s, n) in enumerate(cut_points(len(ids) // 4, capacity)):
                    part = ids[4 * s:4 * (s + n)]
                    at.append(i)
                    out.append((k, s, n, zlib.crc32(part), part))
            cols = list(zip(*out))
            made = [pa.array(cols[0], pa.int32())] + [pa.array(c, pa.int64()) for c in cols[1:4]]
            if with_ids:
                made.append(pa.array(cols[4], pa.binary()))
            kept = b.take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([kept.column(k) for k in range(len(keep))] + made,
                                             [f.name for f in fields])

    source = df.select(*[F.col(f"`{k}`") for k in keep], F.col(text).alias("_text"))
    return map_arrow(source, cut, T.StructType(fields))


class RoomTree:
    """Segment tree over room sizes 0 .. capacity: number of open bins, and the least room >= a length that has any."""

    def __init__(self, capacity: int):
        self.n = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.n)

    def add(self, room: int, bins: int) -> None:
        i = room + self.n
        while i:
            self.count[i] += bins
            i >>= 1

    def tightest(self, length: int) -> int | None:
        i = length + self.n
        while not self.count[i]:  # climb until a right neighbour has bins, then descend to its leftmost
            while i & 1:
                i >>= 1
                if i <= 1:
                    return None
            i += 1
            if self.count[i]:
                while i < self.n:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.n
            if i & (i - 1) == 0:  # first node of a level: wrapped around
                return None
        while i < self.n:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        return i - self.n


def plan_runs(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing over a histogram of lengths.

    Runs ``(length, first rank, pieces, first bin, pieces per bin, offset)``: piece ``r`` of
    a run goes to bin ``first bin + r // per`` at ``offset + (r % per) * length``."""
    tree, open_bins = RoomTree(capacity), {}  # room -> ranges (first bin, bins)
    runs, made = [], 0

    def put(room: int, first: int, bins: int) -> None:
        if room and bins:
            open_bins.setdefault(room, []).append((first, bins))
            tree.add(room, bins)

    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:  # open new bins, filled one after the other
                per = capacity // length
                first, bins, room = made, -(-left // per), capacity
                made += bins
            else:
                first, bins = open_bins[room].pop()
                tree.add(room, -bins)
                per = room // length
                need = -(-left // per)
                if need < bins:
                    put(room, first + need, bins - need)
                    bins = need
            take = min(left, bins * per)
            runs.append((length, rank, take, first, per, capacity - room))
            full, rest = divmod(take, per)
            put(room - per * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            rank, left = rank + take, left - take
    return runs


def pack_best_fit(pieces: DataFrame, order: list[str], length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` plus ``sequence_id`` and ``offset``; ``order`` makes ranks reproducible. ``pieces`` is read twice."""
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy(length).count().collect()}  # at most ``capacity`` rows
    runs = plan_runs(histogram, capacity)
    starts: dict[int, tuple[list, list]] = {}
    for n, rank, _, first, per, at in runs:
        have = starts.setdefault(n, ([], []))
        have[0].append(rank)
        have[1].append((first, per, at))
    plan = {n: (np.array(a, np.int64), np.array(b, np.int64)) for n, (a, b) in starts.items()}
    shared = pieces.sparkSession.sparkContext.broadcast(plan)
    d = pieces.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(RANK_BUCKETS)))
    d = prefix_rank(d, [length], ["_b", *order], "_rank", bucket=F.col("_b")).drop("_b")
    schema = T.StructType([f for f in d.schema.fields if f.name != "_rank"]
                          + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    kept = [f.name for f in d.schema.fields if f.name != "_rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_of = shared.value
        for b in batches:
            n = b.column(length).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = b.column("_rank").to_numpy(zero_copy_only=False).astype(np.int64) - 1
            seq, off = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            for value in np.unique(n):
                here = np.flatnonzero(n == value)
                first_rank, to = table_of[int(value)]
                k = np.searchsorted(first_rank, rank[here], side="right") - 1
                inside = rank[here] - first_rank[k]
                seq[here] = to[k, 0] + inside // to[k, 1]
                off[here] = to[k, 2] + inside % to[k, 1] * value
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(seq), pa.array(off)], [f.name for f in schema])

    return map_arrow(d, place, schema)


def pack_documents(docs: DataFrame, vocabulary: tuple[str, str], keep: list[str], text: str = "text", capacity: int = CAPACITY,
                   end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenise and pack whole documents; tokenised pieces are written once to the shared folder."""
    pieces = materialize(tokenize_pieces(docs, text, vocabulary, keep, capacity, end_id, with_ids), "pieces")
    return pack_best_fit(pieces, [*keep, "piece", "ids_crc32"], capacity=capacity)


def byte_bpe_50k() -> tuple[str, str]:
    from public_tokenizers import path

    return path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = pack_documents(docs, byte_bpe_50k(), ["doc_id"])
    return d.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
