"""Removal of repeated byte strings by prefix-free parsing.

A window is ``length`` bytes of one text.  Every byte covered by a window that also starts earlier (smaller id, or same id and
smaller start) is removed; the first place of every string stays.

1. Triggers.  The rolling hash of every short gram is taken; the trigger of a window is the (leftmost) least hash among the
   first ``span`` grams of it.  Plain modulus triggers leave phrases of any length (a run of blanks has no trigger, or
   nothing else); the least of ``span`` hashes always exists, depends on the window's bytes alone, and is shared by equal
   windows.  A phrase is the text from the first window of a trigger up to that trigger; windows of one trigger are a run.
2. Each trigger's key is the hash of the ``length + 1 - span`` bytes from it on, which every window of its run holds.  Parts of the
   corpus shuffle one row per different key; keys that occur once anywhere end the windows that hold them.
3. Of the runs that are left, each part sends every different one once: the phrase and the parse after it, ``length`` bytes from
   the trigger.  Runs are dealt by key.  Of equal runs only the first stays in question, the others are repeats.
4. In each bounded block of runs, phrases are sorted from the trigger leftwards: phrases that share a suffix stand together, so this is
   the suffix array of the dictionary for every suffix length at once, with the common lengths of neighbours.  The texts from the
   triggers on are sorted with their common lengths: the suffix array of the parse.  A window with ``r`` bytes before its trigger is
   a dictionary suffix of ``r`` bytes and a parse prefix of ``length - r``: combining the intervals of both arrays gives
   the corpus order's intervals of equal windows, and the earliest place of each.
5. Keys that occur more than ``HOT`` times are never gathered: their windows go one by one, folded per part, through a sort by
   128-bit hash, where the first of equal ones stays.

Exact copies are folded first: a copy of an earlier text is a repeat as a whole.  Texts are dealt once, by digest, into parts of a
few megabytes, and the three passes read the same shuffle; a long text is worked on in overlapping segments.  All rows carry
the place they come from, so nothing needs an order of the whole corpus in one task.

Defined results: null and empty texts have no bytes; rows of equal id and equal start are not earlier than one another, so
repeated rows keep their bytes alike; a null id is smaller than all others; ids are integers; an empty table gives
an empty result; extra columns are not read.  Kept bytes may cut a code point, so they are binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blendwise.llm.common import frequent_keys, map_arrow, mix64, row_slices, ship_package, splits_for, table, text_digest

LENGTH = 100
GRAM = 8
PART_BYTES = 8 << 20
SEGMENT = 1 << 20
HOT = 50_000
BLOCK = 16_384
FOLDED = 200_000  # texts that a task remembers at a time to fold copies
NO_ID = -(1 << 63)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xD6E8FEB86659FD93)


class Shape:
    """Span of trigger grams, length of keys and grams for windows of ``length`` bytes."""

    def __init__(self, length: int):
        self.length = length
        self.span = min(61, 3 * length // 5 + 1)
        self.key = length + 1 - self.span
        self.gram = min(GRAM, self.key)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first copy of each text in this task with its text; smaller ids of later copies follow without."""
    first: dict[bytes, int] = {}
    least: dict[bytes, tuple[int, int]] = {}

    def later():
        rows = [(p, d, i, None) for d, (p, i) in least.items()]
        least.clear()
        first.clear()
        return rows

    def batch(rows):
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.binary(), pa.int64(), pa.binary()))],
                                          ["part", "digest", "id", "text"])

    for b in row_slices(batches, "text"):
        rows = []
        for p, d, i, t in zip(b.column("part").to_pylist(), b.column("digest").to_pylist(), b.column("id").to_pylist(),
                              b.column("text").cast(pa.binary()).to_pylist()):
            seen = first.get(d)
            if seen is None:
                first[d] = i
                rows.append((p, d, i, t))
            elif i < least.get(d, (p, seen))[1]:
                least[d] = (p, i)
        if len(first) > FOLDED:
            rows += later()
        if rows:
            yield batch(rows)
    if rows := later():
        yield batch(rows)


class Part:
    """The different texts of a part in order of digest: bytes, least ids, and the place of each in the joined bytes."""

    def __init__(self, rows: pa.Table):
        text, least = {}, {}
        for b in rows.select(["digest", "id", "text"]).to_batches():
            for d, i, t in zip(*(c.to_pylist() for c in b.columns)):
                least[d] = min(i, least.get(d, i))
                if t is not None:
                    text[d] = t
        self.digests = sorted(text)
        self.texts = [text[d] for d in self.digests]
        self.ids = np.array([least[d] for d in self.digests], np.int64)
        self.base = np.concatenate(([0], np.cumsum([len(t) for t in self.texts]))).astype(np.int64)

    def segments(self, shape: Shape, limit: int = SEGMENT) -> Iterator[Segment]:
        held, size = [], 0
        for k, t in enumerate(self.texts):
            for lo in range(0, max(1, len(t) - shape.length + 1), limit):  # pieces share ``length - 1`` bytes
                piece = t[lo:lo + limit + shape.length - 1]
                if len(piece) < shape.length:
                    continue
                if held and size + len(piece) > 2 * limit:
                    yield Segment(self, held, shape)
                    held, size = [], 0
                held.append((k, lo, piece))
                size += len(piece)
        if held:
            yield Segment(self, held, shape)


class Segment:
    """Runs of the windows of some pieces of texts: ``lo`` (first start), ``anchor`` (trigger), ``n`` (windows, 0 or less near
    a piece's end), all in the joined bytes; ``at`` is the first start in the part, ``place`` the trigger in its text, ``id`` the text's id."""

    def __init__(self, part: Part, pieces: list[tuple[int, int, bytes]], shape: Shape):
        self.shape = shape
        self.buf = np.frombuffer(b"".join(p for _, _, p in pieces) + bytes(shape.length + 192), np.uint8)
        sizes = np.array([len(p) for _, _, p in pieces], np.int64)
        first = np.concatenate(([0], np.cumsum(sizes)))
        self.words = np.ndarray((len(self.buf) - 7,), "<u8", self.buf, strides=(1,))  # eight bytes from every place on
        total = int(first[-1])
        trigger = self._triggers(total)
        # starts whose trigger and key lie in their piece: those near its end have no window, but other texts' windows
        # may hold the same key
        end = np.repeat(first[1:], sizes)[:len(trigger)]
        start = np.flatnonzero((np.arange(len(trigger)) + shape.span - 1 + shape.gram <= end) & (trigger + shape.key <= end))
        anchor = trigger[start]
        new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)))
        at = np.flatnonzero(new)
        self.lo, self.anchor = start[at], anchor[at]
        self.n = np.minimum(np.diff(np.append(at, len(start))), end[self.lo] - shape.length + 1 - self.lo)
        piece = np.searchsorted(first, self.lo, side="right") - 1
        text = np.array([k for k, _, _ in pieces])[piece]
        offset = np.array([o for _, o, _ in pieces], np.int64)[piece] - first[piece]
        self.at = part.base[text] + self.lo + offset
        self.place = self.anchor + offset
        self.id = part.ids[text]

    def _triggers(self, total: int) -> np.ndarray:
        """Place of the least gram hash among the ``span`` grams from every start on; the place stands in the low bits."""
        low = np.uint64((1 << 24) - 1)
        grams = self.words[:total - self.shape.gram + 1]
        if self.shape.gram < 8:
            grams = grams & np.uint64((1 << 8 * self.shape.gram) - 1)
        h = grams * _ODD
        h ^= h >> np.uint64(32)
        h *= _OTHER
        best = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        done = 1
        while done < self.shape.span:
            step = min(done, self.shape.span - done)
            best = np.minimum(best[:-step], best[step:])
            done += step
        return (best & low).astype(np.int64)

    def hashes(self, at: np.ndarray, size: np.ndarray | int, seed: int = 0) -> np.ndarray:
        """Hash of ``size`` bytes from ``at`` on."""
        size = np.broadcast_to(np.asarray(size, np.int64), at.shape)
        h = mix64(size.astype(np.uint64) + np.uint64(seed))
        for j in range(0, int(size.max(initial=0)), 8):
            left = size - j
            word = self.words[at + j]
            mask = np.where(left >= 8, ~np.uint64(0), (np.uint64(1) << (8 * np.clip(left, 0, 7)).astype(np.uint64)) - np.uint64(1))
            h = np.where(left > 0, mix64(h * _ODD + (word & mask) * _OTHER + np.uint64(seed + 1)), h)
        return h

    def keys(self) -> np.ndarray:
        return self.hashes(self.anchor, self.shape.key)

    def bodies(self, lo: np.ndarray, size: np.ndarray) -> list[bytes]:
        data = self.buf.tobytes()
        return [data[a:a + s] for a, s in zip(lo.tolist(), size.tolist())]


def _first(order_by: tuple[np.ndarray, ...], ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row of equal ``order_by``: is it the one that represents its group, and does the group start earlier elsewhere?

    Rows at the group's earliest place represent it (several only where ids repeat)."""
    order = np.lexsort((places, ids, *order_by))
    cols = [x[order] for x in order_by]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    group = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    i, p = ids[order], places[order]
    earliest = (i == i[head][group]) & (p == p[head][group])
    out = np.zeros(len(order), bool)
    out[order] = earliest
    return out, ~out


KEYS = "part int, key bigint, times int"


def _send_keys(length: int):
    def send(key, rows):
        shape, keys, times = Shape(length), [], []
        for s in Part(rows).segments(shape):
            k, t = np.unique(s.keys(), return_counts=True)
            keys.append(k)
            times.append(t)
        k = np.concatenate(keys or [np.zeros(0, np.uint64)])
        k, back = np.unique(k, return_inverse=True)
        t = np.bincount(back, np.concatenate(times), len(k)) if len(k) else np.zeros(0)
        return pa.table({"part": pa.array(np.full(len(k), key[0].as_py(), np.int32)), "key": pa.array(k.view(np.int64)),
                         "times": pa.array(np.minimum(t, 2**31 - 1).astype(np.int32))})
    return send


# kind 0: a run (its bytes in ``body``), 1: one window of a hot key (``key`` and ``low`` are its hash), 2: starts known to be repeats
RUNS = "key bigint, kind int, low bigint, id bigint, place bigint, part int, at bigint, n int, before int, body binary"
_RUN_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
_RUN_NAMES = [x.split()[0] for x in RUNS.split(", ")]


def _joined(at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of starts, with neighbours that touch made one."""
    order = np.argsort(at, kind="stable")
    at, n = at[order], n[order]
    head = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1] + n[:-1]))) if len(at) else np.zeros(0, np.int64)
    return at[head], np.add.reduceat(n, head) if len(head) else n


def _send_runs(length: int, hot: int):
    def send(key, rows, keys):
        shape, part = Shape(length), key[0].as_py()
        known = keys.column("key").to_numpy().view(np.uint64) if keys.num_rows else np.zeros(0, np.uint64)
        order = np.argsort(known)
        known, total = known[order], (keys.column("total").to_numpy()[order] if keys.num_rows else np.zeros(0, np.int64))
        runs, gone_at, gone_n = [], [], []
        for s in Part(rows).segments(shape) if len(known) else ():
            k = s.keys()
            slot = np.searchsorted(known, k)
            slot[slot == len(known)] = 0
            found = known[slot] == k
            # a window must not hold a trigger and its key of which the corpus has no other
            m = len(k)
            alone = np.minimum.accumulate(np.where(found, m, np.arange(m))[::-1])[::-1]
            cut = np.where(alone < m, np.maximum(s.lo[alone % m] + shape.span - 1 + shape.gram, s.anchor[alone % m] + shape.key), 1 << 60)
            n = np.minimum(s.n, cut - shape.length - s.lo)
            at = np.flatnonzero(found & (n > 0))
            if not len(at):
                continue
            lo, n, before = s.lo[at], n[at], (s.anchor - s.lo)[at]
            size = n - 1 + shape.length
            a, b = (s.hashes(lo, size, seed) ^ mix64((before * 256 + n + seed).astype(np.uint64)) for seed in (1, 2))
            keep, drop = _first((a, b), s.id[at], s.place[at])
            gone_at.append(s.at[at][drop])
            gone_n.append(n[drop])
            x = np.flatnonzero(keep)
            runs.append({"key": k[at][x], "a": a[x], "b": b[x], "id": s.id[at][x], "place": s.place[at][x], "at": s.at[at][x],
                         "n": n[x], "before": before[x], "hot": total[slot][at][x] > hot,
                         "body": np.array([*s.bodies(lo[x], size[x]), None], object)[:-1]})
        out = []
        if runs:
            r = {c: np.concatenate([x[c] for x in runs]) for c in runs[0]}
            keep, drop = _first((r["a"], r["b"]), r["id"], r["place"])  # once more over the whole part
            gone_at.append(r["at"][drop])
            gone_n.append(r["n"][drop])
            x = np.flatnonzero(keep & ~r["hot"])
            out.append((r["key"][x].view(np.int64), 0, 0, r["id"][x], r["place"][x], r["at"][x], r["n"][x], r["before"][x], r["body"][x]))
            x = np.flatnonzero(keep & r["hot"])
            if len(x):
                high, low, ids, places, at = _windows({c: v[x] for c, v in r.items()}, shape.length)
                keep, drop = _first((high, low), ids, places)
                gone_at.append(at[drop])
                gone_n.append(np.ones(int(drop.sum()), np.int64))
                x = np.flatnonzero(keep)
                out.append((high[x].view(np.int64), 1, low[x].view(np.int64), ids[x], places[x], at[x], np.ones(len(x), np.int64), 0, None))
        at, n = _joined(np.concatenate(gone_at or [np.zeros(0, np.int64)]), np.concatenate(gone_n or [np.zeros(0, np.int64)]))
        out.append((mix64(at.astype(np.uint64) + np.uint64(part)).view(np.int64), 2, 0, 0, 0, at, n, 0, None))
        return pa.concat_tables([_run_rows(part, *o) for o in out])
    return send


def _run_rows(part, key, kind, low, ids, place, at, n, before, body) -> pa.Table:
    def col(x, t):
        return pa.array(x, t) if isinstance(x, np.ndarray) else pa.array(np.full(len(key), x), t)

    values = [key, kind, low, ids, place, part, at, n, before]
    cols = [col(v if not isinstance(v, np.ndarray) else v.astype(t.to_pandas_dtype()), t) for v, t in zip(values, _RUN_TYPES)]
    cols.append(pa.array(body.tolist(), pa.binary()) if body is not None else pa.nulls(len(key), pa.binary()))
    return pa.table(cols, names=_RUN_NAMES)


def _windows(r: dict, length: int) -> tuple[np.ndarray, ...]:
    """All windows of some runs, one by one: 128-bit hash, id, place of the start in its text, start in the part."""
    out = []
    for lo in range(0, len(r["n"]), BLOCK):
        n, body = r["n"][lo:lo + BLOCK], r["body"][lo:lo + BLOCK].tolist()
        seg = Segment.__new__(Segment)
        seg.buf = np.frombuffer(b"".join(body) + bytes(16), np.uint8)
        seg.words = np.ndarray((len(seg.buf) - 7,), "<u8", seg.buf, strides=(1,))
        first = np.concatenate(([0], np.cumsum([len(x) for x in body])))[:-1]
        row = np.repeat(np.arange(len(n)), n)
        shift = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = first[row] + shift
        out.append((seg.hashes(at, length, 3), seg.hashes(at, length, 4), r["id"][lo:lo + BLOCK][row],
                    (r["place"] - r["before"])[lo:lo + BLOCK][row] + shift, r["at"][lo:lo + BLOCK][row] + shift))
    return tuple(np.concatenate(x) for x in zip(*out))


def _common(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted rank of fixed-width byte rows, and the common length of each with the one before it in that order."""
    order = np.argsort(rows.view(f"S{rows.shape[1]}").ravel(), kind="stable")
    sorted_ = rows[order]
    differ = sorted_[1:] != sorted_[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank, np.concatenate(([-1], common))


def repeated_starts(bodies: list[bytes], before: np.ndarray, n: np.ndarray, ids: np.ndarray, places: np.ndarray,
                    length: int, span: int) -> np.ndarray:
    """Which starts of each run are windows that start earlier in another run: a matrix runs x ``span``."""
    m = len(bodies)
    data = np.frombuffer(b"".join(bodies) + b"\0", np.uint8)
    size = np.array([len(b) for b in bodies], np.int64)
    first = np.cumsum(size) - size
    j = np.arange(length)
    after = np.where(before[:, None] + j < size[:, None], data[np.minimum(first[:, None] + before[:, None] + j, len(data) - 1)], 0)
    j = np.arange(span)
    left = np.where(j < before[:, None], data[np.maximum(first[:, None] + before[:, None] - 1 - j, 0)], 0)
    parse_rank, parse_common = _common(np.ascontiguousarray(after.astype(np.uint8)))
    phrase_rank, phrase_common = _common(np.ascontiguousarray(left.astype(np.uint8)))
    order = np.lexsort((places, ids))
    new = np.ones(m, bool)
    new[1:] = (ids[order][1:] != ids[order][:-1]) | (places[order][1:] != places[order][:-1])
    when = np.empty(m, np.int64)
    when[order] = np.cumsum(new)
    out = np.zeros((m, span), bool)
    for r in range(span):  # windows with ``r`` bytes before the trigger
        here = np.flatnonzero((before >= r) & (before - n < r))
        if len(here) < 2:
            continue
        phrase = np.cumsum(phrase_common < r)[phrase_rank[here]]
        parse = np.cumsum(parse_common < length - r)[parse_rank[here]]
        interval = phrase * (m + 1) + parse
        order = np.argsort(interval * (m + 1) + when[here], kind="stable")
        interval, t = interval[order], when[here][order]
        new = np.concatenate(([True], interval[1:] != interval[:-1]))
        earliest = t[np.flatnonzero(new)][np.cumsum(new) - 1]
        late = here[order[t > earliest]]
        out[late, before[late] - r] = True
    return out


MARKS = "part int, at bigint, n int"


def _compare(length: int):
    """Repeated starts among the rows of a partition, sorted by key; holds one block of runs at a time."""
    span = Shape(length).span

    def block(rows: list[pa.RecordBatch]):
        t = pa.Table.from_batches(rows)
        c = {x: t.column(x).to_numpy().astype(np.int64) for x in ("before", "n", "id", "place", "part", "at")}
        hit = repeated_starts(t.column("body").to_pylist(), c["before"], c["n"], c["id"], c["place"], length, span)
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, begin = np.nonzero(edge == 1)
        end = np.nonzero(edge == -1)[1]
        return marks(c["part"][row], c["at"][row] + begin, end - begin)

    def marks(part, at, n):
        return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(at.astype(np.int64)), pa.array(n.astype(np.int32))],
                                          ["part", "at", "n"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        head = None  # hash of the window before, and the earliest place of it
        for b in batches:
            kind = b.column("kind").to_numpy()
            known = b.filter(pa.array(kind == 2))
            if known.num_rows:
                yield known.select(["part", "at", "n"])
            w = b.filter(pa.array(kind == 1))
            if w.num_rows:
                high, low, ids, place = (w.column(x).to_numpy() for x in ("key", "low", "id", "place"))
                new = np.ones(len(high), bool)
                new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
                if head is not None and (high[0], low[0]) == head[:2]:
                    new[0] = False
                group = np.cumsum(new) - 1  # -1: still the window of the batch before
                at = np.flatnonzero(new)
                least_id = np.append(ids[at], head[2] if head else 0)[group]
                least_place = np.append(place[at], head[3] if head else 0)[group]
                late = (ids > least_id) | ((ids == least_id) & (place > least_place))
                head = (high[-1], low[-1], least_id[-1], least_place[-1])
                if late.any():
                    yield w.filter(pa.array(late)).select(["part", "at", "n"])
            runs = b.filter(pa.array(kind == 0))
            if not runs.num_rows:
                continue
            key = runs.column("key").to_numpy()
            lo = 0
            for hi in [*(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)]:  # only whole keys make a block
                if held and size + hi - lo > BLOCK and key[lo] != last:
                    yield block(held)
                    held, size = [], 0
                held.append(runs.slice(lo, hi - lo))
                size += hi - lo
                last, lo = key[hi - 1], hi
        if held:
            yield block(held)
    return compare


RESULT = ("digest binary, least_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
          "removed array<struct<start:bigint,length:bigint>>, kept binary")
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))


def _remover(length: int, with_text: bool):
    def remove(key, rows, marks):
        part = Part(rows)
        edge = np.zeros(int(part.base[-1]) + 1, np.int32)
        if marks.num_rows:
            at, n = marks.column("at").to_numpy(), marks.column("n").to_numpy().astype(np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + n - 1 + length, -1)
        gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
        out = []
        for d, t, i, lo in zip(part.digests, part.texts, part.ids.tolist(), part.base.tolist()):
            g = gone[lo:lo + len(t)]
            removed = int(np.count_nonzero(g))
            kept, spans = t, []
            if removed:
                kept = np.frombuffer(t, np.uint8)[~g].tobytes()
                x = np.flatnonzero(np.diff(np.concatenate(([False], g, [False])).astype(np.int8)))
                spans = [{"start": a, "length": b - a} for a, b in zip(x[0::2].tolist(), x[1::2].tolist())]
            out.append((d, i, len(t), removed, len(spans), hashlib.sha256(kept).hexdigest(), spans, kept if with_text else None))
        cols = list(zip(*out)) if out else [[]] * 8
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), _SPANS, pa.binary()]
        names = ["digest", "least_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept"]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)
    return remove


def removed_bytes(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, with_text: bool = False,
                  hot: int = HOT) -> DataFrame:
    """Per different text, as it is under its smallest id ``least_id``: bytes, removed bytes and spans, digest of the kept bytes, the
    spans, and (``with_text``) the kept bytes."""
    spark = docs.sparkSession
    ship_package(spark)
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0  # one number: how finely to deal
    parts = splits_for(spark, total, PART_BYTES)
    tasks = max(spark.sparkContext.defaultParallelism, -(-parts // 2), int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = docs.select(text_digest(F.col(text)).alias("digest"), F.coalesce(F.col(key).cast("bigint"), F.lit(NO_ID)).alias("id"),
                    F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = d.select(F.pmod(F.xxhash64("digest"), F.lit(parts)).cast("int").alias("part"), "digest", "id", "text")
    dealt = map_arrow(d, _fold, "part int, digest binary, id bigint, text binary").repartition(tasks, "part")
    by_part = dealt.groupBy("part")
    keys = frequent_keys(by_part.applyInArrow(_send_keys(length), KEYS), "times", 2, total="total")
    runs = by_part.cogroup(keys.groupBy("part")).applyInArrow(_send_runs(length, hot), RUNS)
    runs = runs.repartition("key").sortWithinPartitions("key", "kind", "low", "id", "place")
    marks = map_arrow(runs, _compare(length), MARKS)
    return by_part.cogroup(marks.groupBy("part")).applyInArrow(_remover(length, with_text), RESULT)


def with_copies(docs: DataFrame, found: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """``(key, n_bytes, n_removed, n_spans, kept_sha256)`` per row of ``docs``: a later copy of a text goes as a whole."""
    found = found.select("digest", "least_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    j = docs.select(F.col(f"`{key}`"), text_digest(F.col(text)).alias("digest")).join(found, "digest")
    copy = (F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(NO_ID)) > F.col("least_id")) & (F.col("n_bytes") >= length)
    return j.select(F.col(f"`{key}`"), "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
                    F.when(copy, F.lit(1)).otherwise(F.col("n_spans")).cast("bigint").alias("n_spans"),
                    F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"))


def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_copies(docs, removed_bytes(docs))
