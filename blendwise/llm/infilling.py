"""Fill-in-the-middle transformation over seekable compressed texts.

A text is stored as independent zstandard frames of ``frame_chars`` code points.  Beside every frame stand the units
(lines) and code points that begin before it, so that the place of any unit is found by binary search over
the counts and inside one decompressed frame.  A transformation picks two cut units from a hash of the row's key,
decompresses the frames that hold the cuts, and streams the other frames in output order into the digests (and into
the output text if that is asked for); no more than one frame is held in plain form at a time.  The exact text is
rebuilt from the output stream and the form alone: the part that comes too early is kept as frames again until its turn.

The store is a written table, one row per input row, so that a lost executor repeats one task of one step.  Nothing is
shuffled: a row's frames are as long as its text and no key gathers rows.

Defined results: null and empty texts are plain, with no units; a text that holds a control mark is plain; texts
of any length are worked on frame by frame; repeated rows get equal results (the key alone decides the cuts); a null key
counts as the empty string; an empty table gives an empty result; extra columns are kept, and an output whose name is taken
gets a number after its name.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blendwise.llm.common import fresh, map_arrow, materialize, row_slices, table

FRAME_CHARS = 1 << 15
SEED = 7
# Control marks of the output (fixed values of the format).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FORMS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}

_FRAME = T.StructType([T.StructField("units", T.LongType()), T.StructField("chars", T.LongType()),
                       T.StructField("data", T.BinaryType())])
STORE_FIELDS = [T.StructField("units", T.LongType()), T.StructField("chars", T.LongType()),
                T.StructField("marked", T.BooleanType()), T.StructField("frames", T.ArrayType(_FRAME))]


class SeekableText:
    """A text as frames ``(units before, code points before, zstandard frame)`` and its totals."""

    def __init__(self, units: int, chars: int, frames: list[tuple[int, int, bytes]]):
        self.units, self.chars, self.frames = units, chars, frames
        self.first_unit = [f[0] for f in frames]
        self.first_char = [f[1] for f in frames]

    @classmethod
    def of(cls, pieces: Iterable[str], frame_chars: int = FRAME_CHARS) -> SeekableText:
        """Frames of a text that arrives in pieces; a unit begins at the text's start and after every line feed but the last character."""
        zip_ = zstandard.ZstdCompressor(level=3)
        frames, units, chars, after_feed = [], 0, 0, True
        for piece in _resized(pieces, frame_chars):
            frames.append((units, chars, zip_.compress(piece.encode())))
            units += after_feed + piece.count("\n", 0, len(piece) - 1)
            chars += len(piece)
            after_feed = piece.endswith("\n")
        return cls(units, chars, frames)

    def frame(self, i: int) -> str:
        return zstandard.ZstdDecompressor().decompress(self.frames[i][2]).decode()

    def place(self, unit: int) -> int:
        """Code points before ``unit`` (all of them for the unit after the last)."""
        if unit >= self.units:
            return self.chars
        i = bisect_right(self.first_unit, unit) - 1
        text, skip = self.frame(i), unit - self.first_unit[i]
        begun = (self.first_unit[i + 1] if i + 1 < len(self.frames) else self.units) - self.first_unit[i]
        inside = text.count("\n", 0, len(text) - 1)
        if begun > inside:  # the frame itself starts with a unit
            if not skip:
                return self.first_char[i]
            skip -= 1
        at = -1
        for _ in range(skip + 1):
            at = text.index("\n", at + 1)
        return self.first_char[i] + at + 1

    def stream(self, start: int = 0, stop: int | None = None) -> Iterator[str]:
        """The code points ``start .. stop - 1``, frame by frame."""
        stop = self.chars if stop is None else stop
        i = max(0, bisect_right(self.first_char, start) - 1)
        while i < len(self.frames) and self.first_char[i] < stop:
            text, base = self.frame(i), self.first_char[i]
            part = text[max(0, start - base):stop - base]
            if part:
                yield part
            i += 1


def _resized(pieces: Iterable[str], size: int) -> Iterator[str]:
    held, n = [], 0
    for p in pieces:
        at = 0
        while n + len(p) - at >= size:
            yield "".join([*held, p[at:at + size - n]])
            held, n, at = [], 0, at + size - n
        if at < len(p):
            held.append(p[at:])
            n += len(p) - at
    if held:
        yield "".join(held)


def choose(key: str, units: int, fim_percent: int, spm_percent: int, seed: int = SEED) -> tuple[str, int, int]:
    """Form and the two cut units of a row, from the hash of its key."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    cuts = sorted((h[0] % (units + 1), h[1] % (units + 1)))
    form = "plain" if h[2] % 100 >= fim_percent else "spm" if h[3] % 100 < spm_percent else "psm"
    return form, *cuts


def emit(text: SeekableText, form: str, first: int, second: int) -> Iterator[str]:
    """The output of a text cut at two code points, as a stream."""
    if form == "plain":
        yield from text.stream()
        return
    parts = {PREFIX: (0, first), MIDDLE: (first, second), SUFFIX: (second, text.chars)}
    for mark in FORMS[form]:
        yield mark
        yield from text.stream(*parts[mark])


def sections(output: Iterable[str], marks: tuple[str, ...]) -> Iterator[tuple[str, str]]:
    """An output stream as (mark, piece of its section); the sections stand in the order of ``marks``."""
    now, todo, held = "", list(marks), ""
    for piece in output:
        held += piece
        while todo and (at := held.find(todo[0])) >= 0:
            if at:
                yield now, held[:at]
            now, held = todo[0], held[at + len(todo[0]):]
            todo.pop(0)
        keep = len(todo[0]) - 1 if todo else 0  # a mark may be cut between two pieces
        ready = len(held) - keep
        if ready > 0:
            yield now, held[:ready]
            held = held[ready:]
    if todo:
        raise ValueError("the output lacks a control mark")
    if held:
        yield now, held


def rebuild(output: Iterable[str], form: str, frame_chars: int = FRAME_CHARS) -> Iterator[str]:
    """The exact text from its output and form: the suffix waits as frames, prefix and middle pass through in order."""
    if form == "plain":
        yield from output
        return
    waiting: list[SeekableText] = []

    def passed(stream):
        held = []
        for mark, piece in stream:
            if mark == SUFFIX:
                held.append(piece)
                if sum(map(len, held)) >= frame_chars:
                    waiting.append(SeekableText.of(held, frame_chars))
                    held = []
            else:
                yield piece
        if held:
            waiting.append(SeekableText.of(held, frame_chars))

    yield from passed(sections(output, FORMS[form]))
    for w in waiting:
        yield from w.stream()


def free_names(df: DataFrame, names: list[str]) -> list[str]:
    """Names for outputs that no column of ``df`` has."""
    return [fresh(df, n) for n in names]


def seekable_store(df: DataFrame, text: str = "text", frame_chars: int = FRAME_CHARS, out: str = "_frames") -> DataFrame:
    """``df`` without its text, plus ``out``: a struct of units, code points, whether a control mark occurs, and the frames."""
    kept = [c for c in df.columns if c != text]
    name = fresh(df, "_source_text")
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(out, T.StructType(STORE_FIELDS))])
    frame_type = pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("data", pa.binary())])
    store_type = pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("marked", pa.bool_()), ("frames", pa.list_(frame_type))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches, name):
            made = []
            for t in b.column(name).to_pylist():
                s = SeekableText.of((t or "",), frame_chars)
                made.append({"units": s.units, "chars": s.chars, "marked": any(m in (t or "") for m in (PREFIX, SUFFIX, MIDDLE)),
                             "frames": [{"units": u, "chars": c, "data": d} for u, c, d in s.frames]})
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(kept))] + [pa.array(made, store_type)],
                                             [*kept, out])

    return map_arrow(df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(name)), run, schema)


def transform(store: DataFrame, key: str = "doc_id", frames: str = "_frames", fim_percent: int = 100, spm_percent: int = 50,
              seed: int = SEED, with_output: bool = False, out: list[str] | None = None) -> DataFrame:
    """A store's rows with their transformation: ``n, form, prefix_chars, middle_chars, output_sha256, restored_sha256[, output]``.

    ``restored_sha256`` is the digest of the text rebuilt from the output stream."""
    kept = [c for c in store.columns if c != frames]
    kinds = [("n", T.LongType(), pa.int64()), ("form", T.StringType(), pa.string()), ("prefix_chars", T.LongType(), pa.int64()),
             ("middle_chars", T.LongType(), pa.int64()), ("output_sha256", T.StringType(), pa.string()),
             ("restored_sha256", T.StringType(), pa.string()), ("output", T.StringType(), pa.string())]
    kinds = kinds if with_output else kinds[:-1]
    names = out or [k[0] for k in kinds]
    schema = T.StructType([store.schema[c] for c in kept] + [T.StructField(n, k[1]) for n, k in zip(names, kinds)])
    k_name = fresh(store, "_key")

    def one(row: dict, key_text: str | None):
        s = SeekableText(row["units"], row["chars"], [(f["units"], f["chars"], f["data"]) for f in row["frames"]])
        form, a, b = choose(key_text or "", s.units, fim_percent, spm_percent, seed)
        if not s.chars or row["marked"]:
            form = "plain"
        first, second = (0, 0) if form == "plain" else (s.place(a), s.place(b))
        digest, back, whole = hashlib.sha256(), hashlib.sha256(), []

        def tapped():
            for piece in emit(s, form, first, second):
                digest.update(piece.encode())
                if with_output:
                    whole.append(piece)
                yield piece

        for piece in rebuild(tapped(), form):
            back.update(piece.encode())
        cut = (None, None) if form == "plain" else (first, second - first)
        got = (s.units, form, *cut, digest.hexdigest(), back.hexdigest())
        return (*got, "".join(whole)) if with_output else got

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 256):
                b = big.slice(lo, 256)
                cols = list(zip(*map(one, b.column(frames).to_pylist(), b.column(k_name).to_pylist())))
                yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array(c, k[2]) for c, k in zip(cols, kinds)],
                                                 [f.name for f in schema.fields])

    d = store.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{frames}`"), F.col(f"`{key}`").cast("string").alias(k_name))
    return map_arrow(d, run, schema)


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", frame_chars: int = FRAME_CHARS, **options) -> DataFrame:
    """Store and transform: ``docs`` without ``text``, plus the columns of :func:`transform`."""
    names = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output"]
    names = free_names(docs.drop(text), names if options.get("with_output") else names[:-1])
    frames = fresh(docs, "_frames")
    return transform(materialize(seekable_store(docs, text, frame_chars, frames), "seekable"), key, frames, out=names, **options)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP13_SQL = r"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
l AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS lines, ('0x' || substr(h, 1, 8))::BIGINT AS h1,
        ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM u),
c AS (SELECT *, len(lines) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a,
        greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
             WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM l),
p AS (SELECT *, array_to_string(list_slice(lines, 1, a), '') AS pre, array_to_string(list_slice(lines, a + 1, b), '') AS mid,
        array_to_string(list_slice(lines, b + 1, n), '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
         ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p"""
