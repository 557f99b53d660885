"""Chat formatting as prefix trees.

Conversations that share their first turns are merged: a shared turn is one
node.  The nodes of a tree are emitted depth first, each shared turn once; every
emitted segment carries its token ids, its place (``offset``) in the emitted
sequence, its ``position`` (ids before it on the path from the root, so position
ids count as if its conversation stood alone) and the intervals of the sequence it
may attend to (its ancestors; inside the segment attention is causal).

How it runs: each conversation gets a sort key, the chained digests of its turns.
Sorting by that key puts conversations in depth-first order, so within a range
partition one streaming pass with a stack emits every tree: the turns a
conversation shares with the one before it are on the stack, the others are new
segments.  A tree that is split between range partitions (a first turn shared by a
third of all conversations) gives one sequence per partition, and each of them
starts by emitting the path of its first conversation; no task gathers a tree.

Template: ``<|im_start|>role\\n text <|im_end|>\\n`` without the blanks.  A control string
inside a text or role gets a backslash after its first character (one more where
there already are some), which is undone on reading.

Defined results: null text or role is empty; rows of a conversation are ordered by
(turn, role, text), nulls first; repeated rows are repeated turns; rows with a
null conv_id are one conversation; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blendwise.llm.common import map_arrow, materialize, row_slices, splits_for, table

# Control strings of common chat templates.  Each starts with "<" or "[", and none
# contains another one's start in a way that lets two of them overlap.
CONTROLS = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]",
            "<<SYS>>", "<</SYS>>", "<|system|>", "<|user|>", "<|assistant|>"]
_BODY = "|".join(rf"{re.escape(c[0])}(?=\\*{re.escape(c[1:])})" for c in CONTROLS)
_ESCAPE = re.compile(rf"(?:{_BODY})")
_UNESCAPE = re.compile("|".join(rf"(?<={re.escape(c[0])})\\(?=\\*{re.escape(c[1:])})" for c in CONTROLS))
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    """Put one backslash after the first character of every (possibly already escaped) control string."""
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub("", text)


def pack_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unpack_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def chain(turns: list[tuple[str, str]]) -> bytes:
    """Chained 16-byte digests of the turns: equal prefixes have equal beginnings."""
    out, last = [], b""
    for role, text in turns:
        r = role.encode()
        last = hashlib.blake2b(last + len(r).to_bytes(8, "little") + r + text.encode(), digest_size=16).digest()
        out.append(last)
    return b"".join(out)


class Codec:
    """Token ids of a template piece and back; special tokens in texts are ordinary text."""

    _made: dict[str, Codec] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def decode(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=False)


def _merge(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in intervals:
        if out and out[-1][1] == a:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


SEGMENTS = ("kind string, sequence string, conv_id bigint, depth int, offset bigint, length int, position bigint, "
            "ids array<int>, loss_start int, loss_length int, attend array<struct<start:bigint,stop:bigint>>")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = [chain([(t["role"], t["text"]) for t in turns]) for turns in b.column("turns").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(keys, pa.binary()), b.column("turns")],
                                         ["conv_id", "key", "turns"])


def _emitter(tokenizer: str):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(tokenizer)
        pid = TaskContext.get().partitionId()
        stack: list[tuple[int, int, int]] = []  # per depth: offset, length, position
        last, seq, end = b"", "", 0
        for b in row_slices(batches, "key", 1 << 20):
            rows = b.to_pylist()
            new, pieces = [], []
            for r in rows:
                key, shared = r["key"], 0
                while shared < len(last) and last[shared:shared + 16] == key[shared:shared + 16] and shared < len(key):
                    shared += 16
                new.append(shared // 16)
                for t in r["turns"][shared // 16:]:
                    pieces += [f"{OPEN}{pack_role(t['role'])}\n", escape(t["text"]), CLOSE]
                last = key
            ids = iter(codec.encode(pieces))
            out = []
            for r, kept in zip(rows, new):
                if not kept:
                    seq, end = f"{pid}-{r['key'][:16].hex()}", 0
                stack = stack[:kept]
                for depth, t in enumerate(r["turns"][kept:], kept):
                    head, body, tail = next(ids), next(ids), next(ids)
                    position = stack[-1][1] + stack[-1][2] if stack else 0
                    whole, loss = head + body + tail, t["role"] == LOSS_ROLE
                    attend = _merge([(o, o + n) for o, n, _ in stack])
                    out.append(("segment", seq, r["conv_id"], depth, end, len(whole), position, whole,
                                len(head) if loss else 0, len(body) if loss else 0,
                                [{"start": a, "stop": z} for a, z in attend]))
                    stack.append((end, len(whole), position))
                    end += len(whole)
                # a conversation is the path from the root to its last turn: one reference per turn
                for depth, (o, n, p) in enumerate(stack):
                    out.append(("turn", seq, r["conv_id"], depth, o, n, p, None, 0, 0, None))
            cols = list(zip(*out)) if out else [[]] * len(_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)
    return emit


_ARROW = pa.schema([
    ("kind", pa.string()), ("sequence", pa.string()), ("conv_id", pa.int64()), ("depth", pa.int32()),
    ("offset", pa.int64()), ("length", pa.int32()), ("position", pa.int64()), ("ids", pa.list_(pa.int32())),
    ("loss_start", pa.int32()), ("loss_length", pa.int32()),
    ("attend", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
])


def format_chats(turns: DataFrame, tokenizer: str) -> tuple[DataFrame, DataFrame]:
    """``turns(conv_id, turn, role, text)`` -> (segments, references), both read from a table in the shared folder.

    segments: one row per emitted node, see the module text.  references: one
    row per turn of every conversation, pointing at its segment by (sequence, offset)."""
    t = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = turns.groupBy(F.col("conv_id").cast("bigint").alias("conv_id")).agg(
        F.sort_array(F.collect_list(t)).alias("turns"))
    keyed = map_arrow(convs, _keyed, f"conv_id bigint, key binary, turns {convs.schema['turns'].dataType.simpleString()}")
    n = splits_for(turns.sparkSession, 0, 1) * 2
    n = max(n, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = keyed.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    made = materialize(map_arrow(ordered, _emitter(tokenizer), SEGMENTS), "chat")
    return (made.filter("kind = 'segment'").drop("kind"),
            made.filter("kind = 'turn'").select("sequence", "conv_id", "depth", "offset"))


READ = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint, n_ids bigint")


def _reader(tokenizer: str):
    pattern = re.compile(rf"{re.escape(OPEN)}(.*?)\n(.*){re.escape(CLOSE)}", re.S)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(tokenizer)
        for b in batches:
            out = []
            for r in b.to_pylist():
                turns, loss, under_mask = hashlib.sha256(), hashlib.sha256(), 0
                chars = n_ids = 0
                for s in r["segments"]:
                    whole = codec.decode(s["ids"])
                    role, text = pattern.fullmatch(whole).groups()
                    turns.update(f"{unpack_role(role)}\n{unescape(text)}\n".encode())
                    if s["loss_length"]:
                        masked = unescape(codec.decode(s["ids"][s["loss_start"]:s["loss_start"] + s["loss_length"]]))
                        loss.update(masked.encode())
                        under_mask += len(masked)
                    chars += len(whole)
                    n_ids += len(s["ids"])
                out.append((r["conv_id"], len(r["segments"]), turns.hexdigest(), under_mask, loss.hexdigest(), chars, n_ids))
            cols = list(zip(*out)) if out else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in READ.split(", ")])
    return read


def read_chats(segments: DataFrame, references: DataFrame, tokenizer: str) -> DataFrame:
    """Conversations read back from the emitted ids: turns, masked text and lengths, as digests."""
    parts = references.join(segments.select("sequence", "offset", "ids", "loss_start", "loss_length"), ["sequence", "offset"])
    convs = parts.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("depth", "ids", "loss_start", "loss_length"))).alias("segments"))
    return map_arrow(convs, _reader(tokenizer), READ)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    tokenizer = path("byte_bpe_50k.json")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    segments, references = format_chats(turns.unionByName(extra), tokenizer)
    return read_chats(segments, references, tokenizer).drop("n_ids")
