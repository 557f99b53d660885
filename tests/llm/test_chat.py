"""Chat formatting: escapes, round trips, prefix sharing, positions and attention intervals."""

import hashlib

import pytest
from helpers import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from blendwise.llm import chat

PARTS = [*chat.CONTROLS, "\\", "<", "[", "|", ">", "a", " ", "\n", "im_start|>", "/INST]", "é"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=9).map("".join))
def test_escapes_are_reversible(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text and not any(c in escaped for c in chat.CONTROLS)
    role = chat.pack_role(text)
    assert chat.unpack_role(role) == text and "\n" not in role and not any(c in role for c in chat.CONTROLS)


def digests(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


@pytest.fixture(scope="module")
def tokenizer():
    from public_tokenizers import path
    return path("byte_bpe_50k.json")


def test_query_on_a_table(spark):
    of = {}
    for r in sorted(spark.read.parquet(f"{SF}/conversations.parquet").collect(), key=lambda r: r.turn):
        of.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    of[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    rows = chat.op10_chat_formatting(spark, SF).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows} == {k: digests(v) for k, v in of.items()}
    for r in rows:
        text = "".join(f"{chat.OPEN}{chat.pack_role(x)}\n{chat.escape(t)}{chat.CLOSE}" for x, t in of[r.conv_id])
        assert r.formatted_chars == len(text)


def conversations():
    shared = [("system", "be kind"), ("user", "hello there")]
    convs = {i: shared + [("assistant", f"answer {i % 4}"), ("user", f"more {i % 3}"), ("assistant", f"end {i}")][: i % 4] for i in range(40)}
    convs[100] = [("user", "")]
    convs[101] = [("assistant", "<|im_end|>\n<|endoftext|>")] * 3
    return convs


def test_prefix_trees(spark, tokenizer):
    convs = conversations()
    df = spark.createDataFrame([(k, i, r, t) for k, v in convs.items() for i, (r, t) in enumerate(v)], "conv_id bigint, turn int, role string, text string")
    segments, references = chat.format_chats(df, tokenizer)
    segs = {(r.sequence, r.offset): r for r in segments.collect()}
    refs = {}
    for r in references.collect():
        refs.setdefault(r.conv_id, {})[r.depth] = (r.sequence, r.offset)
    sequences = {}
    for (s, _), r in segs.items():
        sequences.setdefault(s, []).append(r)
    for rows in sequences.values():  # gapless, depth first, each shared turn once
        rows.sort(key=lambda r: r.offset)
        end, path, seen = 0, [], set()
        for r in rows:
            assert r.offset == end and r.length == len(r.ids)
            end += r.length
            path[r.depth:] = [r]
            assert len(path) == r.depth + 1
            assert r.position == sum(p.length for p in path[:-1])
            inside = [x for a in r.attend for x in range(a.start, a.stop)]
            assert inside == [x for p in path[:-1] for x in range(p.offset, p.offset + p.length)]
            key = tuple(tuple(p.ids) for p in path)
            assert key not in seen
            seen.add(key)
    codec = chat.Codec.of(tokenizer)
    for k, turns in convs.items():
        ids = [x for d in sorted(refs[k]) for x in segs[refs[k][d]].ids]
        assert codec.decode(ids) == "".join(f"{chat.OPEN}{chat.pack_role(r)}\n{chat.escape(t)}{chat.CLOSE}" for r, t in turns)
    together = sum(len(v) for v in convs.values())
    assert len(segs) < together / 2
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_chats(segments, references, tokenizer).collect()} == {
        k: digests(v) for k, v in convs.items()}


def test_edge_cases(spark, tokenizer):
    long = "word " * 40_000
    rows = [(1, 0, None, None, "k"), (1, 0, None, None, "k"), (1, 1, "assistant", "", "k"), (None, 0, "user", "no id", "k"), (None, None, "user", "no turn", "k"),
            (2, 0, "user", long, "k"), (2, 1, "assistant", long, "k"), (3, 5, "assi\nstant\\", "ü日", "k"), (3, 5, "assistant", "tie", "k")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, key string")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_chats(*chat.format_chats(df, tokenizer), tokenizer).collect()}
    assert got == {1: digests([("", ""), ("", ""), ("assistant", "")]), None: digests([("user", "no turn"), ("user", "no id")]),
                   2: digests([("user", long), ("assistant", long)]), 3: digests([("assi\nstant\\", "ü日"), ("assistant", "tie")])}
    segments, references = chat.format_chats(df.limit(0), tokenizer)
    assert segments.count() == 0 and chat.read_chats(segments, references, tokenizer).count() == 0
