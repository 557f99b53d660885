"""Best-fit packing: the histogram plan against piece-by-piece best fit, token ids against the tokenizer."""

import bisect
import random
import zlib

import numpy as np
from helpers import SF, edge_documents
from hypothesis import given, settings
from hypothesis import strategies as st

from blendwise.llm import bestfit


def brute_bins(lengths, capacity):
    rooms, bins = [], 0
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, n)
        if i == len(rooms):
            bins, room = bins + 1, capacity
        else:
            room = rooms.pop(i)
        if room - n:
            bisect.insort(rooms, room - n)
    return bins


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 80).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=150))))
def test_plan_is_best_fit_decreasing(case):
    capacity, lengths = case
    histogram = {n: lengths.count(n) for n in set(lengths)}
    bins = {}
    for n, _, pieces, first, per, at in bestfit.plan_runs(histogram, capacity):
        for r in range(pieces):
            bins.setdefault(first + r // per, []).append((at + r % per * n, n))
    for content in bins.values():
        end = 0
        for at, n in sorted(content):
            assert at == end
            end += n
        assert end <= capacity
    assert sorted(n for c in bins.values() for _, n in c) == sorted(lengths)
    assert len(bins) == brute_bins(lengths, capacity)


def test_cut_points():
    for n in range(1, 60):
        cuts = bestfit.cut_points(n, 7)
        assert [s for s, _ in cuts] == [sum(m for _, m in cuts[:i]) for i in range(len(cuts))]
        assert sum(m for _, m in cuts) == n and all(m == 7 for _, m in cuts[1:]) and 1 <= cuts[0][1] <= 7
        assert len(cuts) == -(-n // 7)


def test_ids_equal_the_tokenizer():
    encoder = bestfit.PieceEncoder.of(*bestfit.byte_bpe_50k())
    rng = random.Random(5)
    parts = ["a", "bc", " ", "  ", "\n", "\t", "'s", "'", "1", "!", "é", "日本", "<|endoftext|>", "\r", "\x85", " the", "\x1c", "​", "\x00", "²", "Ⅷ"]
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert encoder.encode(t) == np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def check(rows, texts, capacity=1024):
    encoder = bestfit.PieceEncoder.of(*bestfit.byte_bpe_50k())
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for key, text in texts.items():
        ids = encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        for i, r in enumerate(sorted(by_doc[key], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (i, at)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values(), default=0) <= capacity
    assert len(filled) == brute_bins([r.length for r in rows], capacity)


def test_query_on_a_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check(bestfit.op3_best_fit_packing(spark, SF).collect(), docs)


def test_edge_cases(spark):
    docs = edge_documents(spark)
    rows = docs.select("text").collect()
    numbered = spark.createDataFrame([(i, r.text, "clash", 3) for i, r in enumerate(rows)], "doc_id bigint, text string, piece_ string, ids int")
    got = bestfit.pack_documents(numbered, bestfit.byte_bpe_50k(), ["doc_id"]).collect()
    check(got, {i: r.text for i, r in enumerate(rows)})
    repeated = bestfit.pack_documents(docs, bestfit.byte_bpe_50k(), ["doc_id"]).collect()
    assert len(repeated) == len(got)  # repeated ids and rows are packed once each
    assert len({(r.sequence_id, r.offset) for r in repeated}) == len(repeated)
    assert bestfit.pack_documents(docs.limit(0), bestfit.byte_bpe_50k(), ["doc_id"]).count() == 0


def test_ids_are_kept_on_request(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, None)], "doc_id bigint, text string")
    rows = bestfit.pack_documents(docs, bestfit.byte_bpe_50k(), ["doc_id"], capacity=2, with_ids=True).collect()
    of = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        of.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert of == {1: [31373, 995, 2], 2: [2]}


def test_white_space_without_end(spark):
    """Texts on which the fast form of the vocabulary gives up have the tokenizer's ids, through the whole operator."""
    from tokenizers import Tokenizer

    texts = [" " * 2_000_000, "\n" * 2_000_000, "\n \t" * 700_000, "words and" + " " * 1_500_000 + "more words", " \u3000\u00a0" * 300_000, "plain words"]
    tokenizer = Tokenizer.from_file(bestfit.byte_bpe_50k()[0])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = bestfit.pack_documents(docs, bestfit.byte_bpe_50k(), ["doc_id"], with_ids=True).collect()
    for i, t in enumerate(texts):
        pieces = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        ids = np.frombuffer(b"".join(bytes(r.ids) for r in pieces), "<u4")
        assert ids.tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
