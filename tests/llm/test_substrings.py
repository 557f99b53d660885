"""Substring dedup against a brute-force count of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import SF, edge_documents, words

from blendwise.llm import substrings
from blendwise.llm.common import text_digest


def brute(texts, width):
    ws = [words(t) for t in texts]
    seen = Counter(tuple(w[i:i + width]) for w in ws for i in range(len(w) - width + 1))
    out = []
    for w in ws:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i:i + width])] > 1:
                gone[i:i + width] = [True] * width
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("width", [1, 2, 5, 8, 35])
def test_random_corpora(spark, width):
    rng = random.Random(width)
    passages = [[rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 3 * width))] for _ in range(12)]
    texts = []
    for _ in range(120):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += rng.choice(passages) if rng.random() < 0.5 else [str(rng.random()) for _ in range(rng.randint(1, width))]
        texts.append(rng.choice([" ", "\n", "  "]).join(w))
    texts += texts[:5]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = substrings.repeated_spans(df, width=width, with_text=True)
    got = df.select("doc_id", text_digest(df["text"]).alias("digest")).join(found, "digest").collect()
    want = brute(texts, width)
    assert len(got) == len(texts)
    for r in got:
        n, gone, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())
        assert sum(s.length for s in r.repeats or []) == gone
        assert r.kept == (kept if gone else None)


def test_packed_keys():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 32, n, dtype=np.uint32))
        assert (substrings.unpack_keys(substrings.pack_keys(keys)) == keys).all()
    edge = np.array([0, 1, 255, 256, 65535, 65536, (1 << 32) - 1], np.uint32)
    assert (substrings.unpack_keys(substrings.pack_keys(edge)) == edge).all()


def test_query_on_a_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = dict(zip(docs, brute(docs.values(), 35)))
    got = substrings.op2_substring_dedup(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        n, gone, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())


def test_edge_cases(spark):
    docs = edge_documents(spark)
    out = substrings.dedup_substrings(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    rows = docs.collect()
    want = brute([r.text for r in rows], 35)
    expected = sorted((r.doc_id or 0, w[2] if w[1] else r.text or "") for r, w in zip(rows, want))
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == expected
    assert substrings.dedup_substrings(docs.limit(0)).count() == 0
    assert sum(r.text is None for r in out.collect()) == 2  # null texts stay null
