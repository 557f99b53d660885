"""Near-duplicates against an exact all-pairs version; components against union-find."""

import random

import numpy as np
import pytest
from helpers import SF, ascii_lower, edge_documents, words

from blendwise.llm import neardup
from blendwise.llm.components import components


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def brute(texts, k, percent=80):
    sets = []
    for t in texts:
        w = words(ascii_lower(t))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    u = Union()
    for i, a in enumerate(sets):
        u.find(i)
        for j in range(i):
            b = sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    u.join(i, j)
    return [len(s) for s in sets], [u.find(i) for i in range(len(sets))]


@pytest.mark.parametrize("shape", ["path", "star", "random", "clique", "empty"])
def test_components(spark, shape):
    rng = random.Random(4)
    edges = {"path": [(i, i + 1) for i in range(60)], "star": [(7, i) for i in range(50)],
             "random": [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)],
             "clique": [(i, j) for i in range(12) for j in range(12)], "empty": []}[shape]
    u = Union()
    for a, b in edges:
        u.join(a, b)
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    assert {r.id: r.label for r in components(df).collect()} == {x: u.find(x) for x in u.up if u.find(x) != x}


@pytest.mark.parametrize("k", [2, 5])
def test_against_all_pairs(spark, k):
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 30, 60, 90]))] for _ in range(12)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    texts = []
    for b in bases:
        for _ in range(rng.randint(1, 14)):  # chains of ever more edited copies, around the threshold
            b = list(b)
            for _ in range(rng.randint(0, 3)):
                b[rng.randrange(len(b))] = rng.choice(vocabulary)
            texts.append(" ".join(b).upper() if rng.random() < 0.2 else " ".join(b))
    texts += [" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randint(1, 60))]) for _ in range(60)]
    texts += texts[:9] + ["", None, " "]
    n, label = brute(texts, k)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = neardup.near_duplicates(df, shingle=k).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in got} == {i: (n[i], label[i]) for i in range(len(texts))}
    kept = neardup.drop_near_duplicates(df, shingle=k).collect()
    # texts without words stay, but rows equal in id and text never repeat
    assert sorted(r.doc_id for r in kept) == [i for i in range(len(texts)) if label[i] == i]


def test_query_on_a_table(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    n, label = brute([t for _, t in docs], 2)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.op6_minhash_near_dedup(spark, SF).collect()}
    assert got == {k: (n[i], docs[label[i]][0], label[i] == i) for i, (k, _) in enumerate(docs)}


def test_star_rounds_and_blocks(spark, monkeypatch):
    """The same result with further star rounds first, and with blocks of a few members."""
    rng = random.Random(9)
    base = [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(i % 50) for i in range(80)]
    texts = []
    for _ in range(90):
        base = list(base)
        base[rng.randrange(80)] = str(rng.random())
        texts.append(" ".join(base))
    _, label = brute(texts, 2)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for block, rounds in ((7, 20), (2048, 0)):
        monkeypatch.setattr(neardup, "BLOCK", block)
        monkeypatch.setattr(neardup, "STAR_ROUNDS_WHILE", rounds)
        got = {r.id: r.component_id for r in neardup.near_duplicates(df).collect()}
        assert got == dict(enumerate(label))


def test_masks_meet_every_pair_below_the_guarantee():
    rng = np.random.default_rng(3)
    reach = neardup.CHUNKS * (neardup.ERRORS + 1) - 1
    a = rng.integers(0, 65536, (200, neardup.SYMBOLS + neardup.EXTRA)).astype("<u2")
    b = a.copy()
    for i in range(len(b)):
        b[i, rng.choice(neardup.SYMBOLS, reach, replace=False)] ^= 1
    assert (neardup.chunk_keys(a) == neardup.chunk_keys(b)).any(axis=1).all()


def test_edge_cases(spark):
    docs = edge_documents(spark)
    rows = docs.collect()
    got = neardup.near_duplicates(docs, shingle=5).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.id in (5, 6)} == {5}
    assert {r.component_id for r in got if r.id in (7, -9)} == {-9}
    assert {r.component_id for r in got if r.id == 2} == {2}
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect())
    assert [x[1] for x in ids if not x[0]] == [-9, 1, 1, 2, 3, 4, 5, 8, 20]  # one of the two equal rows, one of the copies
    assert neardup.near_duplicates(docs.limit(0)).count() == 0 and neardup.drop_near_duplicates(docs.limit(0)).count() == 0
