"""Decontamination against a brute-force search of all windows."""

import random
import time
from collections import Counter

import numpy as np
from helpers import SF, edge_documents, plain_words

from blendwise.llm import decontam


def bag(w, k):
    return Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def brute(docs, items, short_documents=False):
    """All windows; items that share no shingle with a document are left out, their similarity is 0."""
    out = {}
    of = {i: plain_words(t) for i, t in items}
    wanted = {i: bag(item, min(5, len(item))) for i, item in of.items() if item}
    for key, text in docs:
        w = plain_words(text)
        held = {k: bag(w, k) for k in range(1, 6)}
        for i, want in wanted.items():
            k, width = min(5, len(of[i])), len(of[i])
            if not held[k].keys() & want.keys():
                continue
            if short_documents:
                width = min(width, len(w))
            for p in range(len(w) - width + 1):
                mine = bag(w[p:p + width], k)
                both = (mine & want).total()
                likeness = both / (mine.total() + want.total() - both)
                if likeness >= 0.8 and ((key, i) not in out or likeness > out[key, i][1]):
                    out[key, i] = (p, likeness)
    return out


def found(df):
    return {(r.id, r.item_id): (r.start_word, r.similarity) for r in df.collect()}


def test_edited_and_shifted_leaks(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(12, 59)))) for i in range(25)]
    docs = []
    for d in range(150):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        if d % 2:
            leak = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, 2)):
                j = rng.randrange(len(leak))
                leak[j:j + 1] = rng.choice([[], [rng.choice(vocabulary)], [leak[j], "new"]])
            at = rng.randint(0, len(w))
            w[at:at] = leak[rng.randint(0, 3):]
        docs.append((d, rng.choice([" ", "\n", ", "]).join(w).upper() if d % 3 == 0 else " ".join(w)))
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(docs, items)
    assert len(want) > 30 and any(v[1] < 1 for v in want.values())
    assert found(decontam.find_leaks(d, b)) == want
    clean = {r.doc_id for r in decontam.drop_contaminated(d, b).collect()}
    assert clean == {k for k, _ in docs} - {k for k, _ in want}


def test_a_benchmark_in_several_slices(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = found(decontam.find_leaks(docs, items))
    monkeypatch.setattr(decontam, "SLICE_ROWS", 15)
    assert found(decontam.find_leaks(docs, items)) == whole
    assert decontam.drop_contaminated(docs, items).count() == docs.count() - len({k for k, _ in whole})


def test_query_on_a_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): (r.start_word, r.similarity) for r in decontam.op8_decontamination(spark, SF).collect()}
    assert got == brute(docs, items, short_documents=True) and len(got) >= 1  # all documents, all items


def test_block_tables_give_all_items_within_the_radius():
    rng = random.Random(8)
    index = decontam.ItemIndex([(i, " ".join(str(rng.random())[2:6] for _ in range(20)).encode()) for i in range(60)])
    for _ in range(300):
        base = int(index.prints[rng.randrange(60)])
        probe = base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 26)))
        assert index.within(probe) == {n for n, p in enumerate(index.prints.tolist()) if (p ^ probe).bit_count() <= decontam.RADIUS}


def test_edge_cases(spark):
    docs = edge_documents(spark)
    items = spark.createDataFrame([(1, "cat sat on the mat with the mit license"), (2, None), (3, ""), (4, "!!"), (5, "another text under the same id"),
                                   (5, "another text under the same id"), (None, "w1 of1 w2 of2 w3 of3 w4 of4")], "item_id bigint, text string")
    rows = decontam.find_leaks(docs, items).collect()
    assert sorted((r.id, -1 if r.item_id is None else r.item_id, r.start_word) for r in rows) == [
        (1, 1, 1), (1, 1, 1), (1, 5, 0), (1, 5, 0), (5, -1, 2), (6, -1, 2)]
    kept = decontam.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [-9, 0, 0, 2, 3, 4, 7, 8, 20]
    assert decontam.find_leaks(docs.limit(0), items).count() == 0
    assert decontam.find_leaks(docs, items.limit(0)).count() == 0
    assert decontam.drop_contaminated(docs, items.limit(0)).count() == docs.count()


def test_documents_shorter_than_the_item(spark):
    words = [f"w{i}" for i in range(100)]
    short = [f"s{i}" for i in range(12)]
    items = [(1, " ".join(words)), (2, " ".join(short))]
    docs = [(1, " ".join(words[:-1])), (2, " ".join(words[1:])), (3, " ".join(words[:50] + words[51:])), (4, " ".join(words[:60])),
            (5, " ".join(short[:11])), (6, " ".join(short[:5])), (7, "w1"), (8, ""), (9, " ".join(words)), (10, " ".join(words[:83]))]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    want = {}
    for key, text in docs:
        w = plain_words(text)
        for i, item in items:
            one = item.split()
            width = min(len(one), len(w))  # a shorter document is one window
            likeness = [(x & y).total() / (x | y).total() for p in range(len(w) - width + 1)
                        for x, y in [(bag(w[p:p + width], 5), bag(one, 5))]]
            if max(likeness) >= 0.8:
                want[key, i] = (likeness.index(max(likeness)), max(likeness))
    got = found(decontam.find_leaks(d, b, short_documents=True))
    assert got == want and got.keys() == {(1, 1), (2, 1), (3, 1), (5, 2), (9, 1), (10, 1)}
    assert got[1, 1][1] == 95 / 96 and {r.doc_id for r in decontam.drop_contaminated(d, b, short_documents=True).collect()} == {4, 6, 7, 8}
    lengths = {r.id: r.n_words for r in decontam.find_leaks(d, b, short_documents=True).collect()}
    assert lengths == {1: 99, 2: 99, 3: 99, 5: 11, 9: 100, 10: 83}


def test_query_and_pipeline_take_short_documents(spark, tmp_path):
    import corpus_pipeline

    words = [f"w{i}" for i in range(100)]
    spark.createDataFrame([(1, " ".join(words[:-1])), (2, "clean text")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, " ".join(words))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [(r.doc_id, r.item_id) for r in decontam.op8_decontamination(spark, str(tmp_path)).collect()] == [(1, 7)]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [r.doc_id for r in corpus_pipeline.leaks(spark, docs, str(tmp_path)).collect()] == [2]


def test_candidates_come_from_the_block_tables(monkeypatch):
    index = decontam.ItemIndex([(1, b"a b c d e f g h")])
    assert index.leaks([b"x a b c d e f g h y"]) == [[(1, 1, 8, 1.0, 0)]]
    monkeypatch.setattr(decontam.BlockTables, "within", lambda self, probes, kind: (np.zeros(0, int),) * 3)
    assert index.leaks([b"x a b c d e f g h y"]) == [[]]


def test_repeated_and_overlapping_words():
    """Texts and items of very few words: all windows hold shingles of many items, and bags hold them several times."""
    rng = random.Random(9)
    make = lambda n: " ".join(rng.choice("ab" if rng.random() < 0.9 else "abc") for _ in range(n))
    items = [(i, make(rng.randint(1, 30))) for i in range(40)] + [(100, "a " * 25), (101, "a b " * 12)]
    docs = [(d, make(rng.choice([0, 1, 4, 20, 24, 25, 200]))) for d in range(60)] + [(60, "a " * 300), (61, "b a " * 200)]
    for short in (False, True):
        near, of = {}, decontam.ItemIndex([(i, t.encode()) for i, t in items]).leaks([t.encode() for _, t in docs], short)
        for (d, _), rows in zip(docs, of):
            near.update({(d, r[0]): (r[1], r[3]) for r in rows})
        want = brute(docs, items, short)
        # the radius loses windows of similarity below 1, whose bits may differ in more than 20 places, and nothing else
        assert {k: v for k, v in want.items() if v[1] == 1} == {k: v for k, v in near.items() if v[1] == 1}
        assert near.keys() <= want.keys() and all(near[k][1] <= want[k][1] for k in near)
        assert len(near) > 200 and len(near) >= 0.95 * len(want), (len(near), len(want))


def test_all_windows_without_a_radius(monkeypatch):
    """With a radius of all bits the tables offer every item, and the result equals the search of all windows."""
    monkeypatch.setattr(decontam, "RADIUS", 64)
    rng = random.Random(11)
    items = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(1, 14)))) for i in range(30)]
    docs = [(d, " ".join(rng.choice("abcd") for _ in range(rng.choice([3, 9, 60, 400])))) for d in range(40)]
    for short in (False, True):
        rows = decontam.ItemIndex([(i, t.encode()) for i, t in items]).leaks([t.encode() for _, t in docs], short)
        got = {(d, r[0]): (r[1], r[3]) for (d, _), of in zip(docs, rows) for r in of}
        assert got == brute(docs, items, short) and len(got) > 100


def test_a_text_of_repeated_boilerplate_is_linear():
    index = decontam.ItemIndex([(i, b"lorem ipsum dolor sit amet " * 20 + b"lorem") for i in range(20)])
    for n in (2_000, 40_000):
        began = time.process_time()
        (rows,) = index.leaks([b"lorem ipsum dolor sit amet " * n])
        assert len(rows) == 20 and {r[1:] for r in rows} == {(0, 101, 1.0, 0)}
    assert time.process_time() - began < 10
