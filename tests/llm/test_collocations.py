"""Phrase collocations against a direct count of all phrases."""

import random
import re
from collections import Counter
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import zstandard
from helpers import SF, ascii_lower, edge_documents

from blendwise.llm import collocations as co


def direct(rows, least, longest=5, top=2000):
    n, f = Counter(), {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        big = {p: a for p, a in counts.items() if a >= least and len(p) >= 2}
        inner = Counter()
        for p, a in big.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inner[p[i:i + m]] = max(inner[p[i:i + m]], a)
        found = []
        for p, a in big.items():
            if inner[p] and 100 * inner[p] >= 100 * a:
                continue
            score, k = min(((1000 * a * n[lang]) // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def run(spark, rows, least, **options):
    df = spark.createDataFrame(rows, "lang string, text string")
    return sorted(tuple(r) for r in co.collocations(df, least=least, **options).collect())


@pytest.mark.parametrize("seed,least,top", [(1, 2, 2000), (2, 5, 10), (3, 20, 3)])
def test_random_corpora(spark, seed, least, top):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "b", "é", "É", "日本", "x-y", "\x00", "q r", "w1", "w2", "w3"]
    rows = []
    for _ in range(150):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", ""]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "de", None, "und"]), text))
    rows += rows[:20] + [("en", None), ("en", "")]
    assert run(spark, rows, least, top=top) == direct(rows, least, top=top)


def test_long_phrases_and_slices(spark, monkeypatch):
    """Texts that are cut into many slices, and a piece longer than a slice."""
    rng = random.Random(4)
    text = "".join(rng.choice(["one", "two", "three", "Four"]) + rng.choice([" ", " ", " ", ","]) for _ in range(3000))
    cut = list(co._piece_slices(text.lower().encode(), 100))
    assert b"".join(cut) == text.lower().encode() and len(cut) > 50
    whole = ("alpha beta gamma delta " * 30_000).strip()
    assert list(co._piece_slices(whole.encode(), 1000)) == [whole.encode()]
    rows = [("en", text), ("de", whole), ("de", "." * 700_000 + "alpha beta")]
    assert run(spark, rows, 10) == direct(rows, 10)


@pytest.mark.parametrize("bits", [3, 5, 9])
def test_colliding_fingerprints_are_told_apart(spark, bits):
    """With keys of few bits nearly everything collides; checks differ and the text decides."""
    rng = random.Random(5)
    rows = [(rng.choice(["en", "de"]), " ".join(rng.choice("abcdefgh") for _ in range(40))) for _ in range(60)]
    tables = [co_table(rows[i::3]) for i in range(3)]
    with short_keys(bits):
        counts = [co._count_short((pa.scalar(p, pa.int64()),), t) for p, t in enumerate(tables)]
        known = co.frequent(spark.createDataFrame(pa.concat_tables(counts).to_pandas(), co.COUNTS), 30).toPandas()
        assert (known["own"] == 2).any()
        for shorter, longest in ((2, 3), (3, 5)):
            longer = []
            for p, t in enumerate(tables):
                mine = known[(known["part"] == p) & (known["key"] % 4 == shorter)]
                longer.append(co._longer_counter(shorter, longest)((pa.scalar(p, pa.int64()),), t, pa.table({"key": pa.array(mine["key"])})))
            known = pd.concat([known, co.frequent(spark.createDataFrame(pa.concat_tables(longer).to_pandas(), co.COUNTS), 30).toPandas()])
        got = Counter()
        for p, t in enumerate(tables):
            own = known[(known["part"] == p) & (known["own"] > 0)]
            for r in co._reader(5)(None, t, pa.Table.from_pandas(own, preserve_index=False)).to_pylist():
                got[r["lang"], r["n_words"], r["phrase"]] += r["times"]
    want = Counter()
    for lang, t in rows:
        w = t.split()
        for k in range(1, 6):
            for i in range(len(w) - k + 1):
                want[lang, k, " ".join(w[i:i + k])] += 1
    assert {k: v for k, v in got.items() if k[1] and v >= 30} == {k: v for k, v in want.items() if v >= 30}


def co_table(rows):
    made = {}
    for i, (lang, t) in enumerate(rows):
        made.setdefault(i // 10, []).append((lang, t.encode()))
    zip_ = zstandard.ZstdCompressor()
    return pa.table({"langs": [[x for x, _ in g] for g in made.values()], "sizes": [[len(t) for _, t in g] for g in made.values()],
                     "times": [[1] * len(g) for g in made.values()],
                     "data": pa.array([zip_.compress(b"".join(t for _, t in g)) for g in made.values()], pa.binary())})


@contextmanager
def short_keys(bits):
    real = co._key_and_check

    def short(w, n, at):
        key, check = real(w, n, at)
        return key & np.uint64((1 << bits) - 1), check

    co._key_and_check = short
    try:
        yield
    finally:
        co._key_and_check = real


def test_products_beyond_64_bits(spark):
    phrases = spark.createDataFrame([("en", 1, "a", 4 * 10**12), ("en", 1, "b", 10**12), ("en", 2, "a b", 10**12)],
                                    "lang string, n_words int, phrase string, f bigint")
    n = spark.createDataFrame([("en", 9 * 10**13)], "lang string, n bigint")
    r = co.score_collocations(phrases, n).collect()[0]
    assert r.score == 1000 * 10**12 * 9 * 10**13 // (4 * 10**12 * 10**12)


def test_query_on_a_table(spark):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = co.op11_phrase_collocations(spark, SF)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == direct(rows, 100)


def test_edge_cases(spark):
    docs = edge_documents(spark)
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert sorted(tuple(r) for r in co.collocations(docs, least=2).collect()) == direct(rows, 2)
    assert co.collocations(docs.limit(0)).count() == 0


def test_one_phrase_in_a_third_of_all_rows(spark):
    rows = [("en", f"hot phrase here, u{i} v{i}" if i % 3 == 0 else f"x{i} y{i % 7}") for i in range(900)]
    assert run(spark, rows, 50) == direct(rows, 50)


def test_rare_triples_of_frequent_pairs_are_not_sent_one_by_one(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"word{i}" for i in range(30)]
    rows = [(rng.choice(["en", "de"]), " ".join([*rng.choices(words, k=60), *words[:4]])) for _ in range(1200)]
    made, real = [], co.frequent
    monkeypatch.setattr(co, "frequent", lambda counts, least: made.append(counts) or real(counts, least))
    assert run(spark, rows, 30) == direct(rows, 30)
    triples = {(lang, *w[i:i + 3]) for lang, t in rows for w in [t.split()] for i in range(len(w) - 2)}
    sent = sum(m.filter("shiftrightunsigned(a, 16) & 3 = 3").count() for m in made)  # triples and longer phrases, per part
    assert len(triples) > 30_000 and sent < 2_000


def test_buckets_are_summed_over_parts_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(co, "RANGE_BITS", 4)
    rng = random.Random(7)
    rows = [("en", " ".join(rng.choices("abcdefghij", k=50))) for _ in range(100)]
    tables = [co_table(rows[i::3]) for i in range(3)]
    got = pa.concat_tables([co._bucket_counter(3, 64, 80)((pa.scalar(p, pa.int64()),), t) for p, t in enumerate(tables)])
    full = pa.concat_tables([co._filled(80)((pa.scalar(r, pa.int64()),), got.filter(pa.compute.equal(got["range"], r))) for r in range(8)])
    held, sums = [Counter() for _ in tables], Counter()
    for counts, t in zip(held, tables):
        for w in co._words_of(t):
            for n in (2, 3):
                counts.update(co._bucket(co._key_and_check(w, n, np.flatnonzero(w.inside(n)))[0], n, 64).tolist())
        sums.update(counts)
    assert min(sums) < 64 <= max(sums) < 128 and min(sums.values()) < 80 <= max(sums.values())
    for p, counts in enumerate(held):
        assert co._places(full.filter(pa.compute.equal(full["part"], p))).tolist() == sorted(b for b in counts if sums[b] >= 80)
