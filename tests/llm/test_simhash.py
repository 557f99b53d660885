"""SimHash: votes bit by bit, neighbours against all pairs, successors, edge cases."""

import hashlib
import random

from helpers import SF, edge_documents

from blendwise.llm import simhash
from blendwise.llm.common import window_hashes, word_hashes


def brute(text):
    h, _ = word_hashes([text], lower=True)
    terms = window_hashes(h, 2) if len(h) > 1 else h
    return sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in terms) > len(terms))


def test_votes():
    rng = random.Random(1)
    texts = [b" ".join(rng.choice([b"a", b"B", b"cd", b"\xc3\xa9x", b"", b"\n"]) for _ in range(rng.choice([0, 1, 2, 3, 40, 700]))) for _ in range(60)]
    texts += [None, b"", b"  ", b"x"]
    assert [int(x) for x in simhash.fingerprints(texts)] == [brute(t) for t in texts]


def test_all_neighbours_are_found(spark):
    rng = random.Random(2)
    fps = [rng.getrandbits(64) for _ in range(200)]
    for f in list(fps):
        fps.append(f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps] + [(None,)], "fingerprint bigint")
    for radius, blocks in ((3, 6), (2, 4), (0, 1)):
        got = sorted((r.fingerprint, r.near, r.distance) for r in simhash.find_near(df, df, radius, blocks).collect())
        assert got == sorted((signed(a), signed(b), (a ^ b).bit_count()) for a in set(fps) for b in set(fps) if a != b and (a ^ b).bit_count() <= radius)


def check(rows, docs):
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, hashlib.md5((d[1] or "").encode()).digest()))
    want = []
    for i, (key, text) in enumerate(docs):
        text, following = text or "", docs[(i + 1) % len(docs)][1] or ""
        n = len(text)
        edited = text[: n - n // 4] + following[: n // 4]
        a, b, c = brute(text.encode()), brute(edited.encode()), brute(following.encode())
        want.append((key is not None, key or 0, n, hashlib.sha256(edited.encode()).hexdigest(), f"{a:016x}", f"{b:016x}",
                     round(1 - (a ^ b).bit_count() / 64, 9), round(1 - (a ^ c).bit_count() / 64, 9)))
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint,
                  round(r.near_edited, 9), round(r.near_next, 9)) for r in rows)
    assert got == sorted(want)


def near_counts(rows):
    """The neighbour search against all rows, copies included."""
    for i, r in enumerate(rows):
        mine = int(r.fingerprint, 16)
        want = sum(j != i and (int(x.fingerprint, 16) ^ mine).bit_count() <= simhash.RADIUS for j, x in enumerate(rows))
        assert r.n_near == (want if r.doc_id is not None and r.doc_id % 20 == 0 else None)


def test_copies_are_neighbours(spark):
    rng = random.Random(4)
    base = [f"{rng.getrandbits(64):016x}" for _ in range(6)] + ["0" * 16]
    near = [f"{int(f, 16) ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64):016x}" for f in base]
    rows = [(i if i % 11 else None, base[0]) for i in range(120)] + [(1000 + i, rng.choice(base + near)) for i in range(200)] + [(2000, "f" * 16)]
    got = simhash.with_near_counts(spark.createDataFrame(rows, "doc_id bigint, fingerprint string")).collect()
    assert len(got) == len(rows)
    near_counts(got)
    assert max(r.n_near or 0 for r in got) >= 119 and [r.n_near for r in got if r.doc_id == 2000] == [0]


def test_query_on_a_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text) < 1500]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    check(simhash.compare_edited(df).collect(), docs)
    rows = simhash.op7_simhash(spark, SF).collect()
    assert len(rows) == 200
    near_counts(rows)
    assert sum(r.near_edited for r in rows) / 200 > 0.7 > 0.6 > sum(r.near_next for r in rows) / 200


def test_edge_cases(spark):
    docs = edge_documents(spark).filter("length(text) < 1000 or text is null")
    check(simhash.compare_edited(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert simhash.compare_edited(docs.limit(0)).count() == 0
    one = spark.createDataFrame([(4, "only one row here")], "doc_id bigint, text string")
    check(simhash.compare_edited(one).collect(), [(4, "only one row here")])
    long = edge_documents(spark).filter("doc_id in (5, 6)")
    a, b = simhash.compare_edited(long).collect()
    assert a.fingerprint == b.fingerprint and a.near_next == 1.0
    assert simhash.add_fingerprint(edge_documents(spark)).count() == 14
