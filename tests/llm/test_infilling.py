"""Fill-in-the-middle against a direct version on whole strings."""

import hashlib
import random
import re

import pytest
from helpers import SF, edge_documents

from blendwise.llm import infilling


def direct(key, text, fim=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    d = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(lines)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim:
        return n, "plain", None, None, text
    pre, mid, suf = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if h4 % 100 < spm:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def sha(t):
    return hashlib.sha256((t or "").encode()).hexdigest()


def random_texts(seed, n=300):
    rng = random.Random(seed)
    bits = ["a", "é", "日", "\n", "\n\n", "<", "P>", "<P", ">", " x ", "𝄞", "\r", "<Q>"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_frames(size):
    for t in random_texts(size, 100):
        s = infilling.SeekableText.of([t[:3], t[3:]], size)
        lines = re.findall(r"[^\n]*\n|[^\n]+", t)
        assert (s.units, s.chars) == (len(lines), len(t))
        assert "".join(s.stream()) == t
        for u in range(len(lines) + 1):
            assert s.place(u) == len("".join(lines[:u]))
        for a in range(0, len(t), 3):
            for b in (a, a + 1, a + 5, len(t)):
                assert "".join(s.stream(a, min(b, len(t)))) == t[a:b]


def test_a_frame_is_decompressed_alone(monkeypatch):
    s = infilling.SeekableText.of(["line\n" * 1000], 64)
    seen = []
    plain = s.frame
    monkeypatch.setattr(s, "frame", lambda i: seen.append(i) or plain(i))
    assert s.place(700) == 3500 and len(seen) == 1


@pytest.mark.parametrize("fim,spm", [(100, 50), (50, 0), (50, 100), (0, 50)])
def test_outputs(spark, fim, spm):
    texts = random_texts(fim + spm)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = infilling.fill_in_middle(docs, frame_chars=5, fim_percent=fim, spm_percent=spm, with_output=True).collect()
    assert len(got) == len(texts)
    for r in got:
        n, form, p, m, out = direct(r.doc_id, texts[r.doc_id], fim, spm)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == (n, form, p, m, out)
        assert r.output_sha256 == sha(out) and r.restored_sha256 == sha(texts[r.doc_id])


def test_broken_output_is_refused():
    with pytest.raises(ValueError):
        list(infilling.rebuild(["<P>a<M>b"], "psm"))


def test_query_on_a_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = infilling.op13_fill_in_middle(spark, SF)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    rows = got.collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, form, p, m, out = direct(r.doc_id, docs[r.doc_id])
        assert tuple(r) == (r.doc_id, n, form, p, m, sha(out), sha(docs[r.doc_id]))


def test_edge_cases(spark):
    docs = edge_documents(spark).withColumnRenamed("set", "form").withColumnRenamed("key", "_frames")
    got = infilling.fill_in_middle(docs)
    assert set(docs.columns) - {"text"} <= set(got.columns)
    assert got.filter("form = 'clash'").count() == docs.count()  # the user's column stays, the output is form1
    want = sorted(repr((r.doc_id, *direct(r.doc_id, r.text)[:2], sha(direct(r.doc_id, r.text)[4]), sha(r.text))) for r in docs.collect())
    # the extra column "n" keeps its name too
    assert sorted(repr((r.doc_id, r.n1, r.form1, r.output_sha256, r.restored_sha256)) for r in got.collect()) == want
    assert infilling.fill_in_middle(docs.limit(0)).count() == 0


def test_very_long_text(spark):
    long = "line one\nsecond line\n" * 150_000 + "x" * 200_000
    docs = spark.createDataFrame([(3, long), (4, "\n" * 500_000), (5, " " * 500_000)], "doc_id bigint, text string")
    for r in infilling.fill_in_middle(docs).collect():
        text = {3: long, 4: "\n" * 500_000, 5: " " * 500_000}[r.doc_id]
        n, form, p, m, out = direct(r.doc_id, text)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, p, m, sha(out), sha(text))
