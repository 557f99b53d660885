"""The pipeline: every stage against what it was given, by brute force, and the subpackage's place in the library."""

import os
import re

import corpus_pipeline
from helpers import SF, edge_documents
from test_bestfit import check
from test_decontam import brute as brute_leaks
from test_neardup import brute as brute_near
from test_substrings import brute as brute_repeats

from blendwise.llm.common import materialize


def test_stages_on_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = sorted(docs.collect(), key=lambda r: r.doc_id)
        docs = materialize(stage(spark, docs, SF), f"test-{name}")
        after = {r.doc_id: r for r in docs.collect()} if name != "packing" else None
        if name != "packing":
            assert docs.columns == columns
        if name == "language":
            assert set(after) == {r.doc_id for r in before if r.text and any(c.isalpha() for c in r.text)}  # all of these texts are clean
        elif name == "near_duplicates":
            _, label = brute_near([r.text for r in before], 5)
            assert set(after) == {before[i].doc_id for i in range(len(before)) if label[i] == i} and len(after) < len(before)
        elif name == "repeated_passages":
            for r, (_, gone, kept) in zip(before, brute_repeats([r.text for r in before], 35)):
                assert after[r.doc_id].text == (kept if gone else r.text) and after[r.doc_id].n_chars == len(after[r.doc_id].text)
        elif name == "leaks":
            leaked = {k for k, _ in brute_leaks([(r.doc_id, r.text) for r in before if r.doc_id not in after], items)}
            assert set(after) | leaked == {r.doc_id for r in before} and not set(after) & leaked
        else:
            check(docs.collect(), {r.doc_id: r.text for r in before})


def test_edge_cases(spark):
    docs = edge_documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).count() == 0
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.count()
    name, stage = corpus_pipeline.STAGES[-1]
    assert stage(spark, docs, SF).count() >= docs.count() and stage(spark, docs.limit(0), SF).count() == 0


def test_the_rest_of_the_library_does_not_use_the_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, files in os.walk(os.path.join(root, "blendwise")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                assert not re.search(r"^\s*(from|import)\s+blendwise\.llm", open(os.path.join(folder, f)).read(), re.M), f


def test_registered_queries():
    import __spark_entry__ as e

    names = [n for n in e.queries() if re.fullmatch(r"op\d+_\w+|pipeline", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14))
    assert "pipeline" in names and 4 <= len(corpus_pipeline.STAGES) <= 5
    assert {"op11_phrase_collocations", "op13_fill_in_middle"} <= set(e.oracle_sql())
