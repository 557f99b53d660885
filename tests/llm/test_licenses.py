"""License scan: base columns against SQL and Python, rules and suppression on hand-made texts."""

import random
import re
import time

import duckdb
import pytest
from helpers import SF, edge_documents, plain_words

from blendwise.llm import licenses


def base(text):
    w = plain_words(text)
    places = {}
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        hits = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
        if hits:
            places.setdefault(label, []).extend(hits)
    every = sorted(x for v in places.values() for x in v)
    return len(w), len(every), every[0] if every else None, every[-1] if every else None, ",".join(sorted(places))


def check_base(rows):
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(r.text)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert r.labels.split(",") == sorted(set(r.labels.split(","))) and 0 <= r.score <= 1
        assert (r.score > 0) == bool(r.labels)


def test_rules_are_regular_and_gated():
    rules = licenses.rules()
    assert len(rules) >= 200
    for r in rules:
        re.compile(r["pattern"])
        # what a rule needs lets the text through the gate of all rules, or the rule could never be tried
        assert r["keyword"] and r["priority"] in (1, 2, 3)


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = {r[0]: tuple(r[1:]) for r in con.execute(licenses.BASE_SQL).fetchall()}
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.op9_license_scan(spark, SF).collect()}
    assert got == want


CASES = [
    ("Released under the MIT License.", "mit"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\")", "apache,apache-2.0"),
    ("GNU Affero General Public License v3 or later", "agpl-3.0,gpl"),  # gpl: the base phrase always stays
    ("GNU Lesser General Public License", "gpl,lgpl"),
    ("BSD 3-Clause License", "bsd-3-clause"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
    ("released under the Foo Bar Baz license", "license-reference"),
    ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"),
    ("SPDX-License-Identifier: NONSENSE", "spdx-reference"),
    ("mit license mit license MIT-LICENSE apache license", "apache,mit"),
    ("submit license, mit licenses, MITé license", ""),
    ("licensed under the terms of the mozilla public license v2.0 and the isc license", "isc,mpl-2.0"),
    ("no legal words here", ""),
]


def test_labels_and_suppression(spark):
    rows = licenses.scan_licenses(spark.createDataFrame([(t, x) for t, x in CASES], "text string, want string")).collect()
    assert [r.labels for r in rows] == [r.want for r in rows]
    check_base(rows)


@pytest.mark.parametrize("n", [1, 2, 500])
def test_many_places(spark, n):
    text = "x " + "MIT License. " * n + "General  public\tlicense " * n + "y"
    rows = licenses.scan_licenses(spark.createDataFrame([(text,)], "text string")).collect()
    check_base(rows)
    assert rows[0].n_base == 2 * n


def test_edge_cases(spark):
    docs = edge_documents(spark)
    out = licenses.scan_licenses(docs)
    assert out.columns[:len(docs.columns)] == docs.columns and out.count() == docs.count()
    check_base(out.collect())
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_main_path_is_native(spark):
    plan = licenses.op9_license_scan(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def variants(pattern):
    """Texts that a pattern matches: every alternative, optional parts left out and put in, anything else once."""
    from re import _parser as sre

    def of(parsed):
        out = [""]
        for op, arg in parsed:
            name = str(op)
            if name == "LITERAL":
                more = [chr(arg)]
            elif name == "BRANCH":
                more = [x for branch in arg[1] for x in of(branch)]
            elif name == "SUBPATTERN":
                more = of(arg[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                more = [""] * (arg[0] == 0) + of(arg[2])
            elif name == "IN":
                more = [chr(x) if str(o) == "LITERAL" else "q" for o, x in arg]
            elif name == "ANY":
                more = ["q"]
            elif name == "ASSERT":
                more = [""]
            else:
                raise AssertionError(name)
            out = [a + b for a in out for b in more]
        return out

    return of(sre.parse(pattern))


def test_every_text_that_a_rule_matches_passes_gate_and_keyword():
    for r in licenses.rules():
        for text in variants(r["pattern"]):
            assert re.search(r["pattern"], f" {text} "), (r, text)
            assert any(g in text for g in licenses.GATES), (r, text)
            assert r["keyword"] in text, (r, text)


def test_a_sample_text_of_every_rule_is_labelled(spark):
    rows = [(r["rank"], r["priority"], r["label"], variants(r["pattern"])[-1]) for r in licenses.rules()]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "rank int, priority int, label string, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.labels and r.score >= licenses.CONFIDENCE[r.priority], r
        if r.priority == 1:
            assert r.label in r.labels.split(","), r


def independent_labels(text):
    """Labels by a plain reading of the rules: all matches, then pairwise containment."""
    norm = " " + " ".join(plain_words(text)) + " "
    found = []
    for r in licenses.rules():
        if r["keyword"] in norm:
            found += [(m.start(), m.end(), r["priority"], r["rank"], r["label"]) for m in re.finditer(r["pattern"], norm)]
    found = sorted(set(found), key=lambda x: (x[0], -x[1], x[2], x[3]))
    kept = [x for i, x in enumerate(found) if not any(y[0] <= x[0] and y[1] >= x[1] and y[2] <= x[2] for y in found[:i])]
    strong = [x for x in kept if x[2] < 3]
    kept = [x for x in kept if x[2] < 3 or not any(y[0] >= x[0] and y[1] <= x[1] for y in strong)]
    labels = {x[4] for x in kept} | {l for p, l in licenses.BASE.items() if f" {p} " in norm}
    return ",".join(sorted(labels))


def test_suppression_against_an_independent_version(spark):
    rng = random.Random(8)
    bits = [variants(r["pattern"])[k] for r in licenses.rules() for k in (0, -1)]
    bits += ["licensed under the terms of the", "license", "the", "some other words", "released under", "spdx license identifier", "gnu", "v2"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    texts.append(" ".join(rng.choice(bits) for _ in range(900)))  # more detections than a chunk of the running maxima holds
    for r in licenses.scan_licenses(spark.createDataFrame([(t,) for t in texts], "text string")).collect():
        assert r.labels == independent_labels(r.text), r.text


def test_time_grows_with_the_matches(spark):
    """A list of 100,000 notices in one text."""
    text = "MIT License, Apache License 2.0; " * 50_000
    began = time.time()
    r = licenses.scan_licenses(spark.createDataFrame([(text,)], "text string")).collect()[0]
    assert r.n_base == 100_000 and r.labels == "apache,apache-2.0,mit"
    assert time.time() - began < 60


def test_names_that_are_taken(spark):
    df = spark.createDataFrame([("MIT License", "mine", 7)], "text string, labels string, score int")
    r = licenses.scan_licenses(df).collect()[0]
    assert (r.labels, r.score, r.labels1, r.n_base) == ("mine", 7, "mit", 1) and r.score1 > 0
