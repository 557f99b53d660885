"""Language ID: Kneser-Ney against a direct computation, held-out accuracy, edge cases."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import SF, edge_documents
from pyspark.sql import functions as F

from blendwise.llm import langid

TEXTS = [("xx", "banana bandana ban"), ("xx", "anna banana"), ("yy", "tutto tutti tu"), ("yy", "Tutto il ti"), (None, "zzzz"), ("xx", None)]


def brute(texts, order=langid.ORDER):
    """Interpolated Kneser-Ney by definition: {language: {gram: probability}}."""
    out = {}
    letters = set()
    tables = {}
    for lang in {x for x, _ in texts if x}:
        raw = Counter()
        for x, t in texts:
            if x == lang and t:
                for w in langid.words(t):
                    p = langid.START * (order - 1) + w + langid.END
                    raw.update(p[i:i + order] for i in range(len(p) - order + 1))
        t = {order: raw}
        for n in range(order - 1, 0, -1):
            t[n] = Counter(g[1:] for g in t[n + 1])
        tables[lang] = t
        letters |= set(t[1])
    for lang, t in tables.items():
        p = {"": 1 / (len(letters) + 1)}
        for n in range(1, order + 1):
            ones, twos = sum(c == 1 for c in t[n].values()), sum(c == 2 for c in t[n].values())
            d = min(max(ones / (ones + 2 * twos) if ones + twos else 0.5, 0.1), 0.95)
            total, kinds = defaultdict(int), defaultdict(int)
            for g, c in t[n].items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            for g, c in t[n].items():
                h = g[:-1]
                lower = p[g[1:]] if n > 1 else p[""]
                p[g] = max(c - d, 0) / total[h] + d * kinds[h] / total[h] * lower
        out[lang] = p
    return out


def test_probabilities_match_the_definition(spark):
    df = spark.createDataFrame([(i, x, t) for i, (x, t) in enumerate(TEXTS)], "doc_id bigint, lang string, text string")
    grams, contexts = langid.kneser_ney(langid.gram_counts(df))
    want = brute(TEXTS)
    for n, t in enumerate(grams, 1):
        got = {(r.lang, r.g): r.p for r in t.collect()}
        assert got.keys() == {(x, g) for x, p in want.items() for g in p if len(g) == n}
        assert all(math.isclose(v, want[x][g], rel_tol=1e-12) for (x, g), v in got.items())
    # after every seen context, seen letters plus the back-off mass make one
    back = {(r.lang, r.h): r.back for r in contexts[-1].collect()}
    for (lang, h), b in back.items():
        seen = [g for g in want[lang] if len(g) == langid.ORDER and g[:-1] == h]
        assert math.isclose(sum(want[lang][g] for g in seen) + b * (1 - sum(want[lang][g[1:]] for g in seen)), 1, rel_tol=1e-9)


def test_scores_of_words_follow_the_probabilities(spark):
    df = spark.createDataFrame([(i, x, t) for i, (x, t) in enumerate(TEXTS)], "doc_id bigint, lang string, text string")
    model = langid.fit(df)
    want = brute(TEXTS)
    x, n = langid.Scorer(model).cross_entropy(["banana", None, "ban anna"])
    for i, ws in ((0, ["banana"]), (2, ["ban", "anna"])):
        total = 0.0
        for w in ws:
            p = langid.START * (langid.ORDER - 1) + w + langid.END
            total -= sum(math.log(want["xx"][p[j:j + langid.ORDER]]) for j in range(len(p) - langid.ORDER + 1))
        assert math.isclose(x[i][model.langs.index("xx")], total / sum(len(w) + 1 for w in ws), rel_tol=1e-5)
    assert n.tolist() == [7, 0, 9]


def test_held_out_accuracy_and_fold(spark):
    got = langid.op1_language_id(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    j = got.join(docs.select("doc_id", "lang", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("fold")), "doc_id").collect()
    assert len(j) == docs.count()
    assert all(r.held_out == r.fold and 0 <= r.score <= 1 for r in j)
    held = [r for r in j if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert not any(r.rejected for r in j)


def test_language_of_held_out_rows_is_never_learned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    lies = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    assert "zz" not in langid.fit_on_documents(lies).langs


def test_edge_cases(spark):
    docs = edge_documents(spark)
    model = langid.fit_on_documents(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = langid.identify(docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert r.lang_pred == "und" and r.score == 0 and r.rejected
        else:
            assert r.lang_pred in model.langs
    assert langid.identify(docs.limit(0), model).count() == 0
    assert langid.fit_on_documents(docs.limit(0)) is None
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.fit_on_documents(docs).langs  # learns from what there is


@pytest.mark.parametrize("text", ["xkq zzv qwrtp bvnm kjhg " * 5, "这是一个中文句子", "aGVsbG8gd29ybGQgdGhpcyBpcyBiYXNlNjQ"])
def test_foreign_and_random_texts_are_rejected(spark, text):
    model = langid.fit_on_documents(spark.read.parquet(f"{SF}/documents.parquet"))
    assert langid.identify(spark.createDataFrame([(text,)], "text string"), model).first().rejected


def test_a_held_back_language_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    model = langid.fit_on_documents(docs.filter("lang <> 'es'"))
    assert "es" not in model.langs
    rows = langid.identify(docs.filter("length(text) >= 500"), model).collect()
    held = [r.rejected for r in rows if r.lang == "es"]
    learned = [r.rejected for r in rows if r.lang != "es"]
    assert len(held) > 50 and sum(held) >= 0.8 * len(held)
    assert sum(learned) <= 0.005 * len(learned)


def test_an_unseen_script_is_rejected_by_a_model_of_several_scripts(spark):
    import random

    rng = random.Random(3)
    alphabets = {"la": "abcdefghijklmnop", "el": "αβγδεζηθικλμνξοπ", "ru": "абвгдежзийклмноп", "he": "אבגדהוזחטיכלמנסע"}
    unseen = "កខគឃងចឆជឈញដឋឌឍណត"

    def text(letters):
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(30)]
        return " ".join(rng.choice(words) for _ in range(60))

    docs = [(i, lang, text(a)) for i, (lang, a) in enumerate(sorted(alphabets.items()) * 60)]
    model = langid.fit(spark.createDataFrame(docs, "doc_id bigint, lang string, text string"))
    tests = spark.createDataFrame([(True, text(unseen)) for _ in range(10)] + [(False, t) for _, _, t in docs], "want boolean, text string")
    assert all(r.rejected == r.want for r in langid.identify(tests, model).collect())


def test_the_model_holds_all_grams(spark, monkeypatch):
    monkeypatch.setattr(langid, "MODEL_GRAMS", 5, raising=False)  # the cap that there was
    df = spark.createDataFrame([(i, x, t) for i, (x, t) in enumerate(TEXTS)], "doc_id bigint, lang string, text string")
    model = langid.fit(df)
    want = brute(TEXTS)
    for n, (keys, logp) in enumerate(zip(model.keys, model.logp), 1):
        assert len(keys) == len({g for p in want.values() for g in p if len(g) == n})
        assert (logp[:-1] == logp[:-1]).sum() == sum(len(g) == n for p in want.values() for g in p)  # not NaN


def test_limits_come_from_all_training_rows(spark):
    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("lang", "text")
    docs = docs.union(docs).union(docs).union(docs)  # more than 2000 rows of a language
    model = langid.fit(docs)
    rows = langid.own_scores(docs, model).collect()
    assert len(rows) == sum(any(langid.words(r.text or "")) for r in docs.collect()) and len(rows) > 3900
    for lang in model.langs:
        own = [r for r in rows if r.lang == lang]
        x, n = np.array([r.own for r in own]), np.array([r.n for r in own])
        away = [r.low for r in rows if r.lang != lang and r.nearest == lang]
        if len(away) < langid.FOREIGN_TEXTS:
            away = [r.low for r in rows if r.lang != lang]
        mean = np.average(x, weights=n)
        off, w = (x - mean) ** 2, np.sqrt(n / (1 + n / 200))
        a = np.stack([1 / n, np.ones_like(n)], axis=1)
        per_char, between = np.linalg.lstsq(a * w[:, None], off * w, rcond=None)[0]
        want = (mean, max(per_char, np.median(off * n), 1e-3), max(between, 1e-3),
                (np.quantile(x, langid.OWN_TAIL) + np.quantile(away, langid.FOREIGN_TAIL)) / 2)
        assert np.allclose(model.limits[lang], want, rtol=2e-4, atol=2e-4), lang


def test_pieces_hold_all_words_and_are_scored_once(spark, monkeypatch):
    texts = ["Haus_maus x9y\u00a0\u00e4\u00d6\u2014\u4f60\u597d. \u1e9e,\u03a3\u03a3 \u0661z", "a-b a.b 12 !", "", None, "\u2014 \u0663", "x" * 9 + " haus"]
    for t in texts:
        assert [w for p in langid.pieces(t or "") for w in langid._WORD.findall(p.decode())] == langid.words(t or "")
    model = langid.fit(spark.createDataFrame([("a", "haus maus a b"), ("b", "x y xy")] * 3, "lang string, text string"))
    made, real = [], langid.Model.score_words
    monkeypatch.setattr(langid.Model, "score_words", lambda self, ws: made.append(list(ws)) or real(self, ws))
    s = langid.Scorer(model)
    x, n = s.cross_entropy(texts)
    assert np.allclose(x, s.cross_entropy(texts)[0]) and len(made) == 1  # all known the second time
    for t, row, k in zip(texts, x, n):
        ws = langid.words(t or "")
        assert k == sum(len(w) + 1 for w in ws)
        assert np.allclose(row, -real(model, ws).sum(axis=0) / k if ws else 0)
    s.most = 0  # forgets before every batch
    assert np.allclose(x, s.cross_entropy(texts)[0]) and len(made) == 2
