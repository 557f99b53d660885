"""Proxy, losses and gradients against dense brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from blendwise.operators import gradients as gr
from blendwise.operators import loss as ls

V, ALPHA = 6, 0.3


def _counts(spark, rows, keys=("source",)):
    schema = ", ".join(f"{k} string" for k in keys) + ", u int, v int, n long"
    return spark.createDataFrame(rows, schema)


def _dense_p(rows_w):
    c = np.zeros((V, V))
    for u, v, w in rows_w:
        c[u, v] += w
    return (ALPHA + c) / (c.sum(1, keepdims=True) + ALPHA * V)


TRAIN = [("a", 0, 1, 3), ("a", 1, 2, 1), ("a", 2, 0, 2), ("b", 0, 1, 1), ("b", 0, 3, 4), ("b", 3, 3, 2), ("b", 1, 2, 1)]
TARGET = [("t", 0, 1, 2), ("t", 4, 2, 1), ("t", 1, 2, 1)]


def _grad_dense(rows, p):
    G = {}
    for s in sorted({r[0] for r in rows}):
        n = np.zeros((V, V))
        for src, u, v, k in rows:
            if src == s:
                n[u, v] += k
        q = n / n.sum()
        a = q.sum(1)
        G[s] = a[:, None] * p - q
    return G


def test_fit_proxy_and_token_loss(spark):
    c = _counts(spark, TRAIN)
    w = spark.createDataFrame([("a", 0.25), ("b", 0.75)], "source string, w double")
    px = ls.fit_proxy(c, w, alpha=ALPHA, vocab=V)
    p = _dense_p([(u, v, n * (0.25 if s == "a" else 0.75)) for s, u, v, n in TRAIN])
    probe = spark.createDataFrame([(u, v) for u in range(V) for v in range(V)], "u int, v int")
    got = ls.with_prob(probe, px).toPandas()
    for r in got.itertuples():
        assert abs(r.prob - p[r.u, r.v]) < 1e-12
    s2 = px.ctx.toPandas().set_index("u")["s2"]
    for u in s2.index:
        assert abs(s2[u] - (p[u] ** 2).sum()) < 1e-12


def test_cross_entropy_ignore_ids_and_chunked(spark):
    px = ls.fit_proxy(_counts(spark, TRAIN), alpha=ALPHA, vocab=V)
    p = _dense_p([(u, v, n) for s, u, v, n in TRAIN])
    rows = [("a", 0, 1, 2), ("a", 1, -1, 3), ("a", 2, 0, 1)]
    t = ls.token_loss(_counts(spark, rows), px, ignore=-1)
    mean = ls.cross_entropy(t).first()["loss"]
    exp = (2 * -np.log(p[0, 1]) + 1 * -np.log(p[2, 0])) / 3
    assert abs(mean - exp) < 1e-12
    chunked = ls.cross_entropy(t, chunked=True).first()["loss"]
    assert abs(chunked - exp * 3 / 6) < 1e-12
    allign = ls.cross_entropy(ls.token_loss(_counts(spark, [("a", 0, -100, 2)]), px, ignore=-100)).first()["loss"]
    assert allign is None or np.isnan(allign)


@pytest.mark.parametrize("eps", [0.0, 0.1])
def test_label_smoothing(spark, eps):
    px = ls.fit_proxy(_counts(spark, TRAIN), alpha=ALPHA, vocab=V)
    p = _dense_p([(u, v, n) for s, u, v, n in TRAIN])
    t = ls.token_loss(_counts(spark, [("a", 0, 1, 1), ("a", 5, 2, 1)]), px, smoothing=eps).orderBy("u").toPandas()
    for r in t.itertuples():
        exp = (1 - eps) * -np.log(p[r.u, r.v]) + eps * (-np.log(p[r.u]).sum() / V)
        assert abs(r.loss - exp) < 1e-12


def test_weighted_ce_with_zero_weight(spark):
    px = ls.fit_proxy(_counts(spark, TRAIN), alpha=ALPHA, vocab=V)
    t = ls.token_loss(_counts(spark, [("a", 0, 1, 1), ("b", 0, 3, 1)]), px, ignore=-100)
    w = spark.createDataFrame([("a", 0.0), ("b", 2.0)], "source string, w double")
    got = ls.weighted_ce(t, w).first()["loss"]
    p = _dense_p([(u, v, n) for s, u, v, n in TRAIN])
    assert abs(got - -np.log(p[0, 3])) < 1e-12


def test_inner_products_cosine_and_norms_match_dense(spark):
    px = ls.fit_proxy(_counts(spark, TRAIN), alpha=ALPHA, vocab=V)
    p = _dense_p([(u, v, n) for s, u, v, n in TRAIN])
    A = gr.source_gradient(_counts(spark, TARGET, ("target",)), ["target"])
    B = gr.source_gradient(_counts(spark, TRAIN), ["source"])
    GA = _grad_dense(TARGET, p)["t"]
    GB = _grad_dense(TRAIN, p)
    al = gr.alignment(A, B, px, metric="cosine").toPandas().set_index("source")
    for s, G in GB.items():
        assert abs(al.loc[s, "ip"] - (GA * G).sum()) < 1e-13
        cos = (GA * G).sum() / np.linalg.norm(GA) / np.linalg.norm(G)
        assert abs(al.loc[s, "cosine"] - cos) < 1e-10
    vals = gr.values(B, px).toPandas()
    for r in vals.itertuples():
        assert abs(r.g - GB[r.source][r.u, r.v]) < 1e-13


def test_source_gradient_equals_finite_difference_of_the_loss(spark):
    # unigram head: loss(z) = -sum_v q_v log softmax(z)_v; gradient p - q
    rows = [("a", -1, 0, 3), ("a", -1, 2, 1), ("a", -1, 5, 2)]
    px = ls.fit_proxy(_counts(spark, rows), alpha=ALPHA, vocab=V)
    p = (ALPHA + np.bincount([0, 2, 5], weights=[3, 1, 2], minlength=V)) / (6 + ALPHA * V)
    z = np.log(p)
    q = np.bincount([0, 2, 5], weights=[3, 1, 2], minlength=V) / 6

    def loss(zz):
        e = np.exp(zz - zz.max())
        return -(q * np.log(e / e.sum())).sum()

    fd = np.array([(loss(z + 1e-6 * np.eye(V)[i]) - loss(z - 1e-6 * np.eye(V)[i])) / 2e-6 for i in range(V)])
    g = gr.values(gr.source_gradient(_counts(spark, rows), ["source"]), px).toPandas().set_index("v")["g"]
    for v in g.index:
        assert abs(g[v] - fd[v]) < 1e-7


def test_absent_source_gets_zero(spark):
    ip = spark.createDataFrame([("a", 0.5)], "source string, ip double")
    mix = spark.createDataFrame([("a",), ("b",)], "source string")
    got = {r.source: r.ip for r in gr.ip_for_sources(ip, mix, []).collect()}
    assert got == {"a": 0.5, "b": 0.0}


def test_identical_source_and_target_are_aligned(spark):
    px = ls.fit_proxy(_counts(spark, TRAIN), alpha=ALPHA, vocab=V)
    A = gr.source_gradient(_counts(spark, [("x",) + r[1:] for r in TRAIN if r[0] == "a"], ("target",)), ["target"])
    B = gr.source_gradient(_counts(spark, [r for r in TRAIN if r[0] == "a"]), ["source"])
    c = gr.alignment(A, B, px, metric="cosine").first()["cosine"]
    assert abs(c - 1.0) < 1e-9


def test_masked_counts_are_the_counts_of_masked_blocks(spark):
    from pyspark.sql import functions as F

    from blendwise.operators import loss as ls

    b = spark.createDataFrame([("a", [1, 2, 1], [2, 0, -1]), ("a", [2, 2], [0, -1]), ("b", [1], [0])], "k string, input_ids array<int>, targets array<int>")
    when = lambda x: x == 0
    of_blocks = ls.pair_counts(ls.mask_targets(b, -1, when), ["k"])
    of_counts = ls.mask_targets(ls.pair_counts(b, ["k"]), -1, when)
    assert of_counts.columns == of_blocks.columns and sorted(of_counts.collect()) == sorted(of_blocks.collect())
    assert of_counts.filter("k = 'a' AND u = 2 AND v = -1").first().n == 3
    assert "broadcast" in ls.fit_proxy(of_counts.drop("k"), vocab=1024).for_positions().pairs._jdf.queryExecution().toString()
    assert of_counts.agg(F.sum("n")).first()[0] == 6


def test_loss_queries_pack_the_blocks_once(spark, monkeypatch):
    from blendwise.plans import loss_queries as lq

    packed, pack = [], lq.packed_blocks
    monkeypatch.setattr(lq, "packed_blocks", lambda *a, **k: packed.append(1) or pack(*a, **k))
    for query in (lq.l4_cross_entropy, lq.l10_val_gradient_first_batch):
        packed.clear()
        query(spark, "/root/testdata/sf0.001")
        assert packed == [1]
