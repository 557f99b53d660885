"""Mixture weights and draws (M1-M6, M10-M12) and the logit algebra."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from blendwise.operators import mixture as mx
from blendwise.operators import optim as op


def _mix(spark, weights):
    rows = [(i, f"s{i}", float(w)) for i, w in enumerate(weights)]
    return spark.createDataFrame(rows, "group_id int, source string, weight double")


def test_normalize_and_softmax_sum_to_one(spark):
    p = mx.normalize(_mix(spark, [1, 2, 3, 0])).toPandas()
    assert abs(p["p"].sum() - 1) < 1e-12
    st = spark.createDataFrame([("r", 0, f"s{i}", z) for i, z in enumerate([1000.0, 999.0, -5.0])],
                               "run_id string, step long, source string, z double")
    sm = mx.softmax(st).toPandas()
    assert abs(sm["p"].sum() - 1) < 1e-12 and sm["p"].notna().all()


def test_draw_shares_within_four_sigma_and_zero_weight_never_drawn(spark):
    weights = [1, 2, 3, 0, 4]
    n = 20000
    d = mx.draw_sources(spark, n, _mix(spark, weights), seed=11, mixture_rows=5).toPandas()
    assert len(d) == n and d["draw_idx"].nunique() == n
    counts = d["group_id"].value_counts().to_dict()
    assert 3 not in counts
    for g, w in enumerate(weights):
        p = w / sum(weights)
        sigma = math.sqrt(n * p * (1 - p)) + 1e-9
        assert abs(counts.get(g, 0) - n * p) <= 4 * sigma + 1e-9


def test_single_source_gets_every_draw(spark):
    d = mx.draw_sources(spark, 100, _mix(spark, [5]), seed=1, mixture_rows=1).toPandas()
    assert set(d["source"]) == {"s0"}


def test_valid_sources_renumbers_survivors(spark):
    files = spark.createDataFrame([("s0", "a"), ("s2", "b"), ("s2", "c")], "source string, file string")
    v = mx.valid_sources(_mix(spark, [1, 1, 1]), files, min_files=1).orderBy("group_id").toPandas()
    assert list(v["source"]) == ["s0", "s2"] and list(v["group_id"]) == [0, 1]


def test_batches(spark):
    d = spark.range(40).withColumnRenamed("id", "draw_idx")
    b = mx.batches(d, 4, 3).toPandas()
    assert b["micro_batch"].max() == 9 and b["opt_step"].max() == 3


def _np_softmax(z):
    e = np.exp(z - z.max())
    return e / e.sum()


def test_mixture_gradient_is_the_jacobian_product_and_sums_to_zero(spark):
    z = np.array([0.3, -1.0, 2.0, 0.0])
    ip = np.array([1e-3, -2e-3, 5e-4, 0.0])
    lr, lam = 0.5, 0.2
    st = spark.createDataFrame([("r", 0, f"s{i}", float(v), 0.0, 0.0, 0) for i, v in enumerate(z)],
                               "run_id string, step long, source string, z double, m double, v double, t long")
    ipdf = spark.createDataFrame([("r", 0, f"s{i}", float(v)) for i, v in enumerate(ip[:3])],
                                 "run_id string, step long, source string, ip double")  # s3 absent -> 0
    got = op.mixture_gradient(ipdf, st, lr, lam).orderBy("source").toPandas()["dz"].to_numpy()
    p = _np_softmax(z)
    J = p[None, :] * (np.eye(4) - p[:, None])
    g = -lr * ip
    h = -(1 + np.log(p + 1e-8))
    exp = (g[:, None] * J).sum(0) + lam * (h[:, None] * J).sum(0)
    assert np.allclose(got, exp, atol=1e-15)
    assert abs(got.sum()) < 1e-12


@pytest.mark.parametrize("preset,decoupled_wd", [("val", 0.0), ("qa", 0.1)])
def test_adam_step_matches_reference_arithmetic(spark, preset, decoupled_wd):
    cfg = dict(op.VALIDATION_ADAMW if preset == "val" else op.QA_ADAM)
    cfg["weight_decay"] = decoupled_wd
    z = np.array([1.0, -0.5])
    dz = np.array([1e-6, -3e-7])
    st = spark.createDataFrame([("r", 0, f"s{i}", float(v), 0.0, 0.0, 0) for i, v in enumerate(z)],
                               "run_id string, step long, source string, z double, m double, v double, t long")
    g = spark.createDataFrame([("r", f"s{i}", float(v)) for i, v in enumerate(dz)], "run_id string, source string, dz double")
    lr = 0.01
    out = op.adam_step(st, g, lr, **cfg)
    out2 = op.adam_step(out, g, lr, **cfg).orderBy("source").toPandas()
    zz, m, v = z.copy(), np.zeros(2), np.zeros(2)
    b1, b2, eps, wd = cfg["beta1"], cfg["beta2"], cfg["eps"], cfg["weight_decay"]
    for t in (1, 2):
        grad = dz + (wd * zz if not cfg["decoupled"] else 0)
        if cfg["decoupled"]:
            zz = zz * (1 - lr * wd)
        m = b1 * m + (1 - b1) * grad
        v = b2 * v + (1 - b2) * grad * grad
        zz = zz - lr * (m / (1 - b1 ** t)) / (np.sqrt(v / (1 - b2 ** t)) + eps)
    assert np.allclose(out2["z"].to_numpy(), zz, rtol=0, atol=1e-12)
    assert list(out2["t"]) == [2, 2] and list(out2["step"]) == [2, 2]


def test_schedules(spark):
    it = spark.range(0, 1200, 50).withColumnRenamed("id", "it")
    got = it.select("it", op.lr_at(F.col("it"), 4e-4, 1e-5, 100, 1000).alias("lr")).toPandas()

    def ref(i):
        if i < 100:
            return 4e-4 * i / 100
        if i > 1000:
            return 1e-5
        r = (i - 100) / 900
        return 1e-5 + 0.5 * (1 + math.cos(math.pi * r)) * (4e-4 - 1e-5)

    assert np.allclose(got["lr"], [ref(i) for i in got["it"]], atol=1e-15)
    k = spark.range(0, 5).select(op.mixture_lr(F.col("id"), 0.01, 4).alias("x")).toPandas()["x"]
    assert np.allclose(k, [0.01 * (1 + math.cos(math.pi * i / 4)) / 2 for i in range(5)])


def test_init_state_and_rank(spark):
    m = spark.createDataFrame([("a",), ("b",), ("c",)], "source string")
    ones = op.init_state(m, "ones").toPandas()
    assert (ones["z"] == 1.0).all()
    noise_df = op.init_state(m, "noise", seed=3)
    noise = noise_df.toPandas()
    assert (noise["z"].abs() < 1e-5).all() and noise["z"].nunique() == 3
    assert noise.equals(op.init_state(m, "noise", seed=3).toPandas())
    r = op.rank_sources(noise_df).orderBy("rank").toPandas()
    assert list(r["z"]) == sorted(r["z"], reverse=True)
    with pytest.raises(ValueError):
        op.init_state(m, "bogus")
