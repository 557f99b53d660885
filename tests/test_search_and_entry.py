"""Search loop acceptance (L19), softmax head (L21) and the driver contract."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF001, SF01


def test_search_moves_weight_to_the_target_language(spark):
    from blendwise.plans.loop_queries import lang_chunks, lang_mixture, lang_positioned, val_target
    from blendwise.plans.search import SearchConfig, search

    cfg = SearchConfig(n_iters=25, interval=4, micro_batch=16, mix_lr=0.05, order="unigram", vocab=1024,
                       run_id="t", source="lang", checkpoint_every=3)
    hist = search(spark, lang_positioned(spark, SF01), lang_mixture(spark, SF01), val_target(spark, SF01, lang="de"), cfg, chunk_rows=lang_chunks(spark, SF01), block_size=129)
    last = hist.filter(F.col("step") == hist.agg(F.max("step")).first()[0]).orderBy(F.desc("p")).collect()
    assert abs(sum(r.p for r in last) - 1) < 1e-9
    assert last[0].lang == "de"
    assert last[0].p > 0.25


def test_softmax_head_loss_decreases(spark):
    from blendwise.plans.softmax_head import fit_softmax_head

    pairs = spark.createDataFrame([(u, (u * 7 + k) % 5, 1 + k) for u in range(20) for k in range(3)], "u int, v int, n long")
    _, losses = fit_softmax_head(spark, pairs, vocab=5, n_features=8, steps=3, lr=2.0)
    ls = [r.loss for r in losses.orderBy("step").collect()]
    assert ls[0] > ls[-1]


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert {"source", "block_no", "checksum"} <= set(df.columns)
    q, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(q)
    assert len(q) >= 88
    rows_only = set(q) - set(sql)
    assert all(q.startswith(("op", "pipeline")) for q in rows_only)


@pytest.mark.parametrize("name", ["p2_pack", "m3_draw_sources", "l12_inner_products", "r1_throughput"])
def test_queries_run_on_the_smallest_tables(spark, name):
    import __spark_entry__ as e

    assert e.queries()[name](spark, SF001).count() >= 0


def test_qa_target_search_history_properties(spark):
    from blendwise.plans.loop_queries import lang_chunks, lang_mixture, lang_positioned, qa_target
    from blendwise.plans.search import SearchConfig, search
    from blendwise.operators import optim as op

    cfg = SearchConfig(n_iters=16, interval=5, micro_batch=16, mix_lr=0.05, order="unigram", vocab=1024, run_id="qa",
                       source="lang", init="noise", optimizer=dict(op.QA_ADAM), anneal_t_max=16)
    h = search(spark, lang_positioned(spark, SF01), lang_mixture(spark, SF01), qa_target(spark, SF01), cfg, chunk_rows=lang_chunks(spark, SF01), block_size=129).toPandas()
    assert sorted(h["step"].unique()) == [0, 5, 10, 15]
    assert (h.groupby("step")["p"].sum().sub(1).abs() < 1e-9).all()
    z0 = h[h["step"] == 0]["z"]
    assert (z0.abs() < 1e-5).all()  # seeded 1e-7 noise
    assert (h[h["step"] == 15]["z"].abs() > 1e-4).any()  # the logits moved
    assert (h[h["step"] == 15]["t"] == 3).all()


def test_search_resumes_from_its_history(spark):
    from blendwise.plans.loop_queries import lang_chunks, lang_mixture, lang_positioned, val_target
    from blendwise.plans.search import SearchConfig, search

    cfg = dict(interval=5, micro_batch=16, mix_lr=0.05, order="unigram", vocab=1024, run_id="r", source="lang")
    blocks, mix, target = lang_positioned(spark, SF001), lang_mixture(spark, SF001), val_target(spark, SF001)
    ids = {"chunk_rows": lang_chunks(spark, SF001), "block_size": 129}
    whole = search(spark, blocks, mix, target, SearchConfig(n_iters=21, **cfg), **ids)
    half = search(spark, blocks, mix, target, SearchConfig(n_iters=11, **cfg), **ids)
    rest = search(spark, blocks, mix, target, SearchConfig(n_iters=21, **cfg), resume_from=half, **ids)
    rows = lambda h: {(r.step, r.lang): (r.z, r.p, r.t) for r in h.collect()}
    a, b = rows(whole), rows(rest)
    assert a.keys() == b.keys() and max(s for s, _ in a) == 20
    assert all(abs(x - y) < 1e-9 for k in a for x, y in zip(a[k], b[k]))


def test_search_survives_a_driver_that_dies_between_write_and_commit(spark, tmp_path, monkeypatch):
    from blendwise.operators import loss as ls
    from blendwise.plans.loop_queries import lang_blocks, lang_chunks, lang_mixture, lang_positioned, val_target
    from blendwise.plans.search import SearchConfig, run_search
    from blendwise.sources import history as hs

    cfg = SearchConfig(n_iters=21, interval=5, micro_batch=16, mix_lr=0.05, order="unigram", vocab=1024, run_id="k", source="lang")
    blocks, mix, target = lang_positioned(spark, SF001), lang_mixture(spark, SF001), val_target(spark, SF001)
    valid = ls.pair_counts(lang_blocks(spark, SF001).filter("split = 'valid'").withColumnRenamed("lang", "set"), ["set"], order="unigram")
    how = {"chunk_rows": lang_chunks(spark, SF001), "block_size": 129, "validation": valid}
    rows = lambda d: {(r.step, r.lang): (r.z, r.p, r.m, r.v, r.t) for r in d.collect()}
    whole = run_search(spark, blocks, mix, target, cfg, root=str(tmp_path / "whole"), **how)
    real = hs.commit_step

    def dies(table, path, step):
        if step == 10 and path.endswith("history"):
            folder = real(table, path, step)
            os.remove(os.path.join(folder, "_SUCCESS"))  # the rows are there, the commit is not
            raise KeyboardInterrupt
        return real(table, path, step)

    monkeypatch.setattr(hs, "commit_step", dies)
    with pytest.raises(KeyboardInterrupt):
        run_search(spark, blocks, mix, target, cfg, root=str(tmp_path / "killed"), **how)
    monkeypatch.undo()
    spark.catalog.clearCache()  # a new driver has none
    assert hs.committed_steps(spark, str(tmp_path / "killed" / "history")) == [0, 5]
    again = run_search(spark, blocks, mix, target, cfg, root=str(tmp_path / "killed"), **how)
    a, b = rows(whole.history), rows(again.history)
    assert a.keys() == b.keys() and len(a) == again.history.count()  # no step twice
    assert all(abs(x - y) < 1e-9 for k in a for x, y in zip(a[k], b[k]))
    assert hs.committed_steps(spark, again.state_path) == [20]  # only the newest state stays
    m = lambda run: {(r.step, r.set): r.val_loss for r in run.metrics.collect()}
    x, y = m(whole), m(again)
    assert x.keys() == y.keys() and {s for s, _ in x} == {5, 10, 15, 20}
    assert all(abs(x[k] - y[k]) < 1e-9 for k in x)


def test_search_counts_grow_with_the_intervals_not_the_iterations(spark):
    from blendwise.plans.loop_queries import lang_chunks, lang_mixture, lang_positioned
    from blendwise.plans.search import SearchConfig, iteration_counts

    def counts(n_iters, interval):
        cfg = SearchConfig(n_iters=n_iters, interval=interval, vocab=1024, source="lang")
        c = iteration_counts(spark, lang_positioned(spark, SF001), lang_mixture(spark, SF001), cfg, 4, False, lang_chunks(spark, SF001), 129)
        return c.groupBy("interval", "at_step", "source", "u", "v").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).toPandas()

    each, whole = counts(12, 1), counts(12, 4)
    assert (whole["rows"] == 1).all() and each["at_step"].all() and len(whole) < len(each)
    assert sorted(set(whole["interval"])) == [0, 1, 2] and set(whole["at_step"]) == {True, False}
    total = lambda d: d.groupby(["source", "v"])["n"].sum().to_dict()
    each["part"] = each["interval"] // 4
    for i in range(3):
        assert total(each[each["part"] == i]) == total(whole[whole["interval"] == i])
        assert total(each[each["interval"] == 4 * i]) == total(whole[(whole["interval"] == i) & whole["at_step"]])


def test_head_and_validation_carry_no_more_than_they_need(spark, monkeypatch):
    from blendwise.plans import loop_queries, metrics_queries

    seen = []
    real = loop_queries.fit_softmax_head
    monkeypatch.setattr(loop_queries, "fit_softmax_head", lambda spark, pairs, *a, **k: seen.append(pairs) or real(spark, pairs, *a, **k))
    assert loop_queries.l21_softmax_head(spark, SF001).count() == 4
    assert seen[0].columns == ["u", "v", "n"]
    plan = metrics_queries._batch_losses(spark, SF001)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [u" not in plan and plan.count("BroadcastHashJoin [u") == 2  # the proxy's pairs and contexts
