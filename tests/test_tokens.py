"""Tokens: split, vocabulary, dictionary and pluggable encoders, specials, decode, strict lookup."""

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from blendwise.operators import tokens as tk


def _docs(spark):
    return spark.createDataFrame([(1, "s", "  b a\tb\nc  "), (2, "s", "a a d")], "doc_id long, source string, text string")


def test_tokenize_drops_empty_pieces(spark):
    w = tk.tokenize(_docs(spark)).orderBy("doc_id").collect()
    assert w[0].words == ["b", "a", "b", "c"] and w[1].words == ["a", "a", "d"]


def test_vocab_ranks_by_count_then_token_and_roundtrips(spark):
    words = tk.tokenize(_docs(spark))
    vocab = tk.build_vocab(words, max_size=4)
    v = [(r.token, r.id, r.n) for r in vocab.orderBy("id").collect()]
    assert v == [("a", 1, 3), ("b", 2, 2), ("c", 3, 1)]  # 'd' falls outside the 3 ids
    enc = tk.encode(words, vocab=vocab, key="doc_id").orderBy("doc_id").collect()
    assert enc[0].ids == [2, 1, 2, 3] and enc[1].ids == [1, 1, 0]  # unknown -> 0
    dec = {r.doc_id: r.text for r in tk.decode(tk.encode(words, vocab=vocab, key="doc_id"), vocab).collect()}
    assert dec == {1: "b a b c", 2: "a a"}


def test_require_ids_raises_on_absent_tokens(spark):
    words = tk.tokenize(_docs(spark))
    vocab = tk.build_vocab(words, max_size=4)
    with pytest.raises(ValueError, match="'d'"):
        tk.require_ids(words, vocab)
    full = tk.build_vocab(words, max_size=10)
    assert tk.require_ids(words, full).count() == 2


def test_dictionary_lookup_moves_distinct_tokens_of_bounded_groups(spark, monkeypatch):
    monkeypatch.setattr(tk, "GROUP_ITEMS", 3)
    rows = [(1, "a " * 500), (2, "b a zz b"), (3, ""), (4, None), (4, "c b"), (5, "zz")]
    words = tk.tokenize(spark.createDataFrame(rows, "doc_id long, text string"))
    vocab = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "token string, id int")
    enc = tk.encode(words, vocab=vocab, unk_id=9)
    assert enc.columns == ["doc_id", "text", "words", "ids"]
    got = sorted((r.doc_id, r.ids) for r in enc.collect())
    assert got == [(1, [1] * 500), (2, [2, 1, 9, 2]), (3, []), (4, []), (4, [3, 2]), (5, [9])]
    back = sorted((r.doc_id, r.text) for r in tk.decode(enc.drop("text"), vocab).collect())
    assert back == [(1, ("a " * 500).strip()), (2, "b a b"), (3, ""), (4, ""), (4, "c b"), (5, "")]  # 9 is skipped
    plan = enc.select("ids")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "collect_list" not in plan
    assert tk.encode(words.limit(0), vocab=vocab).count() == 0


def test_vocabulary_and_lookup_split_texts_once_per_read(spark):
    words = tk.tokenize(_docs(spark))
    for d in (tk.build_vocab(words, max_size=4), tk.missing_tokens(words, spark.createDataFrame([("a",)], "token string"))):
        assert d._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1  # not once more in a filter on its size
    enc = tk.encode(words.select("doc_id", "words"), vocab=spark.createDataFrame([("a", 1), ("b", 2)], "token string, id int"))
    assert sorted((r.doc_id, r.ids) for r in enc.collect()) == [(1, [2, 1, 2, 0]), (2, [1, 1, 0])]
    plan = enc._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1 and "explode" not in plan  # both steps read the rows of one shuffle
    physical = enc.select("doc_id", "ids")
    physical.collect()
    assert "ReusedExchange" in physical._jdf.queryExecution().executedPlan().toString()


def test_decode_computes_the_ids_once(spark):
    made = spark.sparkContext.accumulator(0)

    @pandas_udf("array<int>")
    def ids(n: pd.Series) -> pd.Series:
        made.add(len(n))
        return n.apply(lambda x: [x, x + 1, 9])

    rows = spark.range(1, 6).select(F.col("id").alias("doc_id"), ids("id").alias("ids"))
    vocab = spark.createDataFrame([(f"t{i}", i) for i in range(7)], "token string, id int")
    got = sorted((r.doc_id, r.text) for r in tk.decode(rows, vocab).collect())
    assert got == [(i, f"t{i} t{i + 1}") for i in range(1, 6)] and made.value == 5


def test_hashed_ids_specials_and_truncation(spark):
    d = tk.encode_documents(_docs(spark), vocab_size=64, bos=5, eos=0, max_length=4).orderBy("doc_id").collect()
    assert d[0].ids[0] == 5 and len(d[0].ids) == 4 and d[0].n_tokens == 4  # EOS cut by truncation
    assert d[1].ids[0] == 5 and len(d[1].ids) == 4 and 0 not in d[1].ids  # 3 words + BOS + EOS, cut to 4
    assert all(1 <= x <= 63 for x in d[0].ids[1:])
    full = tk.encode_documents(_docs(spark), vocab_size=64).orderBy("doc_id").collect()
    assert full[1].ids[-1] == 0 and len(full[1].ids) == 4 and full[1].n_tokens == 4


def test_pluggable_vectorised_encoder(spark):
    @pandas_udf("array<int>")
    def by_length(words: pd.Series) -> pd.Series:
        return words.apply(lambda ws: [len(w) for w in ws])

    e = tk.encode(tk.tokenize(_docs(spark)), fn=by_length).orderBy("doc_id").collect()
    assert e[0].ids == [1, 1, 1, 1]


def test_corpus_stats_width(spark):
    d = tk.encode_documents(_docs(spark), vocab_size=70000)
    st = tk.corpus_stats(d, vocab_size=70000).first()
    assert st.n_docs == 2 and st.n_tokens == 9 and st.id_width == 4 and st.bytes == 36


def test_subword_codec_works_on_bounded_slices_and_encodes_once(spark, monkeypatch):
    from public_tokenizers import path

    assert list(tk.slices([], 3)) == [] and list(tk.slices([5, 1, 2, 3, 0], 3)) == [(0, 1), (1, 3), (3, 5)]
    monkeypatch.setattr(tk, "SLICE_CHARS", 8)
    texts = ["a longer text than a slice", "", "ab", None, "cd ef", "äöü \u4f60"]
    codec = tk.SubwordCodec(path("byte_bpe_50k.json"))
    made, load = [], tk.SubwordCodec.load

    class Counted:
        def encode_batch(self, batch, **how):
            made.append(sum(map(len, batch)) if len(batch) > 1 else 0)
            return load(codec.path).encode_batch(batch, **how)

    udf = {}
    monkeypatch.setattr(tk.F, "pandas_udf", lambda f, t: udf.setdefault(t, f) and pandas_udf(f, t))
    codec.encode(F.lit("x"))
    codec.decode(F.array(F.lit(1)))
    with monkeypatch.context() as m:
        m.setattr(tk.SubwordCodec, "load", staticmethod(lambda p: Counted()))
        ids = udf["array<int>"](pd.Series(texts))
    assert max(made) <= 8 and len(made) == 3
    assert udf["string"](ids).tolist() == [t or "" for t in texts]
    d = tk.encode_texts(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), codec)
    plan = d.select(F.size("ids"), codec.decode(F.col("ids")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ids(text") == 1
