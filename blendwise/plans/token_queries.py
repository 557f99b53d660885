"""Registered queries for the token operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from blendwise.operators import tokens as tk
from blendwise.plans.common import SQL_DOC_IDS, SQL_SPLIT, SQL_WORDS, VOCAB, checksum, doc_ids, with_sql
from blendwise.plans.registry import query
from blendwise.session import cut_lineage
from blendwise.sources import tables

VOCAB_MAX = 1000  # the size limit is T1's option: 999 most frequent tokens + id 0

SQL_VOCAB = f"""w AS (SELECT doc_id, unnest(W) AS token, unnest(range(len(W))) AS pos
        FROM (SELECT doc_id, {SQL_WORDS} AS W FROM documents WHERE text IS NOT NULL)),
c AS (SELECT token, count(*) AS n FROM w GROUP BY token),
v AS (SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) AS INTEGER) AS id, n FROM c
      QUALIFY row_number() OVER (ORDER BY n DESC, token) <= {VOCAB_MAX - 1})"""


# The other dictionary queries look all documents up in the whole vocabulary of the train split.
SQL_TRAIN_VOCAB = f"""w AS (SELECT doc_id, split, unnest(W) AS token, unnest(range(len(W))) AS pos
        FROM (SELECT doc_id, {SQL_SPLIT} AS split, {SQL_WORDS} AS W FROM documents WHERE text IS NOT NULL)),
c AS (SELECT token, count(*) AS n FROM w WHERE split = 'train' GROUP BY token),
v AS (SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) AS INTEGER) AS id, n FROM c)"""


def _train_vocab(spark, sf):
    d = tables.documents(spark, sf).filter(F.col("split") == "train")
    return tk.build_vocab(tk.tokenize(d.select("doc_id", "text")))


def _words(spark, sf):
    return tk.tokenize(tables.documents(spark, sf).select("doc_id", "source", "text"))


def _vocab(spark, sf):
    return tk.build_vocab(_words(spark, sf), max_size=VOCAB_MAX)


@query("t1_build_vocab", f"WITH {SQL_VOCAB} SELECT token, id, n FROM v")
def t1_build_vocab(spark, sf):
    return _vocab(spark, sf)


@query("t2_tokenize", f"""
SELECT doc_id, CAST(len(W) AS BIGINT) AS n_words, md5(array_to_string(W, ' ')) AS words_md5
FROM (SELECT doc_id, {SQL_WORDS} AS W FROM documents WHERE text IS NOT NULL)""")
def t2_tokenize(spark, sf):
    w = _words(spark, sf)
    return w.select("doc_id", F.size("words").cast("bigint").alias("n_words"),
                    F.md5(F.array_join("words", " ")).alias("words_md5"))


@query("t3_encode_hashed", f"""
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_ids,
       CAST(list_sum(list_transform(ids, lambda x, i: CAST(x AS BIGINT) * i)) AS BIGINT) AS id_checksum
FROM (SELECT doc_id, list_transform({SQL_WORDS},
        lambda w: CAST(1 + (('0x' || substr(md5(w), 1, 8))::BIGINT % {VOCAB - 1}) AS INTEGER)) AS ids
      FROM documents WHERE text IS NOT NULL)""")
def t3_encode_hashed(spark, sf):
    e = tk.encode(_words(spark, sf), vocab_size=VOCAB)
    return e.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), checksum("ids").alias("id_checksum"))


@query("t1_build_vocab_all", f"WITH {SQL_TRAIN_VOCAB} SELECT token, id, n FROM v")
def t1_build_vocab_all(spark, sf):
    return _train_vocab(spark, sf)


@query("t3_encode_vocab", f"""WITH {SQL_TRAIN_VOCAB}
SELECT d.doc_id, CAST(count(w.token) AS BIGINT) AS n_ids,
       CAST(coalesce(sum(CAST(coalesce(v.id, 0) AS BIGINT) * (w.pos + 1)), 0) AS BIGINT) AS id_checksum
FROM documents d LEFT JOIN w ON w.doc_id = d.doc_id LEFT JOIN v USING (token) WHERE d.text IS NOT NULL GROUP BY d.doc_id""")
def t3_encode_vocab(spark, sf):
    e = tk.encode(_words(spark, sf).select("doc_id", "words"), vocab=_train_vocab(spark, sf), key="doc_id")
    return e.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), checksum("ids").alias("id_checksum"))


@query("t4_add_special", f"""
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_ids,
       CAST(list_sum(list_transform(ids, lambda x, i: CAST(x AS BIGINT) * i)) AS BIGINT) AS id_checksum,
       CAST(ids[len(ids)] AS INTEGER) AS last_id
FROM (SELECT doc_id, list_slice(list_concat([7], list_transform({SQL_WORDS},
        lambda w: CAST(1 + (('0x' || substr(md5(w), 1, 8))::BIGINT % {VOCAB - 1}) AS INTEGER)), [0]), 1, 64) AS ids
      FROM documents WHERE text IS NOT NULL)""")
def t4_add_special(spark, sf):
    e = tk.encode(_words(spark, sf), vocab_size=VOCAB)
    e = tk.add_special(e, bos=7, eos=0, max_length=64)
    return e.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), checksum("ids").alias("id_checksum"),
                    F.element_at("ids", -1).cast("int").alias("last_id"))


@query("t4_add_special_uncut", f"""
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_ids,
       CAST(list_sum(list_transform(ids, lambda x, i: CAST(x AS BIGINT) * i)) AS BIGINT) AS id_checksum,
       CAST(ids[len(ids)] AS INTEGER) AS last_id
FROM (SELECT doc_id, list_concat([7], list_transform({SQL_WORDS},
        lambda w: CAST(1 + (('0x' || substr(md5(w), 1, 8))::BIGINT % {VOCAB - 1}) AS INTEGER)), [0]) AS ids
      FROM documents WHERE text IS NOT NULL)""")
def t4_add_special_uncut(spark, sf):
    e = tk.add_special(tk.encode(_words(spark, sf), vocab_size=VOCAB), bos=7, eos=0)
    return e.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), checksum("ids").alias("id_checksum"),
                    F.element_at("ids", -1).cast("int").alias("last_id"))


@query("t5_decode", f"""WITH {SQL_TRAIN_VOCAB}
SELECT d.doc_id, md5(coalesce(string_agg(v.token, ' ' ORDER BY w.pos), '')) AS text_md5, CAST(count(v.token) AS BIGINT) AS n_known
FROM documents d LEFT JOIN w ON w.doc_id = d.doc_id LEFT JOIN v USING (token) WHERE d.text IS NOT NULL GROUP BY d.doc_id""")
def t5_decode(spark, sf):
    vocab = cut_lineage(_train_vocab(spark, sf))  # read for both ways
    e = tk.encode(_words(spark, sf).select("doc_id", "words"), vocab=vocab, key="doc_id")
    d = tk.decode(e, vocab)
    n = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", " ")))
    return d.select("doc_id", F.md5("text").alias("text_md5"), n.cast("bigint").alias("n_known"))


@query("t6_missing_tokens", f"""WITH {SQL_TRAIN_VOCAB}
SELECT DISTINCT w.token FROM w WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.token = w.token)""")
def t6_missing_tokens(spark, sf):
    return tk.missing_tokens(_words(spark, sf), _train_vocab(spark, sf))


@query("t6_require_ids", f"""WITH {SQL_TRAIN_VOCAB.replace(" WHERE split = 'train'", "")}
SELECT d.doc_id, CAST(count(v.id) AS BIGINT) AS n_ids, CAST(coalesce(sum(CAST(v.id AS BIGINT) * (w.pos + 1)), 0) AS BIGINT) AS id_checksum
FROM documents d LEFT JOIN w ON w.doc_id = d.doc_id LEFT JOIN v USING (token) WHERE d.text IS NOT NULL GROUP BY d.doc_id""")
def t6_require_ids(spark, sf):
    words = _words(spark, sf).select("doc_id", "words")
    e = tk.require_ids(words, tk.build_vocab(words))
    return e.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), checksum("ids").alias("id_checksum"))


@query("t7_token_percentiles", f"""{with_sql(SQL_DOC_IDS)}
SELECT source, quantile_cont(len(ids), 0.25) AS q25, quantile_cont(len(ids), 0.5) AS q50, quantile_cont(len(ids), 0.75) AS q75
FROM doc_ids GROUP BY source""")
def t7_token_percentiles(spark, sf):
    q = tk.token_percentiles(doc_ids(spark, sf), exact=True)
    return q.select("source", *[F.col("length_quartiles")[i].cast("double").alias(n) for i, n in enumerate(("q25", "q50", "q75"))])


@query("t7_corpus_stats", f"""{with_sql(SQL_DOC_IDS)}
SELECT source, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(ids)) AS BIGINT) AS n_tokens,
       CAST(min(len(ids)) AS BIGINT) AS min_tokens, CAST(max(len(ids)) AS BIGINT) AS max_tokens,
       CAST(sum(len(ids)) * 2 AS BIGINT) AS bytes, CAST(2 AS INTEGER) AS id_width
FROM doc_ids GROUP BY source""")
def t7_corpus_stats(spark, sf):
    return tk.corpus_stats(doc_ids(spark, sf), vocab_size=VOCAB)


@query("t3_subword_codec", """SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, md5(text) AS decoded_md5, true AS fewer_ids_than_bytes
FROM documents WHERE text IS NOT NULL""")
def t3_subword_codec(spark, sf):
    """Every text through a byte-level sub-word vocabulary and back: the decoded text is the text."""
    from public_tokenizers import path

    codec = tk.SubwordCodec(path("byte_bpe_50k.json"))
    d = tk.encode_texts(tables.documents(spark, sf).select("doc_id", "text"), codec)
    back = codec.decode(F.col("ids"))
    return d.select("doc_id", F.octet_length(back).cast("bigint").alias("n_bytes"), F.md5(back).alias("decoded_md5"),
                    (F.size("ids") <= F.octet_length("text")).alias("fewer_ids_than_bytes"))
