"""Registered queries for the question/answer target."""

from __future__ import annotations

from pyspark.sql import functions as F

from blendwise.operators import qa
from blendwise.plans.common import SEED, SQL_WORDS, VOCAB, checksum
from blendwise.plans.loss_queries import rnd
from blendwise.plans.registry import query
from blendwise.sources import tables

SAMPLE_SMALL = 20   # per task, small enough to cut at every scale factor

SQL_QA = """qa AS (
  SELECT CASE conv_id % 4 WHEN 0 THEN 'hellaswag' WHEN 1 THEN 'arc_challenge' WHEN 2 THEN 'piqa' ELSE 'sciq' END AS task,
         conv_id || ':' || turn AS pair_id, text AS question, ntext AS answer
  FROM (SELECT *, lead(role) OVER w AS nrole, lead(text) OVER w AS ntext FROM conversations
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND nrole = 'assistant')"""


def sql_sample(n: int | None = None) -> str:
    cut = f""" QUALIFY row_number() OVER (PARTITION BY task
      ORDER BY ('0x' || substr(md5('{SEED}:' || pair_id), 1, 15))::BIGINT, pair_id) <= {n}""" if n else ""
    return f"""smp AS (SELECT * FROM qa{cut}),
ordered AS (SELECT *, row_number() OVER (ORDER BY ('0x' || substr(md5('{SEED}:order:' || pair_id), 1, 15))::BIGINT, pair_id) AS qa_order
            FROM smp)"""


_HASH = f"lambda w: CAST(1 + (('0x' || substr(md5(w), 1, 8))::BIGINT % {VOCAB - 1}) AS INTEGER)"
SQL_ITEMS = f"""it0 AS (SELECT *, list_transform({SQL_WORDS.replace('text', "question || ' ' || answer")}, {_HASH}) AS ids,
                len({SQL_WORDS.replace('text', 'question')}) AS qlen FROM ordered),
items AS (SELECT *, list_transform(ids, lambda x, i: CASE WHEN i < qlen OR i >= len(ids) THEN -100 ELSE ids[i + 1] END) AS targets
          FROM it0)"""


def pairs(spark, sf):
    return qa.pairs_from_conversations(tables.table(spark, sf, "conversations"))


def items(spark, sf):
    """All pairs in their seeded order (sampling per task is Q1's option)."""
    return qa.qa_targets(qa.union_shuffled(pairs(spark, sf), SEED), VOCAB)


@query("q6_pairs_from_conversations", f"""WITH {SQL_QA}
SELECT task, pair_id, md5(question) AS question_md5, md5(answer) AS answer_md5 FROM qa""")
def q6_pairs(spark, sf):
    return pairs(spark, sf).select("task", "pair_id", F.md5("question").alias("question_md5"), F.md5("answer").alias("answer_md5"))


@query("q1_sample_per_task", f"""WITH {SQL_QA}, {sql_sample(SAMPLE_SMALL)}
SELECT task, pair_id FROM smp""")
def q1_sample(spark, sf):
    return qa.sample_per_task(pairs(spark, sf), SAMPLE_SMALL, SEED).select("task", "pair_id")


@query("q2_union_shuffled", f"""WITH {SQL_QA}, {sql_sample()}
SELECT task, pair_id, CAST(qa_order AS BIGINT) AS qa_order FROM ordered""")
def q2_union(spark, sf):
    return qa.union_shuffled(pairs(spark, sf), SEED).select("task", "pair_id", "qa_order")


@query("q3_qa_text", f"""WITH {SQL_QA}
SELECT pair_id, md5(question || ' ' || answer) AS text_md5 FROM qa""")
def q3_text(spark, sf):
    return qa.qa_text(pairs(spark, sf)).select("pair_id", F.md5("text").alias("text_md5"))


@query("q4_qa_targets", f"""WITH {SQL_QA}, {sql_sample()}, {SQL_ITEMS}
SELECT pair_id, CAST(len(ids) AS BIGINT) AS n_ids, CAST(qlen AS INTEGER) AS qlen,
       CAST(len(list_filter(targets, lambda t: t <> -100)) AS BIGINT) AS n_kept,
       CAST(list_sum(list_transform(targets, lambda x, i: CAST(x AS BIGINT) * i)) AS BIGINT) AS target_checksum
FROM items""")
def q4_targets(spark, sf):
    it = items(spark, sf)
    return it.select("pair_id", F.size("ids").cast("bigint").alias("n_ids"), F.col("qlen").cast("int"),
                     F.size(F.filter("targets", lambda t: t != -100)).cast("bigint").alias("n_kept"),
                     checksum("targets").alias("target_checksum"))


@query("q5_qa_batches", f"""WITH {SQL_QA}, {sql_sample()}, {SQL_ITEMS},
bt AS (SELECT (qa_order - 1) // 16 AS batch, count(*) AS n_items, flatten(list(ids ORDER BY qa_order)) AS ids,
              flatten(list(targets ORDER BY qa_order)) AS targets FROM items GROUP BY 1)
SELECT CAST(batch AS BIGINT) AS batch, n_items, CAST(len(ids) AS BIGINT) AS n_ids,
       CAST(list_sum(list_transform(ids, lambda x, i: CAST(x AS BIGINT) * i)) AS BIGINT) AS id_checksum,
       CAST(list_sum(list_transform(targets, lambda x, i: CAST(x AS BIGINT) * i)) AS BIGINT) AS target_checksum
FROM bt""")
def q5_batches(spark, sf):
    b = qa.qa_batches(items(spark, sf))
    return b.select("batch", "n_items", F.size("ids").cast("bigint").alias("n_ids"),
                    checksum("ids").alias("id_checksum"), checksum("targets").alias("target_checksum"))


@query("l11_qa_gradient", f"""WITH {SQL_QA}, {sql_sample()}, {SQL_ITEMS},
pos AS (SELECT (qa_order - 1) // 16 AS batch, unnest(ids) AS u, unnest(targets) AS v FROM items),
cnt AS (SELECT batch, u, v, count(*) AS n FROM pos WHERE v <> -100 GROUP BY ALL),
nb AS (SELECT batch, sum(n) AS Nb FROM cnt GROUP BY batch),
ln_ AS (SELECT (qa_order - 1) // 16 AS batch, count(*) AS len FROM items GROUP BY 1),
q AS (SELECT u, v, sum(n / (Nb * len)) / ((SELECT count(*) FROM items) // 16) AS q
      FROM cnt JOIN nb USING (batch) JOIN ln_ USING (batch) GROUP BY u, v)
SELECT u, v, round(q * 1e6, 6) AS q_e6 FROM q""")
def l11_qa_gradient(spark, sf):
    g = qa.qa_gradient(items(spark, sf), check=False)
    return g.q.select("u", "v", rnd("q", 6, 1e6).alias("q_e6"))


@query("l11_qa_gradient_exact", f"""WITH {SQL_QA}, {sql_sample()}, {SQL_ITEMS},
pos AS (SELECT unnest(ids) AS u, unnest(targets) AS v FROM items),
cnt AS (SELECT u, v, count(*) AS n FROM pos WHERE v <> -100 GROUP BY ALL)
SELECT u, v, round(n / (SELECT sum(n) FROM cnt) * 1e6, 6) AS q_e6 FROM cnt""")
def l11_qa_gradient_exact(spark, sf):
    g = qa.qa_gradient(items(spark, sf), exact=True, check=False)
    return g.q.select("u", "v", rnd("q", 6, 1e6).alias("q_e6"))
