"""Query of language model scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lm_scoring
from .common import table


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scoring.score(table(spark, sf_dir, "documents"))
    return scored.withColumn("log_score", F.round("log_score", 3)).withColumn("mean_log_score", F.round("mean_log_score", 5))


WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
QUERIES = {"op3_lm_scoring": op3_lm_scoring}
ORACLES = {
    "op3_lm_scoring": f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
t AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i > 1 THEN w[i - 1] END AS prev, CASE WHEN i > 2 THEN w[i - 2] END AS first
      FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d WHERE len(w) > 0)),
o1 AS (SELECT doc_id, word, count(*) AS c FROM t GROUP BY ALL), c1 AS (SELECT word, sum(c) AS c FROM o1 GROUP BY word),
o2 AS (SELECT doc_id, prev, word, count(*) AS c FROM t WHERE prev IS NOT NULL GROUP BY ALL), c2 AS (SELECT prev, word, sum(c) AS c FROM o2 GROUP BY ALL),
o3 AS (SELECT doc_id, first, prev, word, count(*) AS c FROM t WHERE first IS NOT NULL GROUP BY ALL), c3 AS (SELECT first, prev, word, sum(c) AS c FROM o3 GROUP BY ALL),
total AS (SELECT sum(c) AS n FROM c1), own AS (SELECT doc_id, len(w) AS n FROM d),
x AS (SELECT t.doc_id, t.first IS NOT NULL AS third, t.prev IS NOT NULL AS mid, coalesce(c3.c - o3.c, 0) AS triple, p2.c - q2.c AS before2,
             coalesce(c2.c - o2.c, 0) AS pair, p1.c - q1.c AS before, c1.c - o1.c AS alone, greatest(1, total.n - own.n) AS n
      FROM t CROSS JOIN total JOIN own USING (doc_id)
      JOIN c1 ON c1.word = t.word JOIN o1 ON o1.doc_id = t.doc_id AND o1.word = t.word
      LEFT JOIN c2 ON c2.prev = t.prev AND c2.word = t.word LEFT JOIN o2 ON o2.doc_id = t.doc_id AND o2.prev = t.prev AND o2.word = t.word
      LEFT JOIN c1 p1 ON p1.word = t.prev LEFT JOIN o1 q1 ON q1.doc_id = t.doc_id AND q1.word = t.prev
      LEFT JOIN c3 ON c3.first = t.first AND c3.prev = t.prev AND c3.word = t.word
      LEFT JOIN o3 ON o3.doc_id = t.doc_id AND o3.first = t.first AND o3.prev = t.prev AND o3.word = t.word
      LEFT JOIN c2 p2 ON p2.prev = t.first AND p2.word = t.prev LEFT JOIN o2 q2 ON q2.doc_id = t.doc_id AND q2.prev = t.first AND q2.word = t.prev),
y AS (SELECT doc_id, alone, CASE WHEN triple > 0 THEN 0 WHEN pair > 0 THEN CAST(third AS INT) ELSE CAST(third AS INT) + CAST(mid AS INT) END AS steps,
             CASE WHEN triple > 0 THEN ln(triple / before2) WHEN pair > 0 THEN ln(pair / before) ELSE ln((CASE WHEN alone > 0 THEN alone ELSE 0.5 END) / n) END AS base FROM x),
s AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE steps > 0) AS n_backed_off, count(*) FILTER (WHERE alone = 0) AS n_unseen, sum(base + steps * ln(0.4)) AS score FROM y GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_backed_off, 0) AS n_backed_off, coalesce(n_unseen, 0) AS n_unseen,
       round(CAST(coalesce(score, 0) AS DOUBLE), 3) AS log_score, round(CAST(coalesce(score / n_words, 0) AS DOUBLE), 5) AS mean_log_score
FROM d LEFT JOIN s USING (doc_id)"""
}
