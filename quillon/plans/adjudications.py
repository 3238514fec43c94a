"""Queries of adjudication: parts as subjects, order lines as their occurrences, and decisions that follow from keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import adjudicate
from .common import table

#: One text for both engines. Parts are merged along chains, some in circles, and later some of the merges are undone or redone.
DECISIONS = """SELECT p_partkey AS seq, concat('E', p_partkey) AS edge_id, CAST(NULL AS STRING) AS occurrence_id, 'merge_to_canonical' AS action, concat('S', p_partkey) AS source_subject_id, concat('S', CAST(floor(p_partkey / 3) AS BIGINT)) AS target_subject_id FROM part WHERE p_partkey % 3 = 0
 UNION ALL SELECT p_partkey + 1000000000, concat('E', p_partkey), NULL, CASE WHEN p_partkey % 2 = 0 THEN 'keep_separate' ELSE 'manual_review' END, NULL, NULL FROM part WHERE p_partkey % 27 = 0
 UNION ALL SELECT p_partkey + 2000000000, concat('C', p_partkey), NULL, 'merge_to_canonical', concat('S', p_partkey), concat('S', CASE WHEN p_partkey % 5 = 4 THEN p_partkey - 4 ELSE p_partkey + 1 END) FROM part WHERE p_partkey % 40 < 5
 UNION ALL SELECT o_orderkey, NULL, concat(o_orderkey, ':1'), CASE o_orderkey % 4 WHEN 0 THEN 'confirm' WHEN 1 THEN 'reject' WHEN 2 THEN 'keep_separate' ELSE 'manual_review' END, NULL, NULL FROM orders WHERE o_orderkey % 3 = 0"""
EDGES = "SELECT concat(k, p_partkey) AS edge_id, 'open' AS status FROM part {cross} WHERE p_partkey % 3 = 0 OR p_partkey % 40 < 5"
OCCURRENCES = "SELECT concat(l_orderkey, ':', l_linenumber) AS occurrence_id, concat('S', l_partkey) AS subject_id, concat(l_returnflag, l_partkey % 7) AS text, CASE WHEN l_linenumber % 2 = 0 THEN 'unresolved_alias' ELSE 'confirmed_subject' END AS status FROM lineitem"


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    names = [n for n in ("part", "orders", "lineitem") if f"FROM {n}" in text]
    for n in names:
        text = text.replace(f"FROM {n}", f"FROM {{{n}}}")
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


def subject_id_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjudicate.id_map(_sql(spark, sf_dir, DECISIONS))


def adjudicated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _sql(spark, sf_dir, EDGES.format(cross="LATERAL VIEW explode(array('E', 'C')) t AS k"))
    return adjudicate.resolved_edges(edges, _sql(spark, sf_dir, DECISIONS))


def adjudicated_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = _sql(spark, sf_dir, DECISIONS)
    return adjudicate.resolved_occurrences(_sql(spark, sf_dir, OCCURRENCES), decisions, adjudicate.id_map(decisions))


def adjudicated_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = _sql(spark, sf_dir, DECISIONS)
    ids = adjudicate.id_map(decisions)
    return adjudicate.resolved_subjects(adjudicate.resolved_occurrences(_sql(spark, sf_dir, OCCURRENCES), decisions, ids), ids)


QUERIES = {f.__name__: f for f in (subject_id_map, adjudicated_edges, adjudicated_occurrences, adjudicated_subjects)}

_MAP = f"""WITH RECURSIVE d AS ({DECISIONS.replace("AS STRING", "AS VARCHAR")}), last AS (SELECT * FROM d WHERE edge_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY seq DESC) = 1),
s AS (SELECT source_subject_id AS a, target_subject_id AS b FROM last WHERE action = 'merge_to_canonical' AND source_subject_id <> target_subject_id QUALIFY row_number() OVER (PARTITION BY source_subject_id ORDER BY seq DESC) = 1),
w AS (SELECT a, b, [a] AS seen FROM s UNION ALL SELECT w.a, s.b, list_append(w.seen, w.b) FROM w JOIN s ON s.a = w.b WHERE NOT list_contains(w.seen, w.b)),
e AS (SELECT a, b, seen FROM w QUALIFY row_number() OVER (PARTITION BY a ORDER BY len(seen) DESC) = 1),
m AS (SELECT a AS source, CASE WHEN list_contains(seen, b) THEN list_min(seen[list_position(seen, b):]) ELSE b END AS target FROM e),
ids AS (SELECT * FROM m WHERE source <> target)"""
_OCC = f"""{_MAP}, o AS (SELECT * FROM d WHERE occurrence_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY occurrence_id ORDER BY seq DESC) = 1),
r AS (SELECT x.occurrence_id, coalesce(target, x.subject_id) AS subject_id, CASE WHEN target IS NOT NULL THEN x.subject_id END AS original_subject_id, text,
 CASE WHEN target IS NOT NULL THEN 'confirmed_subject' ELSE CASE action WHEN 'confirm' THEN 'confirmed_subject' WHEN 'keep_separate' THEN 'confirmed_separate_subject' WHEN 'reject' THEN 'rejected_subject' WHEN 'manual_review' THEN 'manual_review_required' ELSE x.status END END AS status
 FROM ({OCCURRENCES}) x LEFT JOIN ids ON ids.source = x.subject_id LEFT JOIN o ON o.occurrence_id = x.occurrence_id)"""
ORACLES = {
    "subject_id_map": f"{_MAP} SELECT source, target FROM ids",
    "adjudicated_edges": f"""{_MAP} SELECT g.edge_id, l.action, CASE WHEN l.action IS NULL THEN g.status ELSE CASE l.action WHEN 'merge_to_canonical' THEN 'adjudicated_merge' WHEN 'keep_separate' THEN 'adjudicated_keep_separate' ELSE 'manual_review_required' END END AS status
 FROM ({EDGES.format(cross=", (VALUES ('E'), ('C')) t(k)")}) g LEFT JOIN last l ON l.edge_id = g.edge_id""",
    "adjudicated_occurrences": f"{_OCC} SELECT * FROM r",
    "adjudicated_subjects": f"""{_OCC}, c AS (SELECT target AS subject_id, count(*) AS merged FROM ids GROUP BY 1) SELECT r.subject_id, count(*) AS occurrences, count(DISTINCT text) AS surfaces, string_agg(DISTINCT status, ',' ORDER BY status) AS statuses, coalesce(any_value(merged), 0) AS merged FROM r LEFT JOIN c USING (subject_id) GROUP BY 1""",
}
