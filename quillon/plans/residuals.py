"""Queries of residual mentions, and of units that no span touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import residual, resolve
from .common import SQL_LINES, SQL_MENTIONS, documents, lines, mentions, spans, sql_spans

#: Long words and their beginnings are what a document's memory holds; words at even places have been found already.
BEGIN = 5


def _memory(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = mentions(spark, sf_dir)
    long_ = found.where("entity_type in ('ORGANIZATION', 'ALIAS')").select("doc_id", "entity_type", F.lower("text").alias("key"), F.explode(F.array("text", F.left("text", F.lit(BEGIN)), F.lower(F.substr("text", F.lit(2), F.lit(4))))).alias("surface"))
    return long_.distinct(), found.where("start % 2 = 0")


def residual_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    memory, taken = _memory(spark, sf_dir)
    return residual.materialized(documents(spark, sf_dir), memory, taken)


def residual_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    memory, taken = _memory(spark, sf_dir)
    return residual.hits(documents(spark, sf_dir), memory, taken)


def uncovered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a digit that no span overlaps: what was not looked at."""
    units = lines(spark, sf_dir).where(F.rlike("text", F.lit("[0-9]")))
    return resolve.outside(units, spans(spark, sf_dir)).select("doc_id", "unit_id", "start", "end", "container_type")


QUERIES = {f.__name__: f for f in (residual_mentions, residual_hits, uncovered_lines)}

_MEMORY = f"""f AS ({SQL_MENTIONS}), y AS (SELECT DISTINCT doc_id, entity_type, lower("text") AS key, unnest(["text", left("text", {BEGIN}), lower(substr("text", 2, 4))]) AS surface FROM f WHERE entity_type IN ('ORGANIZATION', 'ALIAS')),
y2 AS (SELECT doc_id, surface, list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(surface) AS pos
       FROM (SELECT *, unnest(range(1, len(parts))) AS i FROM (SELECT DISTINCT y.doc_id, surface, string_split(d.text, surface) AS parts FROM y JOIN documents d USING (doc_id)))),
o AS (SELECT doc_id, list({{'s': "start", 'e': "end"}}) AS busy FROM f WHERE "start" % 2 = 0 GROUP BY doc_id)"""
ORACLES = {
    "residual_hits": f"""WITH {_MEMORY} SELECT y.doc_id, entity_type, key, y.surface, CAST(min(pos) AS INTEGER) AS "start", CAST(min(pos) + any_value(length(y.surface)) AS INTEGER) AS "end"
FROM y JOIN y2 ON y2.doc_id = y.doc_id AND y2.surface = y.surface LEFT JOIN o ON o.doc_id = y.doc_id
WHERE coalesce(len(list_filter(busy, lambda b: pos < b.e AND pos + length(y.surface) > b.s)), 0) = 0 GROUP BY ALL""",
    # one surface of every document at a time, round after round, with what is taken so far
    "residual_mentions": f"""WITH RECURSIVE {_MEMORY},
g AS (SELECT doc_id, surface, list(CAST(pos AS INTEGER) ORDER BY pos) AS places FROM y2 GROUP BY ALL),
v AS (SELECT doc_id, list({{'k': entity_type, 'y': key, 's': surface, 'p': places}} ORDER BY entity_type, key, length(surface) DESC, surface) AS each FROM y JOIN g USING (doc_id, surface) GROUP BY doc_id),
w AS (SELECT v.doc_id, CAST(0 AS BIGINT) AS i, 1 AS round, FALSE AS added, coalesce(busy, []) AS busy, CAST(NULL AS INTEGER) AS pos FROM v LEFT JOIN o USING (doc_id) UNION ALL
 SELECT doc_id, j, r, a OR pos IS NOT NULL, CASE WHEN pos IS NULL THEN busy ELSE list_append(busy, {{'s': pos, 'e': CAST(pos + size AS INTEGER)}}) END, pos
 FROM (SELECT x.*, length(v.each[j].s) AS size, list_filter(v.each[j].p, lambda p: len(list_filter(x.busy, lambda b: p < b.e AND p + length(v.each[j].s) > b.s)) = 0)[1] AS pos
       FROM (SELECT w.doc_id, CASE WHEN i < len(each) THEN i + 1 ELSE 1 END AS j, CASE WHEN i < len(each) THEN round ELSE round + 1 END AS r, CASE WHEN i < len(each) THEN added ELSE FALSE END AS a, busy
             FROM w JOIN v USING (doc_id) WHERE i < len(each) OR added) x JOIN v USING (doc_id)))
SELECT w.doc_id, v.each[i].k AS entity_type, v.each[i].y AS key, v.each[i].s AS surface, w.pos AS "start", CAST(w.pos + length(v.each[i].s) AS INTEGER) AS "end", w.round FROM w JOIN v USING (doc_id) WHERE w.pos IS NOT NULL""",
    "uncovered_lines": f"""WITH u AS ({SQL_LINES}), s AS ({sql_spans()}) SELECT doc_id, unit_id, "start", "end", container_type FROM u WHERE regexp_matches("text", '[0-9]')
AND NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = u.doc_id AND s."start" < u."end" AND s."end" > u."start")""",
}
