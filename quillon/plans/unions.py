"""Queries of identity under a conflict guard: the capitalised words of each document as mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import unions
from ..session import checkpointed
from .common import SQL_MENTIONS, mentions

#: The letters that begin a word make it a candidate for the subjects of others that begin so; the last two are a stable
#: key of longer words, so that words that begin alike but end otherwise are not united.
BEGIN, KEYED = 3, 7


def surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of a document: doc_id, node, pos (the first place), text, tokens, keys, family, canonical and role."""
    found = mentions(spark, sf_dir).groupBy("doc_id", "text").agg(F.min("start").cast("long").alias("pos"), F.min("entity_type").alias("family"))
    ending = F.when(F.length("text") >= KEYED, F.right("text", F.lit(2)))
    tokens = F.array(F.concat(F.lit("begin:"), F.left("text", F.lit(BEGIN))), F.concat(F.lit("size:"), F.left("text", F.lit(1)), F.length("text").cast("string")))
    role = F.when(F.length("text") % 2 == 0, "even").when(F.length("text") % 3 == 0, "third")
    return found.select("doc_id", F.concat_ws(":", "doc_id", "text").alias("node"), "pos", F.lower("text").alias("text"), tokens.alias("tokens"), F.when(ending.isNull(), F.array().cast("array<string>")).otherwise(F.array(ending)).alias("keys"),
                        F.lit("word").alias("family"), ending.alias("canonical"), role.alias("role"))


def identity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the links of each document are: from the first word of each token, in order of the later word."""
    found = unions.token_links(surfaces(spark, sf_dir))
    return found.select("left", "right", F.col("ord.at").alias("at"), F.col("ord.by").alias("token"))


def guarded_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = checkpointed(surfaces(spark, sf_dir))
    return unions.guarded(own, unions.token_links(own), "doc_id").select("node", "subject")


def contained_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unions.contained_links(surfaces(spark, sf_dir)).select("left", "right", F.col("ord.at").alias("at"))


QUERIES = {f.__name__: f for f in (identity_links, guarded_subjects, contained_names)}

_SURFACES = f"""s AS (SELECT doc_id, doc_id || ':' || "text" AS node, CAST(min("start") AS BIGINT) AS pos, lower("text") AS name,
 ['begin:' || left("text", {BEGIN}), 'size:' || left("text", 1) || length("text")] AS tokens, CASE WHEN length("text") >= {KEYED} THEN right("text", 2) END AS ending,
 CASE WHEN length("text") % 2 = 0 THEN 'even' WHEN length("text") % 3 = 0 THEN 'third' END AS role FROM ({SQL_MENTIONS}) GROUP BY doc_id, "text")"""
_LINKS = """t AS (SELECT doc_id, node, pos, unnest(tokens) AS token FROM s),
l AS (SELECT doc_id, first_value(node) OVER w AS a, node AS b, pos, token FROM t WINDOW w AS (PARTITION BY doc_id, token ORDER BY pos, node)), e AS (SELECT * FROM l WHERE a <> b)"""
ORACLES = {
    "identity_links": f"""WITH {_SURFACES}, {_LINKS} SELECT a AS "left", b AS "right", pos AS "at", token FROM e""",
    # a document's words and links in lists; each step takes the next link of every document
    "guarded_subjects": f"""WITH RECURSIVE {_SURFACES}, {_LINKS},
n AS (SELECT doc_id, node, row_number() OVER (PARTITION BY doc_id ORDER BY node) AS i, ending FROM s),
g AS (SELECT doc_id, list(struct_pack(l := i, r := j) ORDER BY pos, token, b) AS links FROM (SELECT e.*, x.i AS i, y.i AS j FROM e JOIN n x ON x.node = e.a JOIN n y ON y.node = e.b) GROUP BY doc_id),
d AS (SELECT doc_id, list(i ORDER BY i) AS label, list(CASE WHEN ending IS NULL THEN CAST([] AS VARCHAR[]) ELSE [ending] END ORDER BY i) AS keys FROM n GROUP BY doc_id),
w AS (SELECT d.doc_id, 1 AS k, label, keys FROM d UNION ALL
 SELECT doc_id, k + 1, CASE WHEN ok THEN list_transform(label, lambda x: CASE WHEN x = b THEN a ELSE x END) ELSE label END,
        CASE WHEN ok AND len(keys[b]) > 0 THEN list_concat(list_append(keys[1:a - 1], list_distinct(list_concat(keys[a], keys[b]))), keys[a + 1:]) ELSE keys END
 FROM (SELECT *, a <> b AND (len(keys[a]) = 0 OR len(keys[b]) = 0 OR list_has_any(keys[a], keys[b])) AS ok
       FROM (SELECT w.doc_id, w.k, w.label, w.keys, w.label[g.links[w.k].l] AS a, w.label[g.links[w.k].r] AS b FROM w JOIN g ON g.doc_id = w.doc_id AND w.k <= len(g.links)))),
f AS (SELECT w.doc_id, w.label FROM w LEFT JOIN g USING (doc_id) WHERE w.k = coalesce(len(g.links), 0) + 1)
SELECT n.node, min(n.node) OVER (PARTITION BY n.doc_id, f.label[n.i]) AS subject FROM n JOIN f USING (doc_id)""",
    "contained_names": f"""WITH {_SURFACES} SELECT DISTINCT CASE WHEN y.pos <= x.pos THEN y.node ELSE x.node END AS "left", CASE WHEN y.pos <= x.pos THEN x.node ELSE y.node END AS "right", greatest(x.pos, y.pos) AS "at"
FROM s x JOIN s y ON x.doc_id = y.doc_id AND length(x.name) >= {unions.LEAST_SHORT} AND length(x.name) < length(y.name) AND contains(y.name, x.name)
AND coalesce(x.ending = y.ending, TRUE) AND coalesce(x.role = y.role, TRUE)""",
}
