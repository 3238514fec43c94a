"""Queries of recognizers, span resolution, units and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import masks
from ..operators import recognize, report, resolve, units
from .common import OVERLAPPING, RULES, SQL_LINES, SQL_MENTIONS, documents, lines, mentions, spans, sql_matches, sql_spans, table

KEYWORDS = {"LICENSE": (["License", "Licensed under", "All rights reserved"], 0.95), "INSULT": (["idiot", "loser", "stupid", "clown"], 0.9), "BLANK": (["  "], 0.5)}
PATTERNS = [{"name": "ticket", "regex": "[A-Z]{2}-[0-9]{4}", "score": 0.9}, {"name": "bang", "regex": "[A-Z]{4,}!!", "score": 0.8}, {"name": "broken", "regex": "([a-z"}]


def mask_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its secrets, addresses, numbers masked: recognise, resolve overlaps, mask, splice."""
    found = resolve.by_priority(spans(spark, sf_dir))
    hidden = F.when(F.col("entity_type") == "EMAIL_ADDRESS", masks.mask_email(F.col("text"))).otherwise(masks.mask(F.col("text")))
    done = resolve.rewrite(documents(spark, sf_dir), found.select("doc_id", "start", "end", hidden.alias("replacement")))
    return done.select("doc_id", F.md5("masked").alias("masked_md5"), F.length("masked").alias("n_chars"), "n_rewritten")


def pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir)


def pii_span_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report.type_counts(spans(spark, sf_dir))
    return found.select("entity_type", "n", F.array_join("examples", "|").alias("examples"))


def span_counts_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.counts_by(spans(spark, sf_dir).withColumn("layer", recognize.of_layer(F.col("source"))), "entity_type", "source", "layer")


def span_overlap_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.mark_overlaps(spans(spark, sf_dir, OVERLAPPING)).select("doc_id", "entity_type", "start", "end", "overlaps", "blocked")


def span_priority_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.by_priority(spans(spark, sf_dir, OVERLAPPING)).select("doc_id", "entity_type", "start", "end")


def span_source_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = spans(spark, sf_dir, OVERLAPPING).withColumn("source", F.when(F.col("entity_type") == "LONG_NUMBER", "ner").otherwise("regex"))
    return resolve.by_source(both).select("doc_id", "entity_type", "start", "end", "source")


def dedupe_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = spans(spark, sf_dir)
    return resolve.dedupe(twice.unionByName(twice.withColumn("score", F.col("score") - 0.1).withColumn("source", F.lit("again")))).select("doc_id", "entity_type", "start", "end", "score", "source")


def embedded_spans_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(spark, sf_dir, OVERLAPPING)
    return resolve.drop_embedded(found, ("LONG_NUMBER",), ("BANK_CARD", "SECRET")).select("doc_id", "entity_type", "start", "end")


def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognize.keywords(documents(spark, sf_dir), KEYWORDS).groupBy("doc_id", "entity_type").agg(F.count("*").alias("n"), F.min("start").alias("first"), F.max("score").alias("score"))


def custom_pattern_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognize.custom_patterns(documents(spark, sf_dir), PATTERNS).select("doc_id", "entity_type", "start", "end", "text")


def repeated_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Further mentions of a document's first line within it."""
    docs = documents(spark, sf_dir)
    first = F.split("text", "\n").getItem(0)
    surfaces = docs.where(F.length(first) >= 12).select("doc_id", F.lit("TITLE").alias("entity_type"), first.alias("surface"))
    taken = surfaces.select("doc_id", F.lit(0).alias("start"), F.length("surface").alias("end"))
    return resolve.propagate(docs, surfaces, taken).select("doc_id", "entity_type", "start", "end")


def field_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognize.fields(documents(spark, sf_dir)).select("doc_id", "line", "part", "label", "value")


def line_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "unit_id", "order_index", "start", "end", F.md5("text").alias("text_md5"), "container_type", "rewritable")


def line_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.context(lines(spark, sf_dir)).select("unit_id", "before", "after")


def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.blocks(lines(spark, sf_dir))


def merged_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = units.merged_fragments(lines(spark, sf_dir))
    return found.select("unit_id", F.size("fragments").alias("n"), F.md5(F.element_at("fragments", -1)).alias("longest_md5"))


def joined_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("order_index"), "text")
    return units.joined_offsets(turns).select("doc_id", "order_index", "start", "end")


def segment_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.segments(documents(spark, sf_dir)).select("doc_id", "segment", "start", "end", F.md5("text").alias("text_md5"))


def segment_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.covered(units.segments(documents(spark, sf_dir)).select("doc_id", "start", "end"))


def soft_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.soft_segments(lines(spark, sf_dir)).select("doc_id", "unit_id", "segment", "start", "end")


def page_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of five lines into groups of at most ten pages and 20 000 characters."""
    pages = lines(spark, sf_dir).groupBy("doc_id", F.floor(F.col("order_index") / 5).cast("int").alias("page_no")).agg(F.sum(F.length("text")).alias("n_chars"))
    return units.page_groups(pages)


def workflow_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.length("text").alias("n_chars"), F.ceil(F.length("text") / 900).alias("n_pages"))
    return units.routed(docs)


def reading_order_inversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("order_index"), F.struct("l_shipdate", "l_linenumber").alias("seen"))
    return units.inversions(items).select("doc_id", "order_index", "top")


def containing_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve.containing(spans(spark, sf_dir), lines(spark, sf_dir))
    return found.select("doc_id", "entity_type", "start", "end", "unit_id")


def mention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(spark, sf_dir).groupBy("entity_type", "source").agg(F.count("*").alias("n"), F.countDistinct("text").alias("surfaces"))


QUERIES = {
    f.__name__: f
    for f in (
        mask_documents, pii_spans, pii_span_stats, span_counts_by, span_overlap_sweep, span_priority_resolve, span_source_resolve, dedupe_spans, embedded_spans_dropped, keyword_hits, custom_pattern_spans,
        repeated_mentions, field_pairs, line_units, line_context, line_blocks, merged_fragments, joined_offsets, segment_windows, segment_coverage, soft_segments, page_groups, workflow_routing, reading_order_inversion, containing_units, mention_counts,
    )
}
ALL = "|".join(f"(?:{r.pattern})" for r in RULES)
SWEEP = f"""s AS ({sql_spans(OVERLAPPING)}), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "start", "end" DESC, entity_type) AS rn FROM s),
  t AS (SELECT *, max({{'e': "end", 'n': -rn}}) OVER (PARTITION BY doc_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM n),
  o AS (SELECT *, coalesce("start" < top.e, false) AS "overlaps" FROM t), h AS (SELECT DISTINCT doc_id, -top.n AS rn FROM o WHERE "overlaps")"""
ORACLES = {
    # spans that overlap are none of the data's, so one pattern of all alternatives finds the same
    "mask_documents": f"""WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '{ALL}') AS m, string_split_regex(text, '{ALL}') AS g FROM documents),
  x AS (SELECT doc_id, len(m) AS n, CASE WHEN len(m) = 0 THEN text ELSE g[1] || array_to_string(list_transform(generate_series(1, len(m)), lambda i:
     (CASE WHEN m[i] LIKE '%@%' THEN left(m[i], 1) || repeat('*', greatest(1, instr(m[i], '@') - 2)) || substr(m[i], instr(m[i], '@')) ELSE repeat('*', length(m[i]) - 4) || right(m[i], 4) END) || g[i + 1]), '') END AS masked FROM d)
  SELECT doc_id, md5(masked) AS masked_md5, CAST(length(masked) AS INTEGER) AS n_chars, CAST(n AS INTEGER) AS n_rewritten FROM x""",
    "pii_spans": sql_spans(),
    "pii_span_stats": f"""WITH s AS ({sql_spans()}), n AS (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY doc_id, "start", text) AS rn FROM s)
  SELECT entity_type, count(*) AS n, string_agg(text, '|' ORDER BY rn) FILTER (WHERE rn <= 3) AS examples FROM n GROUP BY entity_type""",
    "span_counts_by": f"""WITH s AS (SELECT *, 'regex' AS layer FROM ({sql_spans()}))
  SELECT CASE WHEN grouping(entity_type) = 0 THEN 'entity_type' WHEN grouping(source) = 0 THEN 'source' ELSE 'layer' END AS "column", coalesce(entity_type, source, layer) AS value, count(*) AS n
  FROM s GROUP BY GROUPING SETS ((entity_type), (source), (layer))""",
    "span_overlap_sweep": f"""WITH {SWEEP} SELECT o.doc_id, entity_type, "start", "end", "overlaps", "overlaps" OR h.rn IS NOT NULL AS blocked FROM o LEFT JOIN h ON h.doc_id = o.doc_id AND h.rn = o.rn""",
    "dedupe_spans": f"""SELECT doc_id, entity_type, "start", "end", max(score) AS score, 'regex' AS source FROM ({sql_spans()}) GROUP BY ALL""",
    "embedded_spans_dropped": f"""WITH s AS ({sql_spans(OVERLAPPING)}) SELECT doc_id, entity_type, "start", "end" FROM s WHERE entity_type <> 'LONG_NUMBER'
  OR NOT EXISTS (SELECT 1 FROM s o WHERE o.doc_id = s.doc_id AND o.entity_type IN ('BANK_CARD', 'SECRET') AND o."start" <= s."start" AND s."end" <= o."end")""",
    "keyword_hits": f"""WITH s AS ({sql_matches('LICENSE', 'All rights reserved|Licensed under|License', 0.95, 9)} UNION ALL {sql_matches('INSULT', 'stupid|clown|idiot|loser', 0.9, 9)})
  SELECT doc_id, entity_type, count(*) AS n, min("start") AS first, max(score) AS score FROM s GROUP BY ALL""",
    "custom_pattern_spans": f"""SELECT doc_id, entity_type, "start", "end", text FROM ({sql_matches('TICKET', '[A-Z]{2}-[0-9]{4}', 0.9, 9)} UNION ALL {sql_matches('BANG', '[A-Z]{4,}!!', 0.8, 9)})""",
    "repeated_mentions": """WITH d AS (SELECT doc_id, text, string_split(text, chr(10))[1] AS s FROM documents), g AS (SELECT doc_id, s, string_split(text, s) AS g FROM d WHERE length(s) >= 12)
  SELECT doc_id, 'TITLE' AS entity_type, CAST(p AS INTEGER) AS "start", CAST(p + length(s) AS INTEGER) AS "end" FROM (SELECT doc_id, s, unnest(list_transform(generate_series(1, len(g) - 1), lambda i: list_sum(list_transform(g[1:i], lambda x: length(x))) + (i - 1) * length(s))) AS p FROM g) WHERE p >= length(s)""",
    "field_pairs": r"""WITH l AS (SELECT doc_id, i - 1 AS line, w[i] AS t FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents))),
  p AS (SELECT doc_id, line, i - 1 AS part, w[i] AS t FROM (SELECT doc_id, line, w, unnest(generate_series(1, len(w))) AS i FROM (SELECT doc_id, line, string_split_regex(t, '\t| {2,}') AS w FROM l)))
  SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(part AS INTEGER) AS part, regexp_extract(t, '^\s*([^:：]{1,20}?)\s*[:：]\s*(\S.*?)\s*$', 1) AS label, regexp_extract(t, '^\s*([^:：]{1,20}?)\s*[:：]\s*(\S.*?)\s*$', 2) AS value
  FROM p WHERE regexp_extract(t, '^\s*([^:：]{1,20}?)\s*[:：]\s*(\S.*?)\s*$', 1) <> ''""",
    "line_units": f"""SELECT doc_id, unit_id, order_index, "start", "end", md5("text") AS text_md5, container_type, rewritable FROM ({SQL_LINES})""",
    "line_context": f"""SELECT unit_id, right(coalesce(lag("text") OVER w, ''), 40) AS before, left(coalesce(lead("text") OVER w, ''), 40) AS after FROM ({SQL_LINES}) WINDOW w AS (PARTITION BY doc_id ORDER BY order_index)""",
    "line_blocks": rf"""WITH k AS (SELECT doc_id, order_index, CASE WHEN len(string_split_regex(trim("text", ' '), '\t| {{3,}}|\s\|\s')) >= 3 THEN 'table_row' WHEN length("text") <= 40 AND NOT regexp_matches("text", '[。.;；,，!?]\s*$') THEN 'title' ELSE 'line' END AS kind FROM ({SQL_LINES})),
  c AS (SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY doc_id ORDER BY order_index) THEN 1 ELSE 0 END AS new FROM k), b AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY order_index) AS block FROM c)
  SELECT doc_id, CAST(block AS BIGINT) AS block, kind, min(order_index) AS first, max(order_index) AS last, count(*) AS n_lines FROM b GROUP BY doc_id, block, kind""",
    "merged_fragments": f"""WITH f AS (SELECT unit_id, list("text") OVER (PARTITION BY doc_id ORDER BY order_index ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS near FROM ({SQL_LINES})),
  g AS (SELECT unit_id, list_filter(list_transform(generate_series(1, len(near)), lambda i: array_to_string(near[1:i], '')), lambda t, i: i = 1 OR length(t) <= 180) AS fr FROM f)
  SELECT unit_id, CAST(len(fr) AS INTEGER) AS n, md5(fr[-1]) AS longest_md5 FROM g""",
    "joined_offsets": """WITH c AS (SELECT conv_id AS doc_id, turn AS order_index, length(text) AS n, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS "start" FROM conversations)
  SELECT doc_id, order_index, "start", CAST("start" + n AS INTEGER) AS "end" FROM c""",
    "segment_windows": """WITH d AS (SELECT doc_id, text, unnest(generate_series(0, greatest(1, CAST(ceil((length(text) - 180) / 1620) AS INTEGER)) - 1)) AS segment FROM documents WHERE length(text) > 0)
  SELECT doc_id, CAST(segment AS INTEGER) AS segment, CAST(segment * 1620 AS INTEGER) AS "start", CAST(least(segment * 1620 + 1800, length(text)) AS INTEGER) AS "end", md5(substr(text, segment * 1620 + 1, 1800)) AS text_md5 FROM d""",
    "segment_coverage": """SELECT doc_id, length(text) AS covered, CAST(greatest(1, ceil((length(text) - 180) / 1620)) AS BIGINT) AS n FROM documents WHERE length(text) > 0""",
    "workflow_routing": """SELECT doc_id, CAST(length(text) AS INTEGER) AS n_chars, CAST(ceil(length(text) / 900) AS BIGINT) AS n_pages, ceil(length(text) / 900) > 20 OR length(text) >= 20000 AS large FROM documents""",
    "reading_order_inversion": """WITH t AS (SELECT l_orderkey AS doc_id, l_linenumber AS order_index, l_shipdate, max(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM lineitem),
  n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l_shipdate, order_index) AS rn FROM t WHERE order_index + 3 < top) SELECT doc_id, order_index, top FROM n WHERE rn = 1""",
    "containing_units": f"""WITH s AS ({sql_spans()}), u AS ({SQL_LINES}), j AS (SELECT s.*, u.unit_id, row_number() OVER (PARTITION BY s.doc_id, entity_type, s."start", s."end" ORDER BY u."end" - u."start", unit_id) AS rn
   FROM s LEFT JOIN u ON u.doc_id = s.doc_id AND u."start" <= s."start" AND s."end" <= u."end") SELECT doc_id, entity_type, "start", "end", unit_id FROM j WHERE rn = 1""",
    "mention_counts": f"""SELECT entity_type, source, count(*) AS n, count(DISTINCT text) AS surfaces FROM ({SQL_MENTIONS}) GROUP BY ALL""",
}


def _fold_sql(rows: str, fields: str, order: str, prefer: str) -> str:
    """The greedy fold along each document in SQL: lists of one span each are reduced to the list of those that stay; n is the new
    span, o the first taken one that it overlaps."""
    at = "coalesce(list_position(list_transform(acc, lambda t: t.s < x[1].e AND t.e > x[1].s), true), 0)"
    better = prefer.replace("n.", "x[1].").replace("o.", f"acc[{at}].")
    return f"""WITH r AS ({rows}), g AS (SELECT doc_id, list({{{fields}}} ORDER BY {order}) AS l FROM r GROUP BY doc_id),
  f AS (SELECT doc_id, unnest(list_reduce(list_transform(l, lambda x: [x]), lambda acc, x: CASE WHEN {at} = 0 THEN list_concat(acc, x) WHEN {better} THEN list_concat(list_concat(acc[1:{at} - 1], x), acc[{at} + 1:]) ELSE acc END)) AS s FROM g)"""


_PLACE = """'s': "start", 'e': "end", 'k': entity_type, 'c': score"""
ORACLES["span_priority_resolve"] = (
    _fold_sql(sql_spans(OVERLAPPING), _PLACE + ", 'p': priority", '"start", priority, "end" DESC, score DESC, entity_type, source', "CASE WHEN n.p <> o.p THEN n.p < o.p WHEN n.e - n.s <> o.e - o.s THEN n.e - n.s > o.e - o.s ELSE n.c > o.c END")
    + """ SELECT doc_id, s.k AS entity_type, s.s AS "start", s.e AS "end" FROM f"""
)
_RANK = "CASE entity_type WHEN 'LONG_NUMBER' THEN 7 ELSE 1 END"
ORACLES["span_source_resolve"] = (
    _fold_sql(
        sql_spans(OVERLAPPING), _PLACE + f", 'r': {_RANK}, 'sure': entity_type = 'EMAIL_ADDRESS', 'sp': CASE entity_type WHEN 'EMAIL_ADDRESS' THEN 1 ELSE 99 END", f'{_RANK}, score DESC, "start" - "end", "start", "end", entity_type',
        "CASE WHEN n.s = o.s AND n.e = o.e THEN CASE WHEN n.sp <> o.sp THEN n.sp < o.sp ELSE n.c > o.c END WHEN n.sure <> o.sure THEN n.sure ELSE n.k = o.k AND n.e - n.s > o.e - o.s AND n.r <= o.r + 2 END",
    )
    + """ SELECT doc_id, s.k AS entity_type, s.s AS "start", s.e AS "end", CASE s.r WHEN 7 THEN 'ner' ELSE 'regex' END AS source FROM f"""
)
ORACLES["page_groups"] = f"""WITH RECURSIVE p AS MATERIALIZED (SELECT doc_id, page_no, n, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS k FROM (SELECT doc_id, CAST(order_index // 5 AS INTEGER) AS page_no, sum(length("text")) AS n FROM ({SQL_LINES}) GROUP BY ALL)),
  w AS (SELECT doc_id, k, page_no, 0 AS grp, 1 AS pages, n FROM p WHERE k = 1 UNION ALL
    SELECT p.doc_id, p.k, p.page_no, CASE WHEN pages < 10 AND w.n + p.n < 20000 THEN grp ELSE grp + 1 END, CASE WHEN pages < 10 AND w.n + p.n < 20000 THEN pages + 1 ELSE 1 END, CASE WHEN pages < 10 AND w.n + p.n < 20000 THEN w.n + p.n ELSE p.n END
    FROM w JOIN p ON p.doc_id = w.doc_id AND p.k = w.k + 1)
  SELECT doc_id, page_no, grp AS "group" FROM w"""
