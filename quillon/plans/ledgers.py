"""Queries of ledgers, their summaries and rows that repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger, views
from .common import SQL_LINES, SQL_MENTIONS, lines, mentions, table


def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("order_index")
    rows = lines(spark, sf_dir).withColumn("part", F.when(i < 30, "word/document.xml").otherwise("word/Unknown.xml")).withColumn("story_type", F.when(i == 0, "header").otherwise("main"))
    rows = rows.withColumn("container_type", F.when(i % 10 == 9, "xml_text").otherwise(F.col("container_type")))
    return ledger.graph_summary(rows.unionByName(rows.where(i % 3 == 0)))


def plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as obligations."""
    expected = F.filter(F.array(F.when(F.col("l_quantity") < 20, "PERSON"), F.when(F.col("l_discount") > 0.03, "ORGANIZATION")), lambda x: x.isNotNull())
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("priority"), (F.col("l_quantity") >= 45).alias("rewrite_required"), expected.alias("expected"))
    return ledger.plan_summary(rows)


def candidate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("start") % 4 == 0, "").when(F.col("start") % 4 == 1, F.lit(None)).otherwise(F.col("candidate_id"))
    return ledger.candidate_summary(mentions(spark, sf_dir).withColumn("unit_id", unit).withColumn("entity_type", F.concat(F.lit(" "), F.lower("entity_type"))))


def _constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "must_link").when(F.col("l_returnflag") == "N", "maybe_link").otherwise("type_conflict")
    ids = [(F.col(c) % 50).cast("string").alias(a) for c, a in (("l_partkey", "left_id"), ("l_suppkey", "right_id"))]
    return table(spark, sf_dir, "lineitem").select(kind.alias("kind"), *ids, F.col("l_linestatus").alias("evidence"))


def constraint_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of order lines as constraints, each pair in either order once."""
    return ledger.constraint_summary(_constraints(spark, sf_dir))


def canonical_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.canonical_types(mentions(spark, sf_dir).select("doc_id", F.lower("text").alias("surface"), "entity_type"), ["doc_id", "surface"])


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mentions(spark, sf_dir)
    method, key = F.when(F.col("start") % 13 == 0, "Preserve"), F.when(F.length("text") > 6, F.lower(F.left("text", F.lit(4))))
    return rows.withColumn("replacement", F.concat(F.lit("R"), F.col("start") % 5)).withColumn("method", method).withColumn("canonical_key", key)


def final_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ledger.final_directory(_entities(spark, sf_dir))
    return found.select("doc_id", "subject_id", "entity_type", "key", F.array_join("surfaces", "|").alias("surfaces"), "replacement", "occurrences")


def replacement_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _entities(spark, sf_dir)
    candidates = rows.select(F.when(F.col("start") % 2 == 0, F.lower("text")).otherwise("").alias("normalized_text"), "text", F.when(F.col("start") % 3 == 0, "").otherwise(F.col("replacement")).alias("replacement"))
    return ledger.replacement_summary(candidates, rows.select("replacement"))


def verify_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    counts = [F.when(k % 11 == 0, None).otherwise(F.greatest(F.lit(0), k % (i + 3) - i)).cast("long").alias(c) for i, c in enumerate(ledger.BLOCKING)]
    return ledger.verify_rewrite(table(spark, sf_dir, "supplier").select("s_suppkey", *counts, (k % 2 == 0).alias("compilable"), (k % 5 != 0).alias("prewrite_passed")))


KINDS = ("canonical_key_multi_replacement", "same_text_multi_replacement", "replacement_reused_by_multi_subject", "group_memory_conflict", "other")


def invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.invariants(table(spark, sf_dir, "events").select(F.get(F.array(*map(F.lit, KINDS)), (F.col("event_id") % 5).cast("int")).alias("kind")))


def amount_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return ledger.amount_clusters(rows.select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 3).alias("line_start"), (F.col("l_linenumber") % 3 + 40).alias("line_end"), F.concat_ws(" ", "l_orderkey", F.col("l_linenumber") % 3).alias("line"),
        F.col("l_linenumber").alias("start"), F.when(F.col("l_suppkey") % 2 == 0, "共12.50元").otherwise("共12元").alias("text"), (F.col("l_quantity") * 100).alias("value"),
    ))


def resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ledger.resolutions(mentions(spark, sf_dir), _constraints(spark, sf_dir), ("LOCATION",), ("PERSON", "ALIAS"), F.lower(F.left("text", F.lit(1))).isin("a", "e", "s"))
    return found.groupBy("operation", "evidence").agg(F.count("*").alias("n"), F.min("target").alias("first"))


def symbolic_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    style = F.get(F.array(*map(F.lit, ("lower_letter", "upper_letter", "official_greek", "cn"))), (F.col("c_custkey") % 4).cast("int"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", style.alias("style"))
    return ledger.symbolic(rows, ["c_nationkey", "style"], ["c_custkey"]).select("c_custkey", "code")


def alias_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mentions(spark, sf_dir)
    groups = rows.where("start % 2 = 0").select("doc_id", F.col("start").alias("place"), F.concat(F.lit(" "), F.upper("text")).alias("surface"), F.concat(F.lit("R"), "start").alias("replacement"))
    return ledger.alias_replacements(rows.select("doc_id", "start", F.col("text").alias("canonical")), groups)


def model_entities_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mentions(spark, sf_dir).withColumn("place", F.lit(0))
    again = rows.withColumn("entity_type", F.when(F.col("start") % 3 == 0, "PROJECT").otherwise(F.col("entity_type"))).withColumn("score", F.col("score") + (F.col("start") % 5 - 2) / 100).withColumn("source", F.lit("llm_refined")).withColumn("place", F.lit(1))
    return ledger.model_entities_once(rows.unionByName(again)).select("doc_id", "start", "end", "text", "entity_type", F.round("score", 4).alias("score"), "source")


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("task_type"), (F.col("l_suppkey") % 40).alias("page_no"), F.col("l_linestatus").alias("gap_id"), (F.col("l_quantity") * 2).cast("int").alias("priority"), F.concat_ws(":", "l_orderkey", n).alias("task_id"),
        F.when(n == 1, "resolved").when(n == 2, "human_required").otherwise("pending").alias("status"), F.when(n % 3 == 0, "human_review").when(n % 3 == 1, "ocr").otherwise("").alias("next_engine"),
        F.when(F.col("l_discount") == 0, "human_review_required").otherwise("").alias("fallback"), F.when(n % 2 == 0, "cpu").otherwise("").alias("executor"),
    )


def tasks_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.tasks_once(_tasks(spark, sf_dir)).select("task_type", "page_no", "gap_id", "priority", "task_id")


def task_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.task_summary(_tasks(spark, sf_dir))


def rejections_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mentions(spark, sf_dir)
    flags = lambda k, p: rows.withColumn("entity_decision", F.col("start") % k == 0).withColumn("deterministic_decision", F.col("start") % 2 == p).withColumn("deterministic_review", F.col("start") % 3 == p).withColumn("place", F.lit(p))
    return ledger.rejections_once(flags(5, 0).unionByName(flags(7, 1))).select("doc_id", "entity_type", "start", "place")


def snippets_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("order_index")
    kind = F.when(i % 50 == 0, "ledger").when(i % 20 == 1, "discovery").when(F.col("container_type") == "table_row", "structure").otherwise("ordinary")
    rows = lines(spark, sf_dir).select("doc_id", kind.alias("class"), F.left("text", F.lit(12)).alias("key"), "text", (F.length("text") % 7).alias("priority"), i.alias("place"))
    return ledger.snippets(rows, 10).select("doc_id", "class", "place")


def first_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, ("legal_party_block", "narrative_hotspot", "contact"))), F.col("order_index") % 3)
    rows = lines(spark, sf_dir).select("doc_id", kind.alias("snippet_type"), (F.length("text") % 7).alias("keyword_place"), "start")
    return ledger.first_snippets(rows)


def merged_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, n = F.col("order_index"), F.length("text")
    rows = lines(spark, sf_dir).select(
        "doc_id", F.left("text", F.lit(9)).alias("text"), F.array(F.concat(F.lit("c"), i % 3)).alias("categories"), F.array(F.concat(F.lit("t"), i % 11), F.concat(F.lit("u"), n % 3)).alias("tokens"),
        (n % 10).alias("complexity"), (n % 4).alias("risk"), "start", i.alias("place"),
    )
    found = ledger.merged_blocks(rows, 6)
    return found.select("doc_id", "normalized", "complexity", "risk", "start", F.array_join("categories", ",").alias("categories"), F.array_join("tokens", ",").alias("tokens"), "at")


def model_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mentions(spark, sf_dir).select("doc_id", "entity_type", "start", "end")
    uie = rows.where("start % 2 = 0").withColumn("source", F.lit("uie"))
    ner = rows.withColumn("start", F.col("start") + 2).withColumn("end", F.col("end") + 9).withColumn("source", F.when(F.col("start") % 3 == 0, "ner").otherwise("secondary_ner"))
    return ledger.model_conflicts(uie.unionByName(ner))


def united_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber").cast("double")
    x, y = F.pmod(F.col("l_partkey"), F.lit(5)) * 10.0, F.pmod(F.col("l_suppkey"), F.lit(3)) * 6.0
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", x.alias("x0"), y.alias("y0"), (x + 4 + n).alias("x1"), (y + 8).alias("y1"))
    return ledger.united_rectangles(rows, ["l_orderkey"])


def audit_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    quality = F.get(F.array(*map(F.lit, ("usable_with_comments", "failed", "", "no_actionable_candidates"))), (k % 4).cast("int"))
    rows = table(spark, sf_dir, "supplier").select(
        k.alias("audit_id"), (k % 7 != 0).alias("ok"), F.when(k % 5 == 0, "v3").otherwise("v4").alias("engine"), (k % 3).alias("comment_count"), (k % 2).alias("correction_count"), (k % 11 != 0).alias("reviewed_docx"), (k % 2 == 0).alias("text_checked"),
        (k % 4 == 0).alias("text_equal"), F.when(k % 13 != 0, F.lit(True)).alias("audit_report"), (k % 3 == 0).alias("evidence_zip"), (k % 4).alias("missing_entries"), (k % 6).alias("alpha_numeric"), F.when(k % 2 == 0, k % 8).alias("incomplete_numeric"),
        quality.alias("quality_status"), F.when(k % 3 == 0, k).alias("full_content_unresolved"), F.when(k % 5 == 1, k).alias("text_reviewed"), (k % 2).alias("page_types"),
    )
    return ledger.audit_checks(rows)


def gold_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return ledger.gold_verdict(table(spark, sf_dir, "supplier").select(k.alias("sample"), (k % 41).alias("expected"), F.greatest(F.lit(0), k % 41 - k % 3).alias("matched"), F.greatest(F.lit(0), k % 41 + k % 2).alias("confirmed"), F.when(k % 17 == 0, 1).otherwise(0).alias("critical_missed")))


QUERIES = {
    f.__name__: f
    for f in (
        graph_summary, plan_summary, candidate_summary, constraint_summary, canonical_types, final_directory, replacement_summary, verify_rewrite, invariants, amount_clusters, resolutions, symbolic_codes, alias_replacements,
        model_entities_once, tasks_once, task_summary, rejections_once, snippets_selected, first_snippets, merged_blocks, model_conflicts, united_rectangles, audit_checks, gold_verdict,
    )
}


def _tally(rows: str, **counted: str) -> str:
    """SQL of counts of each value of each expression; true alone of booleans."""
    return " UNION ALL ".join(f"SELECT '{k}' AS kind, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {rows} WHERE CAST({c} AS VARCHAR) <> 'false' GROUP BY 2" for k, c in counted.items())


PRIORITY = "CASE entity_type WHEN 'ORGANIZATION' THEN 1 WHEN 'PERSON' THEN 2 WHEN 'ALIAS' THEN 3 WHEN 'LOCATION' THEN 6 ELSE 99 END"
ENTITIES = f"""e AS (SELECT *, 'R' || ("start" % 5) AS replacement, "start" % 13 = 0 AS kept, CASE WHEN length("text") > 6 THEN lower(left("text", 4)) END AS ck FROM ({SQL_MENTIONS}))"""
CONSTRAINTS = """k AS (SELECT DISTINCT CASE l_returnflag WHEN 'A' THEN 'must_link' WHEN 'N' THEN 'maybe_link' ELSE 'type_conflict' END AS kind, least(CAST(l_partkey % 50 AS VARCHAR), CAST(l_suppkey % 50 AS VARCHAR)) AS left_id,
  greatest(CAST(l_partkey % 50 AS VARCHAR), CAST(l_suppkey % 50 AS VARCHAR)) AS right_id, l_linestatus AS evidence FROM lineitem)"""
TASKS = """t AS (SELECT l_returnflag AS task_type, l_suppkey % 40 AS page_no, l_linestatus AS gap_id, CAST(l_quantity * 2 AS INTEGER) AS priority, l_orderkey || ':' || l_linenumber AS task_id, l_linenumber AS n,
  CASE l_linenumber WHEN 1 THEN 'resolved' WHEN 2 THEN 'human_required' ELSE 'pending' END AS status, CASE l_linenumber % 3 WHEN 0 THEN 'human_review' WHEN 1 THEN 'ocr' END AS next_engine, l_discount = 0 AS fb, CASE WHEN l_linenumber % 2 = 0 THEN 'cpu' END AS executor FROM lineitem)"""
K = "s_suppkey"
BLOCKED = [f"(CASE WHEN {K} % 11 = 0 THEN 0 ELSE greatest(0, {K} % {i + 3} - {i}) END)" for i in range(len(ledger.BLOCKING))]
CHECKS = (
    ("worker_output_ok", f"{K} % 7 <> 0", "fail"), ("engine_is_v4", f"{K} % 5 <> 0", "fail"), ("comment_count_matches_corrections", f"{K} % 3 = {K} % 2", "warn"), ("reviewed_docx_exists", f"{K} % 11 <> 0", "fail"),
    ("reviewed_docx_text_unchanged", f"{K} % 2 <> 0 OR {K} % 4 = 0", "fail"), ("audit_report_exists", f"{K} % 13 <> 0", "fail"), ("evidence_zip_exists", f"{K} % 3 = 0", "fail"), ("evidence_zip_has_core_payloads", f"{K} % 4 = 0", "fail"),
    ("no_mandatory_alpha_numeric_replacements", f"{K} % 6 = 0", "fail"), ("no_mandatory_incomplete_numeric_replacements", f"{K} % 2 = 1 OR {K} % 8 = 0", "fail"), ("quality_inspection_passable", f"{K} % 4 <> 1", "fail"),
    ("quality_metrics_present", f"{K} % 3 = 0", "warn"), ("model_gate_metrics_present", f"{K} % 5 = 1", "warn"), ("page_taxonomy_metrics_present", f"{K} % 2 = 1", "warn"),
)
ALPHA = "CASE WHEN i < 26 THEN chr(CAST(65 + i AS INTEGER)) WHEN i < 702 THEN chr(CAST(64 + i // 26 AS INTEGER)) || chr(CAST(65 + i % 26 AS INTEGER)) ELSE chr(CAST(64 + (i // 26 - 1) // 26 AS INTEGER)) || chr(CAST(65 + (i // 26 - 1) % 26 AS INTEGER)) || chr(CAST(65 + i % 26 AS INTEGER)) END"
ORACLES = {
    "graph_summary": f"""WITH u AS (SELECT *, CASE WHEN order_index < 30 THEN 'word/document.xml' ELSE 'word/Unknown.xml' END AS part, CASE WHEN order_index = 0 THEN 'header' ELSE 'main' END AS story, CASE WHEN order_index % 10 = 9 THEN 'xml_text' ELSE container_type END AS container FROM ({SQL_LINES}))
  {_tally('u', unit='true', exact_rewrite='rewritable', review_required='NOT rewritable', unknown_part="container = 'xml_text' OR order_index >= 30", container='container', story='story', part='part')}""",
    "plan_summary": f"""WITH p AS (SELECT l_returnflag AS c, l_linestatus AS s, l_quantity >= 45 AS r, l_quantity < 20 AS a, l_discount > 0.03 AS b FROM lineitem) {_tally('p', obligation='true', category='c', priority='s', rewrite_required='r')}
  UNION ALL SELECT 'expected_type', 'PERSON', count(*) FROM p WHERE a UNION ALL SELECT 'expected_type', 'ORGANIZATION', count(*) FROM p WHERE b""",
    "candidate_summary": f"""WITH m AS (SELECT * FROM ({SQL_MENTIONS})) {_tally('m', candidate='true', with_unit='"start" % 4 > 1', without_unit='"start" % 4 <= 1', source='source', type='entity_type')}""",
    "constraint_summary": f"WITH {CONSTRAINTS} {_tally('k', constraint='true', type='kind', unresolved=chr(40) + 'kind IN (' + repr('maybe_link') + ', ' + repr('type_conflict') + '))')}",
    "canonical_types": f"""WITH c AS (SELECT doc_id, lower("text") AS surface, entity_type, count(*) AS n FROM ({SQL_MENTIONS}) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, surface ORDER BY n DESC, {PRIORITY}, entity_type) AS k FROM c) SELECT doc_id, surface, entity_type AS subject_type FROM r WHERE k = 1""",
    "final_directory": f"""WITH {ENTITIES}, r AS (SELECT doc_id, entity_type, ck IS NOT NULL AS named, coalesce(ck, "text") AS key, "text", count(*) AS n, min("start") AS s, min_by(replacement, "start") AS replacement FROM e WHERE NOT kept AND "text" <> replacement GROUP BY ALL),
  g AS (SELECT doc_id, entity_type, named, key, list("text" ORDER BY n DESC, length("text") DESC, "text")[1:12] AS surfaces, CAST(sum(n) AS BIGINT) AS occurrences, min_by(replacement, s) AS replacement, min(s) AS s FROM r GROUP BY ALL)
  SELECT doc_id, 'CFE' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {PRIORITY}, s, surfaces[1], entity_type, key) AS VARCHAR), 5, '0') AS subject_id, entity_type, key, array_to_string(surfaces, '|') AS surfaces, replacement, occurrences FROM g""",
    "replacement_summary": f"""WITH {ENTITIES}, c AS (SELECT CASE WHEN "start" % 2 = 0 THEN lower("text") ELSE "text" END AS t, count(DISTINCT replacement) AS n FROM e WHERE "start" % 3 <> 0 GROUP BY 1)
  SELECT count(*) AS preassigned, count(*) FILTER (WHERE n > 1) AS multi, (SELECT count(DISTINCT replacement) FROM e) AS compiled FROM c""",
    "verify_rewrite": f"""SELECT {K}, CAST({' + '.join(BLOCKED)} AS BIGINT) AS blocking, array_to_string(list_filter([{', '.join(f"CASE WHEN {b} > 0 THEN '{c}' END" for b, c in zip(BLOCKED, ledger.BLOCKING, strict=True))}], lambda x: x IS NOT NULL), ',') AS blocked_by,
  {' + '.join(BLOCKED)} = 0 AND {K} % 2 = 0 AND {K} % 5 <> 0 AS ready FROM supplier""",
    "invariants": """WITH c AS (SELECT count(*) FILTER (WHERE event_id % 5 = 0) AS a, count(*) FILTER (WHERE event_id % 5 = 1) AS b, count(*) FILTER (WHERE event_id % 5 IN (2, 3)) AS r FROM events)
  SELECT a AS subject_multi_replacement, b AS same_text_multi_replacement, r AS replacement_reused_by_multi_subject, 'subject_multi_replacement,same_text_multi_replacement,replacement_reused_by_multi_subject' AS flags FROM c""",
    "amount_clusters": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 3 ORDER BY l_linenumber, l_suppkey % 2, l_quantity) AS k FROM lineitem),
  v AS (SELECT l_orderkey AS doc_id, l_linenumber % 3 AS line_start, l_linenumber % 3 + 40 AS line_end, l_suppkey % 2 = 0 AS two, greatest(1000.0, l_quantity * 100 * (CAST(1.08 AS DOUBLE) + CAST('0x' || left(md5(l_orderkey || ' ' || (l_linenumber % 3)), 8) AS BIGINT) % 19 / 100)) AS x FROM r WHERE k = 1)
  SELECT doc_id, line_start, line_end, CAST(CASE WHEN two THEN round_even(x, 2) ELSE round_even(x, 0) END AS DOUBLE) AS value FROM v""",
    "resolutions": f"""WITH {CONSTRAINTS}, m AS (SELECT * FROM ({SQL_MENTIONS})), o AS (SELECT 'confirm_candidate' AS operation, 'format_entity_rule_stable' AS evidence, candidate_id AS target FROM m WHERE entity_type = 'LOCATION'
  UNION ALL SELECT 'reject_candidate', 'role_or_title_not_subject', candidate_id FROM m WHERE entity_type IN ('PERSON', 'ALIAS') AND lower(left("text", 1)) IN ('a', 'e', 's') UNION ALL SELECT 'must_link', evidence, left_id || ',' || right_id FROM k WHERE kind = 'must_link')
  SELECT operation, evidence, count(*) AS n, min(target) AS first FROM o GROUP BY ALL""",
    "symbolic_codes": f"""WITH c AS (SELECT c_custkey, c_custkey % 4 AS s, row_number() OVER (PARTITION BY c_nationkey, c_custkey % 4 ORDER BY c_custkey) - 1 AS i FROM customer)
  SELECT c_custkey, CASE s WHEN 0 THEN lower({ALPHA}) WHEN 1 THEN {ALPHA} WHEN 2 THEN ('αβγδεζηθικλμνξοπρστυφχψω')[i % 24 + 1] || CASE WHEN i >= 24 THEN CAST(i // 24 + 1 AS VARCHAR) ELSE '' END ELSE CASE WHEN i < 10 THEN ('甲乙丙丁戊己庚辛壬癸')[i + 1] ELSE '第' || (i + 1) END END AS code FROM c""",
    "alias_replacements": f"""WITH m AS (SELECT doc_id, "start", "text" FROM ({SQL_MENTIONS})), g AS (SELECT doc_id, lower("text") AS k, min("start") AS s FROM m WHERE "start" % 2 = 0 GROUP BY ALL)
  SELECT m.doc_id, "start", "text" AS canonical, coalesce('R' || g.s, '') AS replacement FROM m LEFT JOIN g ON g.doc_id = m.doc_id AND g.k = lower(m."text")""",
    "model_entities_once": f"""WITH m AS (SELECT * FROM ({SQL_MENTIONS})), a AS (SELECT doc_id, "start", "end", "text", entity_type, score, source, 0 AS place FROM m
  UNION ALL SELECT doc_id, "start", "end", "text", CASE WHEN "start" % 3 = 0 THEN 'PROJECT' ELSE entity_type END, score + ("start" % 5 - 2) / 100, 'llm_refined', 1 FROM m),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, "start", "end", "text" ORDER BY CASE entity_type WHEN 'ORGANIZATION' THEN 3 WHEN 'PROJECT' THEN 4 WHEN 'LOCATION' THEN 6 WHEN 'PERSON' THEN 8 ELSE 99 END, score DESC, place DESC) AS k FROM a)
  SELECT doc_id, "start", "end", "text", entity_type, round(score, 4) AS score, source FROM r WHERE k = 1""",
    "tasks_once": f"WITH {TASKS}, r AS (SELECT *, row_number() OVER (PARTITION BY task_type, page_no, gap_id ORDER BY priority DESC, task_id) AS k FROM t) SELECT task_type, page_no, gap_id, priority, task_id FROM r WHERE k = 1",
    "task_summary": f"""WITH {TASKS} {_tally('t', task='true', resolved='n = 1', human_required='(n <> 1 AND (n = 2 OR n % 3 = 0 OR fb))', high_priority='priority >= 85', type='task_type', status='status', next_engine='next_engine', executor='executor')}
  UNION ALL SELECT 'page', 'true', count(DISTINCT page_no) FROM t WHERE page_no > 0""",
    "rejections_once": f"""WITH m AS (SELECT * FROM ({SQL_MENTIONS})), f AS (SELECT doc_id, entity_type, "text", "start", "end", p, 2 * CAST("start" % CASE p WHEN 0 THEN 5 ELSE 7 END = 0 AS INT) + CAST("start" % 2 = p AS INT) + CAST("start" % 3 = p AS INT) AS rank FROM m, (VALUES (0), (1)) v(p)),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, entity_type, "text", "start", "end" ORDER BY rank DESC, p) AS k FROM f) SELECT doc_id, entity_type, "start", p AS place FROM r WHERE k = 1""",
    "snippets_selected": f"""WITH l AS (SELECT doc_id, CASE WHEN order_index % 50 = 0 THEN 'ledger' WHEN order_index % 20 = 1 THEN 'discovery' WHEN container_type = 'table_row' THEN 'structure' ELSE 'ordinary' END AS class, left("text", 12) AS key, length("text") % 7 AS p, order_index AS place FROM ({SQL_LINES})),
  f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY p, place) AS k FROM l), o AS (SELECT *, count(*) FILTER (WHERE class = 'structure') OVER w AS ns, count(*) FILTER (WHERE class = 'discovery') OVER w AS nd, row_number() OVER (PARTITION BY doc_id, class ORDER BY p, place) AS a FROM f WHERE k = 1 WINDOW w AS (PARTITION BY doc_id)),
  b AS (SELECT *, greatest(2, least(ns, 6)) AS most FROM o) SELECT doc_id, class, place FROM b WHERE class IN ('ledger', 'discovery') OR class = 'structure' AND a <= most OR class = 'ordinary' AND a <= greatest(1, 10 - least(most, ns) - nd)""",
    "first_snippets": f"""WITH l AS (SELECT doc_id, ['legal_party_block', 'narrative_hotspot', 'contact'][order_index % 3 + 1] AS snippet_type, CAST(length("text") % 7 AS INTEGER) AS keyword_place, "start" FROM ({SQL_LINES})), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, snippet_type ORDER BY keyword_place, "start") AS k FROM l)
  SELECT doc_id, snippet_type, keyword_place, "start" FROM r WHERE k <= CASE snippet_type WHEN 'legal_party_block' THEN 3 WHEN 'narrative_hotspot' THEN 5 ELSE 2 END""",
    "merged_blocks": f"""WITH l AS (SELECT doc_id, regexp_replace(left("text", 9), '\\s+', '', 'g') AS normalized, CAST(length("text") % 10 AS INTEGER) AS complexity, CAST(length("text") % 4 AS INTEGER) AS risk, "start", order_index AS i, length("text") AS n FROM ({SQL_LINES})),
  b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, normalized ORDER BY complexity DESC, risk DESC, "start", i) AS k FROM l WHERE normalized <> ''),
  c AS (SELECT doc_id, normalized, array_to_string(list_sort(list_distinct(list('c' || (i % 3)))), ',') AS categories, array_to_string(list_sort(list_distinct(list_concat(list('t' || (i % 11)), list('u' || (n % 3)))))[1:8], ',') AS tokens FROM b GROUP BY ALL),
  o AS (SELECT doc_id, normalized, complexity, risk, "start", categories, tokens, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY complexity DESC, risk DESC, "start", normalized) AS INTEGER) AS "at" FROM b JOIN c USING (doc_id, normalized) WHERE k = 1) SELECT * FROM o WHERE "at" <= 6""",
    "model_conflicts": f"""WITH m AS (SELECT * FROM ({SQL_MENTIONS})), u AS (SELECT doc_id, entity_type, "start" AS s, "end" AS e FROM m WHERE "start" % 2 = 0), n AS (SELECT doc_id, entity_type, "start" + 2 AS s, "end" + 9 AS e FROM m),
  j AS (SELECT u.doc_id, least(u.s, n.s) AS f, row_number() OVER (PARTITION BY u.doc_id ORDER BY u.s, u.e, u.entity_type, n.s, n.e, n.entity_type) AS k FROM u JOIN n ON u.doc_id = n.doc_id AND u.s < n.e AND n.s < u.e AND u.entity_type <> n.entity_type) SELECT doc_id, f AS "start" FROM j WHERE k = 1""",
    "united_rectangles": """WITH RECURSIVE r AS (SELECT l_orderkey, (l_partkey % 5) * 10.0::DOUBLE AS x0, (l_suppkey % 3) * 6.0::DOUBLE AS y0, (l_partkey % 5) * 10.0::DOUBLE + 4 + l_linenumber AS x1, (l_suppkey % 3) * 6.0::DOUBLE + 8 AS y1 FROM lineitem),
  o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY y0, x0, y1, x1) AS n FROM r),
  w AS (SELECT l_orderkey, n, 1 AS g, x0, y0, x1, y1 FROM o WHERE n = 1 UNION ALL
    SELECT l_orderkey, n, CASE WHEN m THEN g ELSE g + 1 END, CASE WHEN m THEN least(ax, x0) ELSE x0 END, CASE WHEN m THEN least(ay, y0) ELSE y0 END, CASE WHEN m THEN greatest(bx, x1) ELSE x1 END, CASE WHEN m THEN greatest(by_, y1) ELSE y1 END
    FROM (SELECT o.l_orderkey, o.n, w.g, o.x0, o.y0, o.x1, o.y1, w.x0 AS ax, w.y0 AS ay, w.x1 AS bx, w.y1 AS by_,
      least(w.y1, o.y1) - greatest(w.y0, o.y0) >= least(greatest(w.y1 - w.y0, 0.001), greatest(o.y1 - o.y0, 0.001)) * 0.45 AND o.x0 - w.x1 <= greatest(w.y1 - w.y0, o.y1 - o.y0, 0.001) * 0.8 AS m FROM w JOIN o ON o.l_orderkey = w.l_orderkey AND o.n = w.n + 1))
  SELECT l_orderkey, x0, y0, x1, y1 FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, g ORDER BY n DESC) AS k FROM w) WHERE k = 1""",
    "audit_checks": " UNION ALL ".join(f"""SELECT {K} AS audit_id, '{n}' AS "check", {c} AS passed, '{v}' AS severity FROM supplier""" for n, c, v in CHECKS),
    "gold_verdict": f"""WITH s AS (SELECT {K} AS sample, {K} % 41 AS expected, greatest(0, {K} % 41 - {K} % 3) AS matched, greatest(0, {K} % 41 + {K} % 2) AS confirmed, CASE WHEN {K} % 17 = 0 THEN 1 ELSE 0 END AS critical_missed FROM supplier),
  m AS (SELECT *, CAST(CASE WHEN expected > 0 THEN round(matched / expected, 4) ELSE 1 END AS DOUBLE) AS recall, CAST(CASE WHEN confirmed > 0 THEN round((confirmed - matched) / confirmed, 4) ELSE 0 END AS DOUBLE) AS false_rate FROM s)
  SELECT *, CASE WHEN recall >= 0.95 AND false_rate <= 0.10 AND critical_missed <= 0 THEN 'passed' ELSE 'failed' END AS status FROM m""",
}


def canonical_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.when(F.col("start") % 7 == 0, " ").when(F.col("start") % 3 == 0, F.concat(F.lit("G"), F.length("text")))
    rows = mentions(spark, sf_dir).withColumn("group_id", group).withColumn("canonical_key", F.when(F.col("start") % 5 != 0, F.lower(F.left("text", F.lit(4)))))
    return views.canonical_groups(rows).withColumn("aliases", F.array_join("aliases", "|"))


def unique_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.unique_anchors(mentions(spark, sf_dir).select("doc_id", F.left("text", F.lit(3)).alias("alias"), F.col("text").alias("anchor")))


def review_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as pages, order lines as links and differences."""
    k, n = F.col("s_suppkey"), F.col("l_linenumber")
    labels = F.when(k % 4 == 0, F.array(F.lit("mapping_risk"), F.lit("x"))).otherwise(F.array(F.lit("x")))
    pages = table(spark, sf_dir, "supplier").select(k.alias("page_no"), (k % 3 == 0).alias("needs_table_parser"), (k % 2 == 0).alias("needs_ocr"), F.when(k % 7 != 0, k % 80).alias("anchor_chars"), labels.alias("labels"))
    rows = table(spark, sf_dir, "lineitem")
    links = rows.select(F.col("l_suppkey").alias("page_no"), F.when(n % 3 == 0, "mapping_uncertain").when(n % 3 == 1, "matched").otherwise("other").alias("status"))
    category = F.when(n == 1, "critical_field_changed").when(n == 2, "unlocated_hard_field").when(n == 3, "page_coverage_gap").otherwise("mapping_uncertain")
    return views.review_routes(pages, links, rows.select(F.col("l_suppkey").alias("page_no"), category.alias("category"), F.concat_ws(":", "l_orderkey", n).alias("diff_id")))


QUERIES |= {f.__name__: f for f in (canonical_groups, unique_anchors, review_routes)}
ORACLES |= {
    "canonical_groups": f"""WITH m AS (SELECT doc_id, "text", "start", CASE WHEN "start" % 7 <> 0 AND "start" % 3 = 0 THEN 'G' || length("text") WHEN "start" % 5 <> 0 THEN lower(left("text", 4)) END AS g FROM ({SQL_MENTIONS})),
  s AS (SELECT doc_id, g AS group_id, list("text" ORDER BY length("text") DESC, "start")[1] AS primary_text, count(*) AS mentions FROM m WHERE g IS NOT NULL GROUP BY ALL),
  a AS (SELECT doc_id, group_id, array_to_string(list("text" ORDER BY length("text") DESC, "text"), '|') AS aliases FROM (SELECT DISTINCT doc_id, g AS group_id, "text" FROM m WHERE g IS NOT NULL) GROUP BY ALL)
  SELECT doc_id, group_id, primary_text, aliases, mentions, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY mentions DESC, length(primary_text) DESC, group_id) AS INTEGER) AS place FROM s JOIN a USING (doc_id, group_id)""",
    "unique_anchors": f"""SELECT doc_id, left("text", 3) AS alias, min("text") AS anchor FROM ({SQL_MENTIONS}) GROUP BY ALL HAVING count(DISTINCT "text") = 1""",
    "review_routes": """WITH c AS (SELECT l_suppkey AS p, count(*) FILTER (WHERE l_linenumber % 3 = 1) AS m, count(*) FILTER (WHERE l_linenumber % 3 = 0) AS u FROM lineitem GROUP BY 1),
  s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey % 80 ELSE 0 END AS n FROM supplier)
  SELECT k AS page_no, 'needs_table_parser' AS route, 80 AS priority, CAST(NULL AS VARCHAR) AS key FROM s WHERE k % 3 = 0 UNION ALL SELECT k, 'needs_anchor_ocr', 70, NULL FROM s WHERE k % 2 = 0 AND n <= 0
  UNION ALL SELECT k, 'needs_region_ocr', 75, NULL FROM s WHERE k % 2 = 0 AND n BETWEEN 1 AND 39 AND k % 3 <> 0 UNION ALL SELECT k, 'needs_human_mapping_review', 60, NULL FROM s WHERE k % 4 = 0
  UNION ALL SELECT p, 'text_compare', 40, NULL FROM c WHERE m > 0 UNION ALL SELECT p, 'needs_human_mapping_review', 90, NULL FROM c WHERE u > 0 AND NOT (u < 3 AND m >= 2)
  UNION ALL SELECT l_suppkey, CASE l_linenumber WHEN 1 THEN 'text_compare' ELSE 'needs_recall_guard_review' END, CASE l_linenumber WHEN 1 THEN 95 WHEN 2 THEN 88 ELSE 82 END, l_orderkey || ':' || l_linenumber FROM lineitem WHERE l_linenumber <= 3""",
}
