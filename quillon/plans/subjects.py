"""Queries of coverage, identity and replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coverage, gate, identity, resolve
from ..sources import sinks
from .common import SQL_LINES, SQL_MENTIONS, documents, lines, mentions, spans, sql_spans


def coverage_obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = coverage.obligations(lines(spark, sf_dir), coverage.LATIN_FAMILIES)
    return found.select("unit_id", "category", "reason", F.array_join("expected", ",").alias("expected"), F.array_join("checks", ",").alias("checks"), "priority", "rewrite_required")


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = resolve.containing(spans(spark, sf_dir), lines(spark, sf_dir)).where("unit_id is not null")
    return coverage.match(coverage.obligations(lines(spark, sf_dir), coverage.LATIN_FAMILIES), placed.select("unit_id", "entity_type", "source"))


def coverage_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select("unit_id", "category", "priority", "matches", "status")


def _conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identity.type_conflicts(mentions(spark, sf_dir))
    return found.select(F.lit("type_conflict").alias("kind"), F.concat_ws("|", "doc_id", "surface", "left_type", "right_type").alias("key"))


def arbitration_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.arbitration(_matched(spark, sf_dir), _conflicts(spark, sf_dir)).groupBy("kind", "severity").agg(F.count("*").alias("n"), F.min("key").alias("first"))


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = resolve.containing(spans(spark, sf_dir), lines(spark, sf_dir))
    new = F.when(F.col("entity_type") == "IP_ADDRESS", F.lit("")).otherwise(F.concat(F.lit("["), F.substr("entity_type", F.lit(1), F.lit(3)), F.left(F.md5("text"), F.lit(6)), F.lit("]")))
    return placed.withColumn("replacement", new).withColumn("entity_type", F.when(F.col("entity_type") == "PHONE", "DATE").otherwise(F.col("entity_type")))


def rewrite_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.rewrite_ledger(_entities(spark, sf_dir), lines(spark, sf_dir)).select("doc_id", "unit_id", "entity_type", "start", "end", "replacement", "status", "failure_reason")


def export_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.export_ready(coverage.rewrite_ledger(_entities(spark, sf_dir), lines(spark, sf_dir)))


def replacement_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.mapping(_entities(spark, sf_dir)).select("doc_id", "place", "entity_type", "text", "replacement")


def export_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.export_entries(_entities(spark, sf_dir))


def must_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.must_links(mentions(spark, sf_dir)).select("left_id", "right_id")


def identity_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.type_conflicts(mentions(spark, sf_dir))


def maybe_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    surfaces = mentions(spark, sf_dir).where("entity_type in ('ORGANIZATION', 'ALIAS')").select("doc_id", identity.normalized(F.col("text")).alias("surface"))
    return identity.maybe_links(surfaces)


def subject_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identity.directory(mentions(spark, sf_dir))
    return found.select("doc_id", "subject_id", "entity_type", "canonical", F.array_join("surfaces", "|").alias("surfaces"), "mentions", "first_start", "replacement")


def directory_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.quality_gate(mentions(spark, sf_dir))


def subject_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a document as cards, their capitalised words as surfaces: what shares a word is one subject."""
    found = mentions(spark, sf_dir).where("entity_type <> 'LOCATION'")
    card = F.floor(F.col("start") / 300)
    return identity.card_components(found.select("doc_id", card.alias("card"), F.col("text").alias("surface")))


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mentions(spark, sf_dir).groupBy("doc_id", "entity_type", "text").agg(F.min("start").alias("first_start"))
    return found.select("doc_id", F.concat_ws(":", "entity_type", "text").alias("group_id"), F.left("text", F.lit(1)).alias("base"), F.col("entity_type").alias("scope"), "first_start")


def replacement_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.suffixed(_groups(spark, sf_dir)).select("doc_id", "group_id", "replacement")


def replacement_serials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.serials(_groups(spark, sf_dir)).select("doc_id", "group_id", "alias")


def replacement_renumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects whose names were given per stretch of 1 000 characters, made distinct over the document."""
    from pyspark.sql import Window

    stretch = F.floor(F.col("first_start") / 1000)
    number = F.row_number().over(Window.partitionBy("doc_id", "scope", stretch).orderBy("first_start", "group_id"))
    named = _groups(spark, sf_dir).select("doc_id", F.col("group_id").alias("subject_id"), "first_start", F.concat("scope", number.cast("string")).alias("replacement"))
    return identity.renumbered(named).select("doc_id", "subject_id", "replacement")


def first_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = mentions(spark, sf_dir).select("doc_id", "start", "end", F.lower("text").alias("key"), "text", F.concat(F.lit("#"), "start").alias("replacement"))
    return identity.first_wins(named).select("doc_id", "start", "key", "replacement")


def entity_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identity.memory(mentions(spark, sf_dir).withColumn("group_id", F.lower("text")))
    return found.select("doc_id", "group_id", F.array_join("variants", "|").alias("variants"), F.array_join("sources", "|").alias("sources"), "confidence", "first_start", "last_start", "primary", "mentions")


def replacement_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = mentions(spark, sf_dir).withColumn("group_id", F.lower("text")).withColumn("replacement", F.concat("entity_type", F.lit("-"), F.left("text", F.lit(2))))
    return identity.inconsistencies(named)


def masked_by_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mention replaced by its subject's name: directory, join, splice."""
    found = mentions(spark, sf_dir).withColumn("key", identity.normalized(F.col("text")))
    names = identity.directory(mentions(spark, sf_dir)).select("doc_id", "entity_type", "key", "replacement")
    edits = found.join(names, ["doc_id", "entity_type", "key"]).select("doc_id", "start", "end", "replacement")
    return resolve.rewrite(documents(spark, sf_dir), edits).select("doc_id", "n_rewritten", F.md5("masked").alias("masked_md5"))


def admission_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions as candidates, with signals that follow from their places and texts."""
    signals = F.filter(F.array(F.when(F.pmod("start", F.lit(13)) == 0, gate.HARD[2]), F.when(F.pmod("start", F.lit(11)) == 0, "weak")), lambda x: x.isNotNull())
    failed = F.filter(F.array(F.when(F.length("text") > 12, "too_long")), lambda x: x.isNotNull())
    found = gate.decide(mentions(spark, sf_dir).withColumn("rejected", F.col("text").rlike("^(?:The|Die|Les)$")).withColumn("negative", signals).withColumn("failed", failed))
    return found.groupBy("entity_type", "layer", "action", "risk").agg(F.count("*").alias("n"), F.min("text").alias("first"))


def public_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gate.known(mentions(spark, sf_dir)).withColumn("family", gate.family(F.col("entity_type"), F.col("text"), F.concat("text", F.lit("公司"))))
    return found.groupBy("entity_type", "family").agg(F.count("*").alias("n"))


def grouped_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans within stretches of 2 000 characters, placed from the stretch's start and back."""
    n = F.length("text")
    groups = documents(spark, sf_dir).where(n > 0).select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / 2000))).alias("group"))
    groups = groups.select("doc_id", "group", (F.col("group") * 2000).cast("int").alias("start"), F.least(F.col("group") * 2000 + 2000, F.col("n")).cast("int").alias("end"))
    local = gate.in_group(spans(spark, sf_dir), groups)
    back = gate.restored(local).select("doc_id", "entity_type", "group", F.col("start").alias("start"), "end")
    return back.join(local.select("doc_id", "entity_type", "group", (F.col("start") + F.col("g_start")).alias("start"), F.col("start").alias("local_start")), ["doc_id", "entity_type", "group", "start"])


QUERIES = {
    f.__name__: f
    for f in (
        coverage_obligations, coverage_match, arbitration_queue, rewrite_ledger, export_summary, replacement_mapping, export_entries, must_links, identity_conflicts, maybe_links, subject_directory,
        directory_quality, subject_components, replacement_suffixes, replacement_serials, replacement_renumbered, first_replacement, entity_memory, replacement_conflicts, masked_by_subject,
        admission_gate, public_families, grouped_spans,
    )
}
OBLIGED = f"""l AS ({SQL_LINES}), c AS (SELECT *, CASE WHEN contains("text", '@') OR contains("text", '+1 (') THEN 1 WHEN contains("text", 'token =') OR contains("text", 'password') OR contains("text", 'key =') THEN 2
    WHEN contains("text", 'License') OR contains("text", 'rights reserved') THEN 3 WHEN container_type = 'table_row' THEN 4 ELSE 5 END AS f FROM l),
  o AS (SELECT doc_id, unit_id, (['contact_block', 'secret_block', 'licence_block', 'table_sensitive_column', 'boilerplate_low_value'])[f] AS category,
    (['contact_label', 'secret_label', 'licence_label', 'docx_table_unit_with_sensitive_shape', 'no_sensitive_structure_or_shape'])[f] AS reason,
    (['EMAIL_ADDRESS,PHONE', 'SECRET', '', 'ACCOUNT_NAME,ADDRESS,BANK_NAME,ORGANIZATION,PERSON', ''])[f] AS expected,
    (['phone_or_id_coverage', 'secret_coverage', 'licence_coverage', 'address_coverage,organization_coverage,person_coverage', ''])[f] AS ch,
    CASE WHEN f <= 3 THEN 'high' WHEN f = 4 OR NOT rewritable THEN 'medium' ELSE 'low' END AS priority, NOT rewritable AS rewrite_required FROM c)"""
CHECKS = "array_to_string(list_sort(list_filter(string_split(ch || CASE WHEN rewrite_required THEN ',rewrite_addressability' ELSE '' END, ','), lambda x: x <> '')), ',')"
KEPT = "(expected <> '' OR priority <> 'low')"
PLACED = f"""s AS ({sql_spans()}), u AS ({SQL_LINES}), j AS (SELECT s.*, u.unit_id, u."text" AS ut, u."start" AS us, u.rewritable, row_number() OVER (PARTITION BY s.doc_id, entity_type, s."start", s."end" ORDER BY u."end" - u."start", unit_id) AS rn
   FROM s LEFT JOIN u ON u.doc_id = s.doc_id AND u."start" <= s."start" AND s."end" <= u."end"), p AS (SELECT * FROM j WHERE rn = 1)"""
MATCHED = f"""{OBLIGED}, {PLACED}, w AS (SELECT unit_id, unnest(string_split(expected, ',')) AS kind FROM o WHERE {KEPT}), m AS (SELECT w.unit_id, count(*) AS matches FROM w JOIN p ON p.unit_id = w.unit_id AND p.entity_type = w.kind GROUP BY w.unit_id),
  st AS (SELECT o.unit_id, category, priority, coalesce(matches, 0) AS matches, CASE WHEN rewrite_required THEN 'unrewritable' WHEN matches > 0 THEN 'satisfied_by_rule' WHEN priority = 'low' THEN 'not_sensitive_by_rule' ELSE 'uncovered' END AS status FROM o LEFT JOIN m USING (unit_id) WHERE {KEPT})"""
ENTITIES = f"""{PLACED}, e AS (SELECT doc_id, unit_id, CASE WHEN entity_type = 'PHONE' THEN 'DATE' ELSE entity_type END AS entity_type, "start", "end", "text", ut, us, rewritable,
   CASE WHEN entity_type = 'IP_ADDRESS' THEN '' ELSE '[' || left(entity_type, 3) || left(md5("text"), 6) || ']' END AS replacement FROM p)"""
LEDGER = f"""{ENTITIES}, r0 AS (SELECT *, CASE WHEN replacement = '' THEN 'missing_replacement' WHEN entity_type IN ('DATE', 'AMOUNT') THEN 'non_rewrite_type' WHEN unit_id IS NULL THEN 'missing_unit' WHEN NOT rewritable THEN 'unrewritable_policy' END AS reason FROM e),
  z AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY "start", "end" DESC, entity_type) AS n FROM r0 WHERE reason IS NULL),
  v AS (SELECT *, max({{'e': "end", 'm': -n}}) OVER (PARTITION BY unit_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM z),
  held AS (SELECT unit_id, list(DISTINCT -top.m) AS holders FROM v WHERE "start" < top.e GROUP BY unit_id),
  r AS (SELECT v.* EXCLUDE (n, top, reason), CASE WHEN coalesce("start" < top.e, FALSE) OR coalesce(list_contains(holders, n), FALSE) THEN 'range_overlap' END AS reason FROM v LEFT JOIN held USING (unit_id)
        UNION ALL BY NAME SELECT * FROM r0 WHERE reason IS NOT NULL)"""
KEYED = f"""k AS (SELECT *, lower("text") AS key FROM ({SQL_MENTIONS}))"""
DIRECTORY = f"""{KEYED}, c AS (SELECT doc_id, entity_type, key, "text", count(*) AS n, min("start") AS first FROM k GROUP BY ALL),
  g AS (SELECT doc_id, entity_type, key, list("text" ORDER BY n DESC, length("text") DESC, "text")[1:8] AS surfaces, CAST(sum(n) AS BIGINT) AS mentions, min(first) AS first_start FROM c GROUP BY ALL),
  q AS (SELECT *, surfaces[1] AS canonical, CASE entity_type WHEN 'ORGANIZATION' THEN 1 WHEN 'PERSON' THEN 2 WHEN 'ALIAS' THEN 3 ELSE 6 END AS pr, CASE entity_type WHEN 'ORGANIZATION' THEN '公司' WHEN 'PERSON' THEN '人员' WHEN 'ALIAS' THEN '简称' ELSE '地址' END AS prefix FROM g),
  dir AS (SELECT *, 'CFD' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pr, first_start, mentions DESC, canonical, entity_type) AS VARCHAR), 5, '0') AS subject_id,
    prefix || row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY pr, first_start, mentions DESC, canonical, entity_type) AS replacement FROM q)"""
GROUPS = f"""g AS (SELECT doc_id, entity_type || ':' || "text" AS group_id, left("text", 1) AS base, entity_type AS scope, min("start") AS first_start FROM ({SQL_MENTIONS}) GROUP BY doc_id, entity_type, "text")"""
LETTERS = "CASE WHEN i < 26 THEN chr(CAST(65 + i AS INTEGER)) WHEN i < 702 THEN chr(CAST(64 + i // 26 AS INTEGER)) || chr(CAST(65 + i % 26 AS INTEGER)) ELSE chr(CAST(64 + (i // 26 - 1) // 26 AS INTEGER)) || chr(CAST(65 + (i // 26 - 1) % 26 AS INTEGER)) || chr(CAST(65 + i % 26 AS INTEGER)) END"
ORACLES = {
    "coverage_obligations": f"WITH {OBLIGED} SELECT unit_id, category, reason, expected, {CHECKS} AS checks, priority, rewrite_required FROM o WHERE {KEPT}",
    "coverage_match": f"WITH {MATCHED} SELECT unit_id, category, priority, matches, status FROM st",
    "arbitration_queue": f"""WITH {MATCHED}, {KEYED}, y AS (SELECT doc_id, key, entity_type FROM k GROUP BY ALL),
  q AS (SELECT status AS kind, unit_id AS key, CASE WHEN status = 'unrewritable' OR priority = 'high' THEN 'hard' ELSE 'medium' END AS severity FROM st WHERE status IN ('uncovered', 'unrewritable')
   UNION ALL SELECT 'type_conflict', a.doc_id || '|' || a.key || '|' || a.entity_type || '|' || b.entity_type, 'hard' FROM y a JOIN y b ON a.doc_id = b.doc_id AND a.key = b.key AND a.entity_type < b.entity_type)
  SELECT kind, severity, count(*) AS n, min(key) AS first FROM q GROUP BY ALL""",
    "rewrite_ledger": f"""WITH {LEDGER} SELECT doc_id, unit_id, entity_type, "start", "end", replacement, CASE WHEN reason IS NULL THEN 'ready' ELSE 'failed' END AS status, reason AS failure_reason FROM r""",
    "export_summary": f"""WITH {LEDGER}, sh AS (SELECT count(*) AS n FROM (SELECT replacement FROM r GROUP BY 1 HAVING count(DISTINCT "text") > 1)), sp AS (SELECT count(*) AS n FROM (SELECT entity_type, "text" FROM r GROUP BY ALL HAVING count(DISTINCT replacement) > 1))
  SELECT count(*) FILTER (WHERE reason IS NULL) AS ready, count(*) FILTER (WHERE reason IN ('range_overlap', 'unrewritable_policy')) AS blocking, any_value(sh.n) AS shared_replacements, any_value(sp.n) AS split_subjects,
   count(*) FILTER (WHERE reason IN ('range_overlap', 'unrewritable_policy')) = 0 AND any_value(sh.n) = 0 AND any_value(sp.n) = 0 AS export_ready FROM r, sh, sp""",
    "replacement_mapping": f"""WITH {ENTITIES}, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, entity_type, "text", replacement ORDER BY "start", "end") AS rnk FROM e)
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY "start", "end", entity_type) AS place, entity_type, "text", replacement FROM f WHERE rnk = 1""",
    "export_entries": f"""WITH {ENTITIES}, f AS (SELECT doc_id, "text", arg_min(replacement, {{'s': "start", 'e': "end"}}) AS replacement FROM e GROUP BY ALL)
  SELECT doc_id, "text", replacement, row_number() OVER (PARTITION BY doc_id ORDER BY length("text") DESC, "text") AS place FROM f""",
    "must_links": f"""WITH {KEYED}, f AS (SELECT candidate_id, first_value(candidate_id) OVER (PARTITION BY doc_id, entity_type, key ORDER BY "start", candidate_id) AS first FROM k) SELECT first AS left_id, candidate_id AS right_id FROM f WHERE first <> candidate_id""",
    "identity_conflicts": f"""WITH {KEYED}, y AS (SELECT doc_id, key, entity_type, count(*) AS n FROM k GROUP BY ALL)
  SELECT a.doc_id, a.key AS surface, a.entity_type AS left_type, a.n AS left_mentions, b.entity_type AS right_type, b.n AS right_mentions FROM y a JOIN y b ON a.doc_id = b.doc_id AND a.key = b.key AND a.entity_type < b.entity_type""",
    "maybe_links": f"""WITH {KEYED}, y AS (SELECT DISTINCT doc_id, key FROM k WHERE entity_type IN ('ORGANIZATION', 'ALIAS')) SELECT a.doc_id, a.key AS longer, b.key AS shorter FROM y a JOIN y b ON a.doc_id = b.doc_id AND length(a.key) > length(b.key) AND contains(a.key, b.key) WHERE length(a.key) >= 4""",
    "subject_directory": f"""WITH {DIRECTORY} SELECT doc_id, subject_id, entity_type, canonical, array_to_string(surfaces, '|') AS surfaces, mentions, first_start, replacement FROM dir""",
    "directory_quality": f"""WITH {KEYED} SELECT 'several_types' AS kind, "text" AS key, count(DISTINCT entity_type) AS n FROM k GROUP BY "text" HAVING count(DISTINCT entity_type) > 1 UNION ALL SELECT 'several_surfaces', key, count(DISTINCT "text") FROM k GROUP BY key HAVING count(DISTINCT "text") > 1""",
    "subject_components": f"""WITH RECURSIVE c AS MATERIALIZED (SELECT DISTINCT doc_id, "start" // 300 AS card, "text" AS surface FROM ({SQL_MENTIONS}) WHERE entity_type <> 'LOCATION'),
  e AS MATERIALIZED (SELECT DISTINCT a.doc_id, a.card AS a, b.card AS b FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.surface = b.surface), r AS (SELECT DISTINCT doc_id, card, card AS reach FROM c UNION SELECT r.doc_id, e.b, r.reach FROM r JOIN e ON e.doc_id = r.doc_id AND e.a = r.card)
  SELECT doc_id, CAST(card AS BIGINT) AS card, CAST(min(reach) AS BIGINT) AS subject FROM r GROUP BY doc_id, card""",
    "replacement_suffixes": f"""WITH {GROUPS}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY first_start, group_id) - 1 AS i, count(*) OVER (PARTITION BY doc_id, base) AS c FROM g) SELECT doc_id, group_id, base || CASE WHEN c > 1 THEN {LETTERS} ELSE '' END AS replacement FROM n""",
    "replacement_serials": f"""WITH {GROUPS}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, scope ORDER BY first_start, group_id) - 1 AS i FROM g) SELECT doc_id, group_id, {LETTERS} AS alias FROM n""",
    "first_replacement": f"""WITH {KEYED} SELECT doc_id, "start", key, '#' || min("start") OVER (PARTITION BY doc_id, key) AS replacement FROM k""",
    "entity_memory": f"""WITH {KEYED} SELECT doc_id, key AS group_id, array_to_string(list_sort(list_distinct(list("text"))), '|') AS variants, array_to_string(list_sort(list_distinct(list(source))), '|') AS sources, max(score) AS confidence, min("start") AS first_start, max("start") AS last_start,
   arg_max("text", {{'n': length("text"), 't': "text"}}) AS primary, count(*) AS mentions FROM k GROUP BY doc_id, key""",
    "replacement_conflicts": f"""WITH {KEYED}, x AS (SELECT *, entity_type || '-' || left("text", 2) AS rep FROM k) SELECT doc_id, 'several_per_group_id' AS kind, key, count(DISTINCT rep) AS n FROM x GROUP BY doc_id, key HAVING count(DISTINCT rep) > 1
   UNION ALL SELECT doc_id, 'several_per_text', "text", count(DISTINCT rep) FROM x GROUP BY doc_id, "text" HAVING count(DISTINCT rep) > 1""",
    "masked_by_subject": f"""WITH {DIRECTORY}, n AS (SELECT k.doc_id, list(k."start" ORDER BY k."start") AS st, list(k."end" ORDER BY k."start") AS en, list(dir.replacement ORDER BY k."start") AS rp FROM k JOIN dir ON dir.doc_id = k.doc_id AND dir.entity_type = k.entity_type AND dir.key = k.key GROUP BY k.doc_id)
  SELECT d.doc_id, CAST(coalesce(len(st), 0) AS INTEGER) AS n_rewritten, md5(CASE WHEN st IS NULL THEN text ELSE array_to_string(list_transform(generate_series(1, len(st)), lambda i: substr(text, CAST(coalesce(en[i - 1], 0) AS BIGINT) + 1, CAST(st[i] - coalesce(en[i - 1], 0) AS BIGINT)) || rp[i]), '') || substr(text, CAST(en[-1] AS BIGINT) + 1) END) AS masked_md5
  FROM documents d LEFT JOIN n USING (doc_id)""",
    "admission_gate": f"""WITH m AS (SELECT *, "text" IN ('The', 'Die', 'Les') OR "start" % 13 = 0 AS rej, "start" % 11 = 0 AS weak, length("text") > 12 AS failed, CASE source WHEN 'ner' THEN 'ner' ELSE 'regex' END AS layer FROM ({SQL_MENTIONS})),
  a AS (SELECT *, CASE WHEN rej THEN 'reject' WHEN failed OR weak THEN 'review' WHEN layer = 'regex' THEN 'keep' WHEN entity_type IN ('PERSON', 'ORGANIZATION', 'GOVERNMENT') AND length("text") <= 3 THEN 'review' ELSE 'keep' END AS action FROM m)
  SELECT entity_type, layer, action, CASE action WHEN 'reject' THEN 'high' WHEN 'review' THEN CASE WHEN failed THEN 'high' ELSE 'medium' END ELSE 'low' END AS risk, count(*) AS n, min("text") AS first FROM a GROUP BY ALL""",
    "public_families": f"""SELECT entity_type, CASE entity_type WHEN 'ALIAS' THEN 'ORGANIZATION' ELSE entity_type END AS family, count(*) AS n FROM ({SQL_MENTIONS}) GROUP BY ALL""",
    "grouped_spans": f"""WITH s AS ({sql_spans()}) SELECT doc_id, entity_type, "start" // 2000 AS "group", "start", "end", CAST("start" % 2000 AS INTEGER) AS local_start FROM s WHERE "start" // 2000 = ("end" - 1) // 2000""",
}

ORACLES["replacement_renumbered"] = f"""WITH {GROUPS}, n AS (SELECT doc_id, group_id AS subject_id, first_start, scope, CAST(row_number() OVER (PARTITION BY doc_id, scope, first_start // 1000 ORDER BY first_start, group_id) AS INTEGER) AS k FROM g),
  m AS (SELECT *, row_number() OVER (PARTITION BY doc_id, scope, k ORDER BY first_start, subject_id) = 1 AS keeps FROM n), u AS (SELECT doc_id, scope, list(k) AS used FROM m WHERE keeps GROUP BY ALL),
  o AS (SELECT m.doc_id, subject_id, m.scope, used, row_number() OVER (PARTITION BY m.doc_id, m.scope ORDER BY first_start, subject_id) AS i, count(*) OVER (PARTITION BY m.doc_id, m.scope) AS c FROM m JOIN u ON u.doc_id = m.doc_id AND u.scope = m.scope WHERE NOT keeps)
  SELECT doc_id, subject_id, scope || k AS replacement FROM m WHERE keeps UNION ALL SELECT doc_id, subject_id, scope || list_filter(generate_series(1, len(used) + c + list_max(used)), lambda x: NOT list_contains(used, x))[i] FROM o"""
