"""Queries of coverage, closers, typed fields and table grids: lines of documents as units, order lines as table cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align, closing, grids
from .common import SQL_LINES, lines, spans, sql_spans, table

HEAD = 12


def _units(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines of documents of odd ids as units of a page each, the first as headers; and those of even ids."""
    every = lines(spark, sf_dir).withColumn("k", F.regexp_replace("text", r"\s+", "")).withColumn("page_no", F.col("doc_id").cast("int"))
    every = every.withColumn("container_type", F.when(F.col("order_index") == 0, "header").otherwise(F.col("container_type")))
    return every.where("doc_id % 2 = 1"), every.where("doc_id % 2 = 0")


def _evidence(units: DataFrame, others: DataFrame) -> list[DataFrame]:
    """Links to equal lines and to lines that begin alike, differences where an address stands, and what pages hold: every third
    line of its page and every fifth of the page before the last."""
    by = lambda df, key: df.groupBy(key.alias("key")).agg(F.min("unit_id").alias("link_id"))
    head, long_ = F.left("k", F.lit(HEAD)), F.length("k") >= HEAD
    equal = units.join(by(others, F.col("k")), F.col("k") == F.col("key")).select("unit_id", "link_id", F.lit(1.0).alias("score"), F.lit("matched").alias("status"))
    alike = units.where(long_).join(by(others.where(long_), head), head == F.col("key")).select("unit_id", "link_id", F.lit(0.6).alias("score"), F.lit("mapping_uncertain").alias("status"))
    diffs = closing.evidence(units.where(F.contains("text", F.lit("@"))), "diff", F.lit(0.76))
    return [closing.link_evidence(equal), closing.link_evidence(alike), diffs, closing.page_text_evidence(_found(units))]


def _found(units: DataFrame) -> DataFrame:
    near = F.array(F.when(F.col("order_index") % 3 == 0, F.col("page_no")), F.when(F.col("order_index") % 5 == 0, F.col("page_no") + 2))
    held = units.select(F.explode(near).alias("page_no"), "unit_id", "text").where("page_no is not null")
    pages = held.groupBy("page_no").agg(F.array_sort(F.collect_list(F.struct("unit_id", "text"))).alias("l")).select("page_no", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("page_text"))
    return align.nearby(units.select("unit_id", "page_no", "text", (F.col("container_type") == "table_row").alias("cell")), pages)


def _closers(units: DataFrame) -> list[DataFrame]:
    reviewed = lambda n, most, kind, sure: closing.evidence(units.where((F.col("doc_id") % n == 1) & (F.col("order_index") < most)), kind, F.lit(sure), F.col("doc_id"))
    return [closing.table_evidence(_found(units).join(units.where("container_type = 'table_row'").select("unit_id"), "unit_id", "left_semi")), reviewed(7, 3, "page_text_review", 0.7), reviewed(11, 5, "image_text_review", 0.8)]


def _closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    units, others = _units(spark, sf_dir)
    return closing.ledger(units, *_evidence(units, others), *_closers(units))


def coverage_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    units, others = _units(spark, sf_dir)
    return closing.ledger(units, *_evidence(units, others)).drop("closed_from")


def table_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _closed(spark, sf_dir).where("closed_from is not null and by like 'table%'").select("unit_id", "page_no", "status", "confidence", "detail", "closed_from")


def page_review_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _closed(spark, sf_dir).where("closed_from is not null and by like '%review'").select("unit_id", "page_no", "status", "confidence", "detail", "closed_from")


def closure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closing.closure_summary(_closed(spark, sf_dir))


def coverage_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line read again by two readers, of which one sees only so many characters as its place."""
    units, others = _units(spark, sf_dir)
    states = closing.ledger(units, *_evidence(units, others))
    read = units.select("unit_id", F.left("text", F.col("order_index")).alias("read_text"), F.lit(0.5).alias("confidence")).unionByName(units.where("order_index % 4 = 0").select("unit_id", F.left("text", F.lit(9)).alias("read_text"), F.lit(0.4).alias("confidence")))
    return closing.backfill_targets(states, read)


def _fields(spark: SparkSession, sf_dir: str, units: DataFrame) -> DataFrame:
    found = spans(spark, sf_dir).join(units.select("doc_id", "unit_id", F.col("start").alias("u"), F.col("end").alias("e")), "doc_id").where("start >= u and end <= e")
    return closing.typed_fields(units, found.select("unit_id", "entity_type", (F.col("start") - F.col("u")).alias("start"), (F.col("end") - F.col("u")).alias("end"), "text"))


def typed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(spark, sf_dir, lines(spark, sf_dir))


def recall_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of lines of odd ids that have no equal line among even ids, looked for on the pages of up to 400 ids around."""
    units, others = _units(spark, sf_dir)
    theirs = _fields(spark, sf_dir, others).join(others.select("unit_id", "page_no"), "unit_id").withColumnRenamed("unit_id", "other_id")
    settled = units.join(others.select("k").distinct(), "k", "left_semi")
    return closing.recall_guard(units, _fields(spark, sf_dir, units), theirs, settled, 400)


#: One text for both engines: order lines as four cells each; what a column of amounts lost, and what is known of it.
CELLS = """SELECT page_no, table_index, row_index, col_index, concat(page_no, ':', row_index, ':', col_index) AS unit_id,
 CASE col_index WHEN 1 THEN CASE WHEN part % 13 = 0 THEN concat('1', replace(replace(quantity, '0', 'O'), '1', 'I'), '5') ELSE quantity END
  WHEN 2 THEN CASE WHEN lost THEN CAST(cents AS STRING) ELSE concat(CAST(floor(cents / 100) AS BIGINT), '.', lpad(CAST(cents % 100 AS STRING), 2, '0')) END WHEN 3 THEN day ELSE CASE WHEN part % 5 = 0 THEN ' ' ELSE flag END END AS text,
 quarter <> col_index AS covered, CASE WHEN col_index = 2 AND lost AND row_index <= 3 THEN CASE WHEN part % 4 = 0 THEN 'confirmed_error' ELSE 'suspected_error' END END AS decision,
 CASE WHEN col_index = 2 AND lost AND row_index <= 3 THEN 'decimal_point_missing' END AS issue_type, CASE WHEN col_index = 2 AND lost AND row_index <= 3 THEN CAST(0.8 AS DOUBLE) END AS cell_confidence
FROM (SELECT CAST(l_orderkey AS BIGINT) AS page_no, 1 AS table_index, CAST(l_linenumber AS INT) AS row_index, l_partkey AS part, CAST(CAST(l_quantity AS BIGINT) AS STRING) AS quantity, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
  l_suppkey % 3 = 0 AS lost, substring(CAST(l_shipdate AS STRING), 1, 10) AS day, l_returnflag AS flag, CAST(l_suppkey % 9 AS INT) AS quarter, COLUMNS_OF_ROW FROM lineitem)"""
SQL_CELLS = CELLS.replace("AS STRING", "AS VARCHAR").replace("COLUMNS_OF_ROW", "unnest([1, 2, 3, 4]) AS col_index")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CELLS.replace("COLUMNS_OF_ROW", "explode(array(1, 2, 3, 4)) AS col_index").replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))


def grid_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.column_profiles(_cells(spark, sf_dir))


def grid_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    return grids.anomalies(cells, grids.column_profiles(cells))


def table_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    return grids.grids(cells, grids.anomalies(cells, grids.column_profiles(cells)))


QUERIES = {f.__name__: f for f in (coverage_ledger, table_closure, page_review_closure, closure_summary, coverage_backfill, typed_fields, recall_guard, grid_columns, grid_anomalies, table_grids)}

_UNITS = rf"""l AS (SELECT * REPLACE (CASE WHEN order_index = 0 THEN 'header' ELSE container_type END AS container_type), regexp_replace("text", '\s+', '', 'g') AS k, CAST(doc_id AS INTEGER) AS page_no FROM ({SQL_LINES})),
u AS (SELECT * FROM l WHERE doc_id % 2 = 1), e AS (SELECT * FROM l WHERE doc_id % 2 = 0)"""
_STATES = f"""{_UNITS},
m AS (SELECT u.unit_id, min(e.unit_id) AS link FROM u JOIN e ON e.k = u.k GROUP BY 1),
h AS (SELECT u.unit_id, min(e.unit_id) AS link FROM u JOIN e ON left(e.k, {HEAD}) = left(u.k, {HEAD}) AND length(e.k) >= {HEAD} AND length(u.k) >= {HEAD} GROUP BY 1),
pg AS (SELECT page_no, string_agg("text", chr(10) ORDER BY unit_id) AS page_text FROM (SELECT page_no, unit_id, "text" FROM u WHERE order_index % 3 = 0 UNION ALL SELECT page_no + 2, unit_id, "text" FROM u WHERE order_index % 5 = 0) GROUP BY 1),
f AS (SELECT unit_id, p.page_no AS found, abs(p.page_no - u.page_no) AS far, CASE WHEN p.page_no <> u.page_no THEN 0.68 WHEN container_type = 'table_row' THEN 0.74 ELSE 0.78 END AS sure
      FROM u JOIN pg p ON p.page_no BETWEEN u.page_no - 3 AND u.page_no + 3 AND (p.page_no = u.page_no OR container_type = 'table_row') AND contains(page_text, u."text") QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY far, found) = 1),
s AS (SELECT u.unit_id, u.page_no, u.doc_id, order_index, u."text", container_type, contains(u."text", '@') AS odd, f.far, f.found, f.sure AS page_sure,
  CASE WHEN m.link IS NOT NULL THEN 'covered' WHEN contains(u."text", '@') THEN 'diff_candidate' WHEN h.link IS NOT NULL THEN 'mapping_uncertain' WHEN far = 0 THEN 'covered_by_page_ocr' WHEN far > 0 THEN 'covered_by_nearby_page_ocr'
   WHEN container_type = 'table_row' THEN 'table_pending' WHEN container_type = 'header' THEN 'low_priority_uncovered' ELSE 'uncovered_docx_content' END AS status,
  CAST(CASE WHEN m.link IS NOT NULL THEN 1.0 WHEN contains(u."text", '@') THEN 0.76 WHEN h.link IS NOT NULL THEN 0.6 WHEN far IS NOT NULL THEN f.sure WHEN container_type = 'table_row' THEN 0.54 WHEN container_type = 'header' THEN 0.46 ELSE 0.56 END AS DOUBLE) AS confidence,
  CASE WHEN m.link IS NOT NULL THEN 'matched' WHEN contains(u."text", '@') THEN 'diff' WHEN h.link IS NOT NULL THEN 'mapping_uncertain' WHEN far = 0 THEN 'page_text' WHEN far > 0 THEN 'nearby_page_text' END AS by_,
  CASE WHEN m.link IS NOT NULL THEN m.link WHEN contains(u."text", '@') THEN NULL WHEN h.link IS NOT NULL THEN h.link WHEN far IS NOT NULL THEN CAST(found AS VARCHAR) END AS detail,
  CAST((m.link IS NOT NULL)::INT + contains(u."text", '@')::INT + (h.link IS NOT NULL)::INT + (far IS NOT NULL)::INT AS BIGINT) AS n_evidence
  FROM u LEFT JOIN m USING (unit_id) LEFT JOIN h USING (unit_id) LEFT JOIN f USING (unit_id)),
z AS (SELECT *, CASE WHEN status LIKE 'covered%' THEN NULL WHEN container_type = 'table_row' AND far IS NOT NULL AND NOT odd AND status IN ('mapping_uncertain', 'table_pending', 'uncovered_docx_content') THEN CASE WHEN far = 0 THEN 'table_same_page' ELSE 'table_nearby_page' END
   WHEN doc_id % 7 = 1 AND order_index < 3 THEN 'page_text_review' WHEN doc_id % 11 = 1 AND order_index < 5 THEN 'image_text_review' END AS closer FROM s),
c AS (SELECT unit_id, page_no, closer AS by_, status AS closed_from, CASE closer WHEN 'table_same_page' THEN 'covered_by_table_page_text_support' WHEN 'table_nearby_page' THEN 'covered_by_nearby_table_page_text_support' WHEN 'page_text_review' THEN 'resolved_by_page_text_qwen_no_issue' ELSE 'resolved_by_image_text_vl_no_issue' END AS status,
  CAST(greatest(confidence, CASE closer WHEN 'table_same_page' THEN greatest(0.76, page_sure) WHEN 'table_nearby_page' THEN greatest(0.70, page_sure) WHEN 'page_text_review' THEN 0.72 ELSE 0.8 END) AS DOUBLE) AS confidence,
  CASE WHEN closer LIKE 'table%' THEN CAST(found AS VARCHAR) ELSE CAST(doc_id AS VARCHAR) END AS detail FROM z WHERE closer IS NOT NULL)"""
_FIELDS = rf"""fs AS (SELECT l.unit_id, l.page_no, s.entity_type AS field_type, lower(regexp_replace(s."text", '\s+', '', 'g')) AS "value", s."start" - l."start" AS "start",
  coalesce(nullif(right(regexp_replace(regexp_replace(substr(l."text", greatest(s."start" - l."start" - 18, 0) + 1, least(s."start" - l."start", 18)), '\s+', '', 'g'), '^[,，。；;:：、]+', ''), 16), ''), 'same_aligned_unit') AS role
  FROM ({sql_spans()}) s JOIN l ON l.doc_id = s.doc_id AND s."start" >= l."start" AND s."end" <= l."end")"""
_GRID = f"""c AS ({SQL_CELLS}), n AS (SELECT *, regexp_replace(text, '\\s+', '', 'g') AS bare FROM c),
t AS (SELECT *, CASE WHEN bare = '' THEN 'empty' WHEN regexp_matches(bare, '[0-9]{{4}}[./-][0-9]{{1,2}}') THEN 'date' WHEN regexp_full_match(replace(bare, ',', ''), '[0-9]+(\\.[0-9]+)?') THEN CASE WHEN contains(bare, '.') THEN 'decimal_number' ELSE 'integer_number' END
  WHEN length(bare) >= 3 AND regexp_matches(bare, '[0-9]') AND regexp_matches(upper(bare), '[BDEGILOQSZ]') THEN 'confusable_numeric' WHEN regexp_matches(bare, '[0-9]') THEN 'numeric_text' ELSE 'text' END AS kind FROM n),
k AS (SELECT page_no, table_index, col_index, kind, count(*) AS n, min({{'r': row_index, 'u': unit_id}}) AS first FROM t WHERE kind <> 'empty' GROUP BY ALL),
d AS (SELECT page_no, table_index, col_index, kind FROM k QUALIFY row_number() OVER (PARTITION BY page_no, table_index, col_index ORDER BY n DESC, first, kind) = 1),
p AS (SELECT t.page_no, t.table_index, t.col_index, count(*) AS cells, count(*) FILTER (WHERE t.kind <> 'empty') AS nonempty, coalesce(any_value(d.kind), 'empty') AS dominant_type, count(*) FILTER (WHERE NOT covered) AS "open", count(decision) AS evidence,
  count(*) FILTER (WHERE decision = 'confirmed_error') AS confirmed, count(*) FILTER (WHERE decision = 'suspected_error') AS suspected, count(*) FILTER (WHERE issue_type = 'decimal_point_missing') AS decimal
  FROM t LEFT JOIN d USING (page_no, table_index, col_index) GROUP BY ALL),
a AS (SELECT t.page_no, t.table_index, t.row_index, t.col_index, t.unit_id, CASE WHEN decision IS NOT NULL THEN issue_type WHEN t.kind = 'confusable_numeric' THEN 'confusable_numeric_text' WHEN p.decimal >= 2 AND regexp_full_match(bare, '[0-9]{{4,8}}') THEN 'column_decimal_missing_candidate' END AS anomaly,
  coalesce(decision, 'suspected_error') AS decision, CASE WHEN decision IS NOT NULL THEN cell_confidence WHEN t.kind = 'confusable_numeric' THEN CAST(0.55 AS DOUBLE) ELSE CAST(0.54 AS DOUBLE) END AS confidence FROM t JOIN p USING (page_no, table_index, col_index) WHERE anomaly IS NOT NULL)"""
ORACLES = {
    "coverage_ledger": f"""WITH {_STATES} SELECT unit_id, page_no, container_type, status, status LIKE 'covered%' AS covered, confidence, by_ AS "by", detail, n_evidence FROM s""",
    "table_closure": f"""WITH {_STATES} SELECT unit_id, page_no, status, confidence, detail, closed_from FROM c WHERE by_ LIKE 'table%'""",
    "page_review_closure": f"""WITH {_STATES} SELECT unit_id, page_no, status, confidence, detail, closed_from FROM c WHERE by_ LIKE '%review'""",
    "closure_summary": f"""WITH {_STATES} SELECT by_ AS "by", closed_from, count(*) AS n, count(DISTINCT page_no) AS pages FROM c GROUP BY ALL""",
    "coverage_backfill": f"""WITH {_STATES}, rd AS (SELECT unit_id, left("text", order_index) AS t, 0.5 AS sure FROM u UNION ALL SELECT unit_id, left("text", 9), 0.4 FROM u WHERE order_index % 4 = 0),
  b AS (SELECT *, length(regexp_replace(t, '\\s+', '', 'g')) >= {closing.LEAST_BACKFILL} AS ok FROM rd QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY ok DESC, sure DESC, t DESC) = 1)
  SELECT s.unit_id, s.page_no, s.status, CASE WHEN ok THEN 'readable' ELSE 'unreadable' END AS readability, t AS read_text, CAST(sure AS DOUBLE) AS confidence FROM s JOIN b USING (unit_id) WHERE NOT s.status LIKE 'covered%'""",
    "typed_fields": f"""WITH {_UNITS}, {_FIELDS} SELECT unit_id, field_type, "value", role, "start" FROM fs""",
    "recall_guard": f"""WITH {_UNITS}, {_FIELDS}, o AS (SELECT f.* FROM fs f JOIN u USING (unit_id) WHERE u.k NOT IN (SELECT k FROM e)), r AS (SELECT f.unit_id AS other_id, f.page_no AS other_page, field_type, "value" FROM fs f JOIN e USING (unit_id)),
  j AS (SELECT o.*, r.other_id, r.other_page, row_number() OVER (PARTITION BY o.unit_id ORDER BY r.other_id IS NULL, o."start", o.field_type, o."value", abs(r.other_page - o.page_no), r.other_page, r.other_id) AS n
        FROM o LEFT JOIN r ON r.field_type = o.field_type AND r."value" = o."value" AND abs(r.other_page - o.page_no) <= 400), q AS (SELECT unit_id, count(*) AS n_fields FROM o GROUP BY 1)
  SELECT unit_id, page_no, field_type, "value", role, other_id, other_page, n_fields, CASE WHEN other_id IS NULL THEN 'recall_pdf_field_not_matched' ELSE 'recall_matched_pdf_field' END AS flag FROM j JOIN q USING (unit_id) WHERE n = 1""",
    "grid_columns": f"""WITH {_GRID} SELECT * FROM p""",
    "grid_anomalies": f"""WITH {_GRID} SELECT * FROM a""",
    "table_grids": f"""WITH {_GRID}, g AS (SELECT page_no, table_index, max(row_index) AS "rows", max(col_index) AS "columns", count(*) AS cells, count(*) FILTER (WHERE kind <> 'empty') AS nonempty, count(*) FILTER (WHERE NOT covered) AS unresolved FROM t GROUP BY ALL),
  b AS (SELECT page_no, table_index, count(*) AS anomalies, count(*) FILTER (WHERE decision = 'confirmed_error') AS confirmed FROM a GROUP BY ALL)
  SELECT g.*, coalesce(anomalies, 0) AS anomalies, coalesce(confirmed, 0) AS confirmed, CASE WHEN confirmed > 0 THEN 'grid_with_confirmed_errors' WHEN anomalies > 0 THEN 'grid_with_suspected_anomalies' WHEN unresolved > 0 THEN 'grid_pending_review' ELSE 'grid_covered_or_low_risk' END AS status FROM g LEFT JOIN b USING (page_no, table_index)""",
}
