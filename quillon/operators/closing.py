"""Coverage of units by evidence of several kinds, and the closers that settle what is left.

Each kind of evidence is a set of rows (unit_id, kind, confidence, detail). All meet in one union and one aggregation: a
unit's state is that of its strongest evidence, and closers apply to states that are still open, unless something
blocks them. No kind joins another.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of a unit by their evidence, the strongest first, and whether they cover it.
STATES = (
    ("matched", "covered", True), ("diff", "diff_candidate", False), ("mapping_uncertain", "mapping_uncertain", False),
    ("page_text", "covered_by_page_ocr", True), ("nearby_page_text", "covered_by_nearby_page_ocr", True),
)
#: States of units without evidence, by container; confidences; states that the table closer looks at.
WITHOUT = (("table_cell", "table_pending", 0.54), ("table_row", "table_pending", 0.54), ("header", "low_priority_uncovered", 0.46), ("footer", "low_priority_uncovered", 0.46), ("footnote", "low_priority_uncovered", 0.46), ("endnote", "low_priority_uncovered", 0.46))
OTHERWISE = ("uncovered_docx_content", 0.56)
TABLE_TARGETS = ("mapping_uncertain", "table_pending", "uncovered_docx_content")
#: Closers, the first that applies, with the least confidence and the state they give.
CLOSERS = (
    ("table_same_page", "covered_by_table_page_text_support", 0.76), ("table_nearby_page", "covered_by_nearby_table_page_text_support", 0.70),
    ("page_text_review", "resolved_by_page_text_qwen_no_issue", 0.72), ("image_text_review", "resolved_by_image_text_vl_no_issue", 0.74),
)
#: Confidences of a text found on the unit's page, and on one near it.
FOUND, FOUND_IN_CELL, FOUND_NEAR = 0.78, 0.74, 0.68
LEAST_BACKFILL = 4


def evidence(rows: DataFrame, kind: str, confidence: Column, detail: Column | None = None) -> DataFrame:
    return rows.select("unit_id", F.lit(kind).alias("kind"), confidence.cast("double").alias("confidence"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))


def link_evidence(links: DataFrame) -> DataFrame:
    """links (unit_id, link_id, score, status): matched or mapping_uncertain."""
    return links.select("unit_id", F.col("status").alias("kind"), F.col("score").cast("double").alias("confidence"), F.col("link_id").cast("string").alias("detail"))


def page_text_evidence(found: DataFrame) -> DataFrame:
    """found (unit_id, found_page, distance, confidence) of units whose text a page holds."""
    kind = F.when(F.col("distance") == 0, "page_text").otherwise("nearby_page_text")
    return found.select("unit_id", kind.alias("kind"), F.col("confidence").cast("double").alias("confidence"), F.col("found_page").cast("string").alias("detail"))


def table_evidence(found: DataFrame) -> DataFrame:
    """The same for cells, as the table closer takes it."""
    kind = F.when(F.col("distance") == 0, "table_same_page").otherwise("table_nearby_page")
    return found.select("unit_id", kind.alias("kind"), F.col("confidence").cast("double").alias("confidence"), F.col("found_page").cast("string").alias("detail"))


def _by_kind(values: dict[str, object], kind: Column, kind_of: str) -> Column:
    out = F.lit(None).cast(kind_of)
    for name, value in values.items():
        out = F.when(kind == name, F.lit(value)).otherwise(out)
    return out


def ledger(units: DataFrame, *found: DataFrame) -> DataFrame:
    """units (unit_id, page_no, container_type) with status, covered, confidence, by (the kind of evidence that decided),
    detail, n_evidence and closed_from (the state that a closer found). Evidence of unknown units is left out."""
    kinds = {kind: i for i, (kind, _, _) in enumerate(STATES)}
    closers = {kind: i for i, (kind, _, _) in enumerate(CLOSERS)}
    own = units.select("unit_id", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("detail"), "page_no", "container_type")
    rest = reduce(DataFrame.unionByName, found).select("*", F.lit(None).cast(dict(units.dtypes)["page_no"]).alias("page_no"), F.lit(None).cast("string").alias("container_type"))
    every = own.withColumn("is_unit", F.lit(True)).unionByName(rest.withColumn("is_unit", F.lit(False)))
    place, last = _by_kind(kinds, F.col("kind"), "int"), _by_kind(closers, F.col("kind"), "int")
    # of one kind the higher confidence, then the smaller detail
    pick = lambda at: F.min(F.when(at.isNotNull(), F.struct(at.alias("at"), (-F.col("confidence")).alias("c"), "detail", "kind")))
    met = every.groupBy("unit_id").agg(
        F.max("is_unit").alias("is_unit"), F.max("page_no").alias("page_no"), F.max("container_type").alias("container_type"), F.count("kind").alias("n_evidence"),
        pick(place).alias("best"), pick(last).alias("closer"), F.max((F.coalesce(F.col("kind").isin("diff", "anomaly"), F.lit(False))).cast("int")).alias("blocked"),
        pick(F.when(last >= 2, last)).alias("reviewed"),
    ).where("is_unit")
    cell = F.col("container_type").isin("table_cell", "table_row")
    bare = lambda i: reduce(lambda c, w: F.when(F.col("container_type") == w[0], F.lit(w[i])).otherwise(c), WITHOUT, F.lit(OTHERWISE[i - 1]))
    states = met.withColumn("state", F.coalesce(_by_kind({k: s for k, s, _ in STATES}, F.col("best.kind"), "string"), bare(1)))
    states = states.withColumn("sure", F.coalesce(_by_kind({k: c for k, _, c in STATES}, F.col("best.kind"), "boolean"), F.lit(False)))
    states = states.withColumn("was", F.coalesce(-F.col("best.c"), bare(2)))
    of_table = (F.col("closer.at") < 2) & cell & F.col("state").isin(*TABLE_TARGETS) & (F.col("blocked") == 0)
    closer = F.when(~F.col("sure"), F.when(of_table, F.col("closer")).otherwise(F.col("reviewed")))
    states = states.withColumn("close", closer).withColumn("closes", F.col("close").isNotNull())
    least = _by_kind({k: c for k, _, c in CLOSERS}, F.col("close.kind"), "double")
    return states.select(
        "unit_id", "page_no", "container_type", F.when(F.col("closes"), _by_kind({k: s for k, s, _ in CLOSERS}, F.col("close.kind"), "string")).otherwise(F.col("state")).alias("status"),
        (F.col("sure") | F.col("closes")).alias("covered"), F.when(F.col("closes"), F.greatest("was", -F.col("close.c"), least)).otherwise(F.col("was")).alias("confidence"),
        F.coalesce("close.kind", "best.kind").alias("by"), F.coalesce("close.detail", "best.detail").alias("detail"), "n_evidence", F.when(F.col("closes"), F.col("state")).alias("closed_from"),
    )


def backfill_targets(states: DataFrame, texts: DataFrame) -> DataFrame:
    """Open units with a text that was read for them elsewhere (unit_id, read_text, confidence): readable from LEAST_BACKFILL characters
    on, else unreadable. It is evidence for reviewers and changes no state."""
    readable = F.length(F.regexp_replace(F.coalesce("read_text", F.lit("")), r"\s+", "")) >= LEAST_BACKFILL
    best = texts.groupBy("unit_id").agg(F.max(F.struct(readable.alias("readable"), "confidence", "read_text")).alias("t"))
    open_ = states.where("not covered").select("unit_id", "page_no", "status")
    return open_.join(best, "unit_id").select("unit_id", "page_no", "status", F.when(F.col("t.readable"), "readable").otherwise("unreadable").alias("readability"), "t.read_text", "t.confidence")


def closure_summary(states: DataFrame) -> DataFrame:
    """Per closer and state it found: units and pages."""
    return states.where("closed_from is not null").groupBy("by", "closed_from").agg(F.count("*").alias("n"), F.countDistinct("page_no").alias("pages"))


def typed_fields(units: DataFrame, spans: DataFrame, width: int = 18, kept: int = 16) -> DataFrame:
    """spans (unit_id, entity_type, start, end, text: places in the unit's text) with value and role: what stands before, at most
    ``kept`` characters of the ``width`` before it without white space, or same_aligned_unit."""
    text = units.select("unit_id", F.col("text").alias("__unit"))
    before = F.substr("__unit", F.greatest(F.col("start") - width, F.lit(0)) + 1, F.least(F.col("start"), F.lit(width)))
    bare = F.regexp_replace(F.regexp_replace(before, r"\s+", ""), "^[,，。；;:：、]+", "")
    role = F.coalesce(F.nullif(F.right(bare, F.lit(kept)), F.lit("")), F.lit("same_aligned_unit"))
    joined = spans.join(text, "unit_id")
    return joined.select("unit_id", F.col("entity_type").alias("field_type"), F.lower(F.regexp_replace("text", r"\s+", "")).alias("value"), role.alias("role"), "start")


def recall_guard(units: DataFrame, fields: DataFrame, others: DataFrame, settled: DataFrame, band: int = 0) -> DataFrame:
    """Units (unit_id, page_no) with typed fields that no link or difference settled (unit_id): the first field, in order of place, whose
    (type, value) a unit of others (other_id, page_no, field_type, value) has on a page within the band, with the first
    such unit of the nearest page; else its first field, unmatched."""
    open_ = units.select("unit_id", "page_no").join(settled.select("unit_id").distinct(), "unit_id", "left_anti").join(fields, "unit_id")
    spread = others.select("other_id", F.col("page_no").alias("other_page"), "field_type", "value", F.explode(F.sequence(F.col("page_no") - band, F.col("page_no") + band)).alias("page_no"))
    best = spread.groupBy("page_no", "field_type", "value").agg(F.min(F.struct(F.abs(F.col("other_page") - F.col("page_no")).alias("far"), "other_page", "other_id")).alias("hit"))
    seen = open_.join(best, ["page_no", "field_type", "value"], "left")
    first = F.struct(F.col("hit").isNull().alias("missing"), "start", "field_type", "value", "role", F.col("hit.other_id").alias("other_id"), F.col("hit.other_page").alias("other_page"))
    picked = seen.groupBy("unit_id", "page_no").agg(F.min(first).alias("f"), F.count("*").alias("n_fields"))
    return picked.select("unit_id", "page_no", "f.field_type", "f.value", "f.role", "f.other_id", "f.other_page", "n_fields", F.when(F.col("f.missing"), "recall_pdf_field_not_matched").otherwise("recall_matched_pdf_field").alias("flag"))
