"""Evaluation of found entities and findings against gold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import text_score
from ..session import checkpointed
from .align import assign

ACCEPT = 0.82


def per_type(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Per type: expected, actual, hits (equal type, start and end), precision, recall and F1."""
    keys = ["doc_id", "entity_type", "start", "end"]
    e = expected.groupBy(*keys).agg(F.count("*").alias("e"))
    a = actual.groupBy(*keys).agg(F.count("*").alias("a"))
    both = e.join(a, keys, "full").fillna(0, ["e", "a"])
    sums = both.groupBy("entity_type").agg(F.sum("e").alias("expected"), F.sum("a").alias("actual"), F.sum(F.least("e", "a")).alias("hits"))
    p, r = F.col("hits") / F.nullif(F.col("actual"), F.lit(0)), F.col("hits") / F.nullif(F.col("expected"), F.lit(0))
    f1 = 2 * F.col("hits") / F.nullif(F.col("actual") + F.col("expected"), F.lit(0))
    return sums.select("*", F.coalesce(p, F.lit(0.0)).alias("precision"), F.coalesce(r, F.lit(0.0)).alias("recall"), F.coalesce(f1, F.lit(0.0)).alias("f1"))


def _take(left: DataFrame, right: DataFrame, on: object, error: str) -> DataFrame:
    pairs = left.join(right, on).select(F.col("e_id").alias("left_id"), F.col("a_id").alias("right_id"), F.lit(1.0).alias("score"))
    return assign(pairs).select(F.col("left_id").alias("e_id"), F.col("right_id").alias("a_id"), F.lit(error).alias("outcome"))


def entity_outcomes(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Each expected (id, doc_id, entity_type, text, start, end) and actual entity with its outcome, each side used once:
    exact; then type_error (the same span or text); then boundary_error (the same type, overlapping); the rest is missed
    or false_positive."""
    names = ("id", "doc_id", "entity_type", "text", "start", "end")
    e = checkpointed(expected.select(*[F.col(c).alias(f"e_{c}") for c in names]))
    a = checkpointed(actual.select(*[F.col(c).alias(f"a_{c}") for c in names]))
    same = F.col("e_doc_id") == F.col("a_doc_id")
    place = (F.col("e_start") == F.col("a_start")) & (F.col("e_end") == F.col("a_end"))
    kind, text = F.col("e_entity_type") == F.col("a_entity_type"), F.col("e_text") == F.col("a_text")
    lap = (F.col("e_start") < F.col("a_end")) & (F.col("a_start") < F.col("e_end"))
    found = None
    for error, on in (("exact", same & kind & place & text), ("type_error", same & ~kind & place), ("type_error", same & ~kind & text), ("boundary_error", same & kind & lap)):
        left = e if found is None else e.join(found.select("e_id"), "e_id", "left_anti")
        right = a if found is None else a.join(found.select("a_id"), "a_id", "left_anti")
        new = _take(left, right, on, error)
        found = checkpointed(new if found is None else found.unionByName(new))
    missed = e.join(found.select("e_id"), "e_id", "left_anti").select("e_id", F.lit(None).cast("string").alias("a_id"), F.lit("missed").alias("outcome"))
    false = a.join(found.select("a_id"), "a_id", "left_anti").select(F.lit(None).cast("string").alias("e_id"), "a_id", F.lit("false_positive").alias("outcome"))
    return found.unionByName(missed).unionByName(false)


def subject_errors(pairs: DataFrame) -> DataFrame:
    """Of matched entities (expected_subject, actual_subject): subjects that were split and ones that were merged."""
    split = pairs.groupBy(F.col("expected_subject").alias("subject")).agg(F.countDistinct("actual_subject").alias("n")).where("n > 1").select(F.lit("split").alias("kind"), "subject", "n")
    merged = pairs.groupBy(F.col("actual_subject").alias("subject")).agg(F.countDistinct("expected_subject").alias("n")).where("n > 1").select(F.lit("merged").alias("kind"), "subject", "n")
    return split.unionByName(merged)


def gold_matches(expected: DataFrame, findings: DataFrame) -> DataFrame:
    """Expected errors and findings of one page (sample_id, page_no, old_text, new_text), each used once, by
    .45 x old + .55 x new text scores of at least ACCEPT."""
    e = expected.select("sample_id", "page_no", F.col("id").alias("left_id"), F.col("old_text").alias("e_old"), F.col("new_text").alias("e_new"))
    f = findings.select("sample_id", "page_no", F.col("id").alias("right_id"), F.col("old_text").alias("f_old"), F.col("new_text").alias("f_new"))
    s = 0.45 * text_score(F.col("e_old"), F.col("f_old")) + 0.55 * text_score(F.col("e_new"), F.col("f_new"))
    pairs = e.join(f, ["sample_id", "page_no"]).select("left_id", "right_id", s.alias("score")).where(F.col("score") >= ACCEPT)
    return assign(pairs).drop("status")


def suite(samples: DataFrame) -> DataFrame:
    """Per sample and in total (sample null): recall, share of false findings, coverage; micro averages, by a rollup."""
    sums = samples.rollup("sample").agg(*[F.sum(c).alias(c) for c in ("expected", "found", "findings", "pages", "covered")])
    ratio = lambda a, b, empty: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(empty))
    return sums.select("sample", "expected", "found", "findings", ratio("found", "expected", 1.0).alias("recall"), (1 - ratio("found", "findings", 1.0)).alias("false_rate"), ratio("covered", "pages", 1.0).alias("coverage"))


def artifact_checks(artifacts: DataFrame, checks: dict[str, object]) -> DataFrame:
    """One row for each named check of each artifact: check, passed."""
    each = F.stack(F.lit(len(checks)), *[x for name, test in checks.items() for x in (F.lit(name), test)])
    return artifacts.select("artifact_id", each.alias("check", "passed"))


def best_first(rows: DataFrame, keys: list[str], order: list[object]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
