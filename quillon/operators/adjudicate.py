"""Decisions on a ledger of subjects: merges, splits and rejections, applied as a map of ids.

Decisions are a log. The last one on an edge stands, so that a later split undoes a merge; of a subject's merges the last
one stands. What a subject finally is follows from jumping along the map, twice as far each round. A circle of merges is
one subject, the smallest of its ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

#: What an action makes of an edge, and of an occurrence.
EDGE_STATUS = {"merge_to_canonical": "adjudicated_merge", "keep_separate": "adjudicated_keep_separate", "confirm": "adjudicated_confirm_source", "reject": "adjudicated_reject_source"}
OCCURRENCE_STATUS = {"confirm": "confirmed_subject", "keep_separate": "confirmed_separate_subject", "reject": "rejected_subject", "manual_review": "manual_review_required"}
MERGE = "merge_to_canonical"


def standing(decisions: DataFrame, by: str) -> DataFrame:
    """The last decision (by seq) on each edge or occurrence."""
    fields = [c for c in decisions.columns if c != by]
    return decisions.where(F.col(by).isNotNull()).groupBy(by).agg(F.max_by(F.struct(*fields), "seq").alias("d")).select(by, *[F.col(f"d.{c}").alias(c) for c in fields])


def _jumped(steps: DataFrame) -> DataFrame:
    """steps (source, target) as source, at and least: a place as far as they lead, and the smallest id on the way there. What
    leads into a circle ends somewhere in it, what stands in one has gone all around.

    Circles never end. A round that leaves as many sources under way, at as many places, as the one before has only such
    left as lead into circles, all of them there by now (what ends does so at every distance below the longest); one that
    finds no smaller id either has gone around. So rounds follow the longest way, not the number of steps.
    """
    now = checkpointed(steps.select("source", F.col("target").alias("at"), F.col("target").alias("least")))
    before = None
    while True:
        ahead = now.select(F.col("source").alias("at"), F.col("at").alias("further"), F.col("least").alias("lower"))
        joined = checkpointed(now.join(ahead, "at", "left"))
        under_way, places, smaller = joined.where("further is not null").agg(F.count("*"), F.countDistinct("at"), F.count_if(F.col("lower") < F.col("least"))).first()
        if not under_way or ((under_way, places) == before and not smaller):
            return now
        now, before = joined.select("source", F.coalesce("further", "at").alias("at"), F.least("least", "lower").alias("least")), (under_way, places)


def id_map(decisions: DataFrame) -> DataFrame:
    """source, target: what each merged subject finally is. decisions: seq, edge_id, action, source_subject_id, target_subject_id."""
    merges = standing(decisions, "edge_id").where((F.col("action") == MERGE) & (F.col("source_subject_id") != F.col("target_subject_id")))
    ends = _jumped(merges.groupBy(F.col("source_subject_id").alias("source")).agg(F.max_by("target_subject_id", "seq").alias("target")))
    # a place that has a step is part of a circle, which its smallest id stands for
    circles = ends.select(F.col("source").alias("at"), F.col("least").alias("root"))
    return ends.join(circles, "at", "left").select("source", F.coalesce("root", "at").alias("target")).where("source <> target")


def resolved_edges(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """edges (edge_id, status) with the status that the standing decision gives them; other actions need a person."""
    kept = standing(decisions, "edge_id").select("edge_id", "action")
    status = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in EDGE_STATUS.items() for x in p]), F.col("action")), F.lit("manual_review_required"))
    return edges.join(kept, "edge_id", "left").withColumn("status", F.when(F.col("action").isNull(), F.col("status")).otherwise(status))


def resolved_occurrences(occurrences: DataFrame, decisions: DataFrame, ids: DataFrame) -> DataFrame:
    """occurrences (occurrence_id, subject_id, text, status) with their final subject: a merge comes before any decision of their own."""
    own = standing(decisions.select("occurrence_id", "seq", "action"), "occurrence_id").select("occurrence_id", "action")
    map_ = ids.select(F.col("source").alias("subject_id"), "target")
    joined = occurrences.join(map_.hint("shuffle_hash"), "subject_id", "left").join(own.hint("shuffle_hash"), "occurrence_id", "left")
    status = F.element_at(F.create_map(*[F.lit(x) for p in OCCURRENCE_STATUS.items() for x in p]), F.col("action"))
    return joined.select(
        "occurrence_id", F.coalesce("target", "subject_id").alias("subject_id"), F.when(F.col("target").isNotNull(), F.col("subject_id")).alias("original_subject_id"), "text",
        F.when(F.col("target").isNotNull(), "confirmed_subject").otherwise(F.coalesce(status, F.col("status"))).alias("status"),
    )


def resolved_subjects(occurrences: DataFrame, ids: DataFrame) -> DataFrame:
    """Per final subject: occurrences, distinct surfaces, subjects merged into it and the statuses of its occurrences, in order."""
    merged = ids.groupBy(F.col("target").alias("subject_id")).agg(F.count("*").alias("merged"))
    found = occurrences.groupBy("subject_id").agg(F.count("*").alias("occurrences"), F.countDistinct("text").alias("surfaces"), F.array_join(F.array_sort(F.collect_set("status")), ",").alias("statuses"))
    return found.join(merged, "subject_id", "left").withColumn("merged", F.coalesce("merged", F.lit(0)))
