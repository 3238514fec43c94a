"""Spans of one document against each other: overlaps, duplicates, containment, propagation, rewriting.

Work is per document: one shuffle by doc_id, shared by the operators of a chain. Orders are total (ties by input), so
results do not depend on partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bind


def dedupe(spans: DataFrame) -> DataFrame:
    """One span of each type, place and text: that of the highest score, then the smallest source."""
    order = Window.partitionBy("doc_id", "entity_type", "start", "end", "text").orderBy(F.desc("score"), "source")
    return spans.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def drop_embedded(spans: DataFrame, inner: tuple[str, ...] = ("LOCATION",), outer: tuple[str, ...] = ("ORGANIZATION", "GOVERNMENT")) -> DataFrame:
    """Without spans of the inner types that lie within one of an outer type."""
    holders = spans.where(F.col("entity_type").isin(*outer)).select(F.col("doc_id").alias("__doc"), F.col("start").alias("__start"), F.col("end").alias("__end"))
    within = (F.col("doc_id") == F.col("__doc")) & (F.col("__start") <= F.col("start")) & (F.col("end") <= F.col("__end")) & F.col("entity_type").isin(*inner)
    return spans.join(holders, within, "left_anti")


def mark_overlaps(spans: DataFrame, by: tuple[str, ...] = ("doc_id",), tie: str = "entity_type") -> DataFrame:
    """A sweep in order of start, longer first: a span that begins before the furthest end so far overlaps, and blocks the
    span of that end too. Adds overlaps (it begins inside another) and blocked (either side of an overlap)."""
    order = Window.partitionBy(*by).orderBy("start", F.desc("end"), tie)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    numbered = spans.withColumn("__n", F.row_number().over(order))
    furthest = F.max(F.struct(F.col("end"), (-F.col("__n")).alias("n"))).over(before)
    swept = numbered.withColumn("__top", furthest).withColumn("overlaps", F.coalesce(F.col("start") < F.col("__top.end"), F.lit(False)))
    holders = F.collect_set(F.when(F.col("overlaps"), -F.col("__top.n"))).over(Window.partitionBy(*by))
    return swept.withColumn("blocked", F.col("overlaps") | F.array_contains(holders, F.col("__n"))).drop("__n", "__top")


def _fold(spans: DataFrame, order: Column, prefer: object, by: str = "doc_id") -> DataFrame:
    """Take spans of a document in an order; one that overlaps a taken span replaces the first such if it is preferred."""
    fields = [c for c in spans.columns if c != by]
    item = F.struct(*fields)
    sorted_ = F.array_sort(F.collect_list(F.struct(order.alias("o"), item.alias("s"))))
    grouped = spans.groupBy(by).agg(F.transform(sorted_, lambda x: x["s"]).alias("all"))
    overlap = lambda a, b: (a["start"] < b["end"]) & (a["end"] > b["start"])

    def step(taken: Column, new: Column) -> Column:
        place = F.array_position(F.transform(taken, lambda t: overlap(new, t)), F.lit(True))
        current = F.get(taken, (place - 1).cast("int"))
        swapped = F.transform(taken, lambda t, i: F.when((i + 1 == place) & prefer(new, current), new).otherwise(t))
        return F.when(place == 0, F.concat(taken, F.array(new))).otherwise(swapped)

    none = F.filter(F.col("all"), lambda _: F.lit(False))
    return grouped.select(by, F.inline(F.aggregate("all", none, step))).select(*spans.columns)


def by_priority(spans: DataFrame) -> DataFrame:
    """Order (start, priority, longer, score); of overlapping spans the lower priority number stays, then the longer, then the higher score."""
    size = lambda s: s["end"] - s["start"]

    def prefer(new: Column, old: Column) -> Column:
        return F.when(new["priority"] != old["priority"], new["priority"] < old["priority"]).when(size(new) != size(old), size(new) > size(old)).otherwise(new["score"] > old["score"])

    order = F.struct("start", "priority", (F.col("start") - F.col("end")).alias("l"), (-F.col("score")).alias("c"), "entity_type", "source")
    return _fold(spans, order, prefer)


#: How far sources are trusted (the lower the more), how specific types are, and types that others don't replace.
SOURCE_PRIORITY = {
    "regex": 1, "rule_format": 1, "rule_organization": 2, "rule_person": 2, "rule_address": 2, "rule_bank": 2, "rule_alias": 2, "custom": 2, "contract": 3, "contract_structure_backfill": 4,
    "high_quality_lowmem": 5, "uie": 6, "ner": 7, "secondary_ner": 7, "qwen_fragment_review": 8, "alias_propagation": 9, "llm": 10, "ollama": 10, "propagate": 11,
}
TYPE_SPECIFICITY = {
    "BANK_NAME": 1, "ACCOUNT_NAME": 1, "CONTRACT_NO": 1, "CN_PHONE": 1, "LANDLINE_PHONE": 1, "CN_BANK_CARD": 1, "CN_ID_CARD": 1, "CN_CREDIT_CODE": 1, "EMAIL_ADDRESS": 1, "CASE_NO": 1,
    "AMOUNT": 1, "DATE": 1, "ADDRESS": 2, "COURT": 2, "PROJECT": 2, "LOCATION": 2, "GOVERNMENT": 2, "POSITION": 2, "PERSON": 2, "PERSON_NAME": 2, "ORGANIZATION": 3, "COMPANY_NAME": 3, "ALIAS": 3,
}
AUTHORITATIVE_TYPES = ("CN_ID_CARD", "CN_PHONE", "LANDLINE_PHONE", "CN_BANK_CARD", "CN_CREDIT_CODE", "EMAIL_ADDRESS", "CONTRACT_NO", "CASE_NO")


def ranked(ranks: dict[str, int], value: Column, other: int = 99) -> Column:
    """The rank of a value."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair]), value), F.lit(other))


def by_source(spans: DataFrame) -> DataFrame:
    """Order (source, score, longer, start, end). Of overlapping spans at different places one of an authoritative type wins
    over another; of one type the longer wins unless its source is over two ranks less trusted; else the first stays. At
    one place the more specific type wins, then the higher score."""
    sure = lambda s: s["entity_type"].isin(*AUTHORITATIVE_TYPES)
    size = lambda s: s["end"] - s["start"]

    def prefer(new: Column, old: Column) -> Column:
        same_place = (new["start"] == old["start"]) & (new["end"] == old["end"])
        longer = (new["entity_type"] == old["entity_type"]) & (size(new) > size(old)) & (new["__rank"] <= old["__rank"] + 2)
        apart = F.when(sure(new) != sure(old), sure(new)).otherwise(longer)
        together = F.when(new["__specific"] != old["__specific"], new["__specific"] < old["__specific"]).otherwise(new["score"] > old["score"])
        return F.when(same_place, together).otherwise(apart)

    known = spans.withColumn("__rank", ranked(SOURCE_PRIORITY, F.col("source"))).withColumn("__specific", ranked(TYPE_SPECIFICITY, F.col("entity_type")))
    order = F.struct(F.col("__rank").alias("r"), (-F.col("score")).alias("c"), (F.col("start") - F.col("end")).alias("l"), "start", "end", "entity_type")
    return _fold(known, order, prefer).drop("__rank", "__specific")


def keep_free(spans: DataFrame, order: list[Column]) -> DataFrame:
    """In an order, spans that overlap none kept before: what a rewrite can use."""
    return _fold(spans, F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]), lambda new, old: F.lit(False))


def propagate(docs: DataFrame, surfaces: DataFrame, taken: DataFrame) -> DataFrame:
    """Further exact mentions of known surfaces (doc_id, entity_type, surface), in order, that overlap no span taken."""
    joined = docs.select("doc_id", "text").join(surfaces, "doc_id")
    # all places of a surface: what stands before each of its parts
    cut = F.struct(F.split("text", F.concat(F.lit(r"\Q"), "surface", F.lit(r"\E")), -1).alias("parts"), F.length("surface").alias("n"))
    ends = lambda x: F.aggregate(F.slice(x["parts"], F.lit(1), F.size(x["parts"]) - 1), F.array(F.lit(0)), lambda at, p: F.concat(at, F.array(F.element_at(at, -1) + F.length(p) + x["n"])))
    starts = bind(cut, lambda x: F.transform(F.slice(ends(x), F.lit(2), F.size(x["parts"]) - 1), lambda e: e - x["n"]))
    held = joined.where((F.length("surface") > 0) & F.contains("text", "surface"))
    found = held.select("doc_id", "entity_type", "surface", F.explode(starts).alias("start"))
    found = found.select("doc_id", "entity_type", F.col("surface").alias("text"), "start", (F.col("start") + F.length("surface")).alias("end"))
    busy = taken.select(F.col("doc_id").alias("__doc"), F.col("start").alias("__s"), F.col("end").alias("__e"))
    return found.join(busy, (F.col("doc_id") == F.col("__doc")) & (F.col("start") < F.col("__e")) & (F.col("end") > F.col("__s")), "left_anti")


def rewrite(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, masked, n_rewritten: texts with each span (start, end, replacement) replaced, from the right.

    Spans must not overlap (keep_free). Documents without spans don't take part in the shuffle's larger side twice.
    """
    ordered = F.array_sort(F.collect_list(F.struct("start", "end", "replacement")))
    edits = spans.groupBy("doc_id").agg(ordered.alias("edits"))
    joined = docs.select("doc_id", "text").join(edits, "doc_id", "left")
    # pieces between spans, so that the text is copied once however many spans it has
    n = F.size("edits")
    cut = lambda a, b: F.substr("text", a + 1, b - a)
    piece = lambda e, i: F.concat(cut(F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("edits"), i - 1)["end"]), e["start"]), e["replacement"])
    tail = F.substr("text", F.element_at("edits", -1)["end"] + 1)
    done = F.concat(F.array_join(F.transform("edits", piece), ""), tail)
    return joined.select("doc_id", F.when(n > 0, done).otherwise(F.col("text")).alias("masked"), F.greatest(n, F.lit(0)).alias("n_rewritten"))


def containing(spans: DataFrame, units: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Each span with the smallest unit that holds it (then the smallest unit_id), or none; with more columns of that unit.

    Units stand in buckets of the power of two below their length, two or three each; a span looks into one bucket of each
    size that can hold it. So only units near it are compared, however many a document has, and whatever their nesting.
    """
    level = lambda n: F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int")
    at = lambda x, k: F.shiftright(x.cast("long"), k)
    sized = units.where("end >= start").select(F.col("doc_id").alias("__doc"), "unit_id", F.col("start").alias("u_start"), F.col("end").alias("u_end"), level(F.col("end") - F.col("start")).alias("__k"), *more)
    buckets = F.expr("sequence(shiftright(CAST(u_start AS BIGINT), __k), shiftright(CAST(u_end AS BIGINT), __k))")
    placed = sized.select("*", F.explode(buckets).alias("__b"))
    keys = [c for c in spans.columns]
    used = sized.groupBy("__doc").agg(F.max("__k").alias("__most"))
    levels = F.expr("filter(sequence(0, __most), k -> shiftleft(2L, k) > end - start)")
    looking = spans.join(used, F.col("doc_id") == F.col("__doc"), "left").select(*keys, F.explode_outer(levels).alias("__level"))
    looking = looking.withColumn("__at", F.expr("shiftright(CAST(start AS BIGINT), __level)"))
    near = (F.col("doc_id") == F.col("__doc")) & (F.col("__level") == F.col("__k")) & (F.col("__at") == F.col("__b"))
    held = looking.join(placed, near & (F.col("u_start") <= F.col("start")) & (F.col("end") <= F.col("u_end")), "left")
    size = F.when(F.col("unit_id").isNotNull(), F.struct(F.col("u_end") - F.col("u_start"), F.col("unit_id")))
    found = held.groupBy(*keys).agg(F.min_by(F.struct("unit_id", *more), size).alias("__unit"))
    return found.select(*keys, *[F.col(f"__unit.{c}").alias(c) for c in ("unit_id", *more)])


def outside(units: DataFrame, spans: DataFrame) -> DataFrame:
    """Units (doc_id, unit_id, start, end) that no span overlaps: an interval anti-join.

    Starts and ends of both are swept in order of place: a unit is met if a span that began before its end ends after its
    start, so the furthest end of spans that begin before the unit's end decides. One sort per document, no pairs.
    """
    ends = units.select("doc_id", F.col("end").alias("__at"), F.lit(1).alias("__side"), *[F.col(c).alias(f"__u_{c}") for c in units.columns], F.lit(None).cast("int").alias("__to"))
    nothing = [F.lit(None).cast(t).alias(f"__u_{n}") for n, t in units.dtypes]
    begins = spans.where("end > start").select("doc_id", F.col("start").alias("__at"), F.lit(2).alias("__side"), *nothing, F.col("end").cast("int").alias("__to"))
    # at one place ends come before beginnings: a span that begins where a unit ends doesn't touch it
    order = Window.partitionBy("doc_id").orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, -1)
    swept = ends.unionByName(begins).withColumn("__furthest", F.max("__to").over(order)).where("__side = 1")
    free = F.col("__furthest").isNull() | (F.col("__furthest") <= F.col("__u_start"))
    return swept.where(free).select(*[F.col(f"__u_{c}").alias(c) for c in units.columns])
