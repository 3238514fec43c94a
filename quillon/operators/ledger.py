"""Ledgers and their summaries: units, plans, candidates, constraints, replacements, tasks; and what is kept of repeated rows.

Summaries are one table (kind, value, n): a pass that explodes each row into what it counts for, and one aggregation with
partial sums, whatever the number of groupings.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import alpha_index, compact, greek_index, serial_index, stable_seed
from .resolve import ranked


def _tally(rows: DataFrame, counted: dict[str, Column], lists: dict[str, Column] | None = None) -> DataFrame:
    """Counts of each value of each column (booleans: of true rows alone, as 'true'), and of each element of each list."""
    one = [F.struct(F.lit(k).alias("kind"), c.cast("string").alias("value")) for k, c in counted.items()]
    items = F.array(*one)
    for k, c in (lists or {}).items():
        items = F.concat(items, _labelled(k, c))
    found = rows.select(F.explode(items).alias("x")).select("x.*").where("value is not null and value <> 'false'")
    return found.groupBy("kind", "value").agg(F.count("*").alias("n"))


def _labelled(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.cast("string").alias("value")))


def once(units: DataFrame) -> DataFrame:
    """One of the units that agree in unit_id, place and text."""
    return units.dropDuplicates(["unit_id", "start", "end", "text"])


def graph_summary(units: DataFrame) -> DataFrame:
    """Units (unit_id, start, end, text, container_type, story_type, part, rewritable) by container, story and part; how many
    there are, can be rewritten or must be reviewed, and are of an unknown part."""
    unknown = (F.col("container_type") == "xml_text") | F.contains(F.lower("part"), F.lit("unknown"))
    everything = {"unit": F.lit(True), "exact_rewrite": F.col("rewritable"), "review_required": ~F.col("rewritable"), "unknown_part": unknown}
    return _tally(once(units), everything | {"container": F.col("container_type"), "story": F.col("story_type"), "part": F.col("part")})


def plan_summary(plan: DataFrame) -> DataFrame:
    """Obligations by category, priority and expected type, and how many need a rewrite."""
    counted = {"obligation": F.lit(True), "category": F.col("category"), "priority": F.col("priority"), "rewrite_required": F.col("rewrite_required")}
    return _tally(plan, counted, {"expected_type": F.col("expected")})


def candidate_summary(candidates: DataFrame) -> DataFrame:
    """Candidates by source and type, and with and without a unit."""
    known = F.coalesce(F.col("unit_id") != "", F.lit(False))
    return _tally(candidates, {"candidate": F.lit(True), "with_unit": known, "without_unit": ~known, "source": F.col("source"), "type": F.upper(F.trim("entity_type"))})


def constraints_once(constraints: DataFrame) -> DataFrame:
    """Constraints (kind, left_id, right_id, evidence) with the smaller id left, each once."""
    out = constraints.select("kind", F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), "evidence")
    return out.distinct()


def constraint_summary(constraints: DataFrame) -> DataFrame:
    open_ = F.col("kind").isin("maybe_link", "type_conflict")
    return _tally(constraints_once(constraints), {"constraint": F.lit(True), "type": F.col("kind"), "unresolved": open_})


#: Types in order of priority as subjects.
SUBJECT_PRIORITY = {"ORGANIZATION": 1, "COMPANY_NAME": 1, "PERSON": 2, "PERSON_NAME": 2, "ALIAS": 3, "BANK_NAME": 4, "ACCOUNT_NAME": 5, "ADDRESS": 6, "LOCATION": 6}


def canonical_types(rows: DataFrame, by: list[str]) -> DataFrame:
    """The type that most rows of each group have; of equals the one of higher priority, then the first by name."""
    counts = rows.groupBy(*by, "entity_type").agg(F.count("*").alias("n"))
    order = F.struct((-F.col("n")).alias("n"), ranked(SUBJECT_PRIORITY, F.col("entity_type")).alias("p"), F.col("entity_type").alias("t"))
    return counts.groupBy(*by).agg(F.min_by("entity_type", order).alias("subject_type"))


NOT_REWRITTEN = ("DATE", "AMOUNT", "POSITION")


def final_directory(entities: DataFrame, most: int = 12) -> DataFrame:
    """Subjects of entities (doc_id, entity_type, text, start, replacement, method, canonical_key) that are replaced: one row for
    each type and canonical key, or else text without white space; the most frequent, longest surfaces first.

    subject_id numbers the subjects of a document by priority of type, first place and text.
    """
    text, replacement = F.trim("text"), F.trim("replacement")
    changed = (text != "") & (replacement != "") & (text != replacement) & (F.coalesce(F.lower("method"), F.lit("")) != "preserve") & ~F.col("entity_type").isin(*NOT_REWRITTEN)
    canonical = F.nullif(F.trim("canonical_key"), F.lit(""))
    rows = entities.where(changed).select("doc_id", "entity_type", canonical.isNotNull().alias("named"), F.coalesce(canonical, compact(F.col("text"))).alias("key"), text.alias("text"), "start", replacement.alias("replacement"))
    by = ["doc_id", "entity_type", "named", "key"]
    each = rows.groupBy(*by, "text").agg(F.count("*").alias("n"), F.min("start").alias("start"), F.min_by("replacement", "start").alias("replacement"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), (-F.length("text")).alias("l"), "text")))
    groups = each.groupBy(*by).agg(F.slice(F.transform(ordered, lambda x: x["text"]), 1, most).alias("surfaces"), F.sum("n").alias("occurrences"), F.min_by("replacement", "start").alias("replacement"), F.min("start").alias("start"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(ranked(SUBJECT_PRIORITY, F.col("entity_type")), "start", F.get("surfaces", F.lit(0)), "entity_type", "key"))
    return groups.withColumn("subject_id", F.concat(F.lit("CFE"), F.lpad(place.cast("string"), 5, "0"))).drop("named")


def replacement_summary(candidates: DataFrame, directory: DataFrame) -> DataFrame:
    """One row: subjects that have a replacement, those that have several, and replacements of the directory."""
    text = F.coalesce(F.nullif(F.trim("normalized_text"), F.lit("")), F.trim("text"))
    own = candidates.select(text.alias("text"), F.trim("replacement").alias("replacement")).where("text <> '' and replacement <> ''")
    each = own.groupBy("text").agg(F.countDistinct("replacement").alias("n"))
    counts = each.agg(F.count("*").alias("preassigned"), F.count_if(F.col("n") > 1).alias("multi"))
    compiled = directory.where(F.trim("replacement") != "").agg(F.countDistinct(F.trim("replacement")).alias("compiled"))
    return counts.crossJoin(F.broadcast(compiled))  # one row each


#: What blocks an export.
BLOCKING = (
    "uncovered_required_obligation", "unrewritable_obligation", "hard_identity_conflict", "hard_arbitration_task", "directory_replacement_conflict", "subject_multi_replacement", "blocked_rewrite_entry",
    "missing_directory_candidate",
)


def verify_rewrite(counts: DataFrame) -> DataFrame:
    """Per row of counts (BLOCKING, compilable, prewrite_passed): the sum and the names of what blocks, and whether it is ready."""
    n = {c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)) for c in BLOCKING}
    names = F.filter(F.array(*[F.when(v > 0, F.lit(c)) for c, v in n.items()]), lambda x: x.isNotNull())
    total = functools.reduce(lambda a, b: a + b, n.values())
    others = [c for c in counts.columns if c not in BLOCKING and c not in ("compilable", "prewrite_passed")]
    return counts.select(*others, total.cast("long").alias("blocking"), F.array_join(names, ",").alias("blocked_by"), ((total == 0) & F.col("compilable") & F.col("prewrite_passed")).alias("ready"))


def invariants(issues: DataFrame) -> DataFrame:
    """One row of counts of consistency issues (kind) and the flags they raise."""
    n = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    found = issues.agg(
        n("canonical_key_multi_replacement").alias("subject_multi_replacement"), n("same_text_multi_replacement").alias("same_text_multi_replacement"),
        n("replacement_reused_by_multi_subject", "group_memory_conflict").alias("replacement_reused_by_multi_subject"),
    )
    flags = F.filter(F.array(*[F.when(F.col(c) > 0, F.lit(c)) for c in found.columns]), lambda x: x.isNotNull())
    return found.withColumn("flags", F.array_join(flags, ","))


def amount_clusters(amounts: DataFrame) -> DataFrame:
    """The amount that stands for those of a line (doc_id, line_start, line_end, line, start, text, value): that of its first one,
    raised by 8 to 26 per cent as the line's seed says, 1,000 at least; with two decimals if it is written with decimals."""
    first = amounts.groupBy("doc_id", "line_start", "line_end").agg(F.min_by(F.struct("line", "text", "value"), F.struct("start", "text", "value")).alias("x")).select("doc_id", "line_start", "line_end", "x.*")
    raised = F.greatest(F.lit(1000.0), F.col("value") * (F.lit(1.08) + F.pmod(stable_seed(F.col("line")), F.lit(19)) / 100))
    return first.select("doc_id", "line_start", "line_end", F.when(F.col("text").rlike(r"\.[0-9]+"), F.bround(raised, 2)).otherwise(F.bround(raised, 0)).alias("value"))


def resolutions(candidates: DataFrame, constraints: DataFrame, p0: tuple[str, ...], subjects: tuple[str, ...], is_role: Column) -> DataFrame:
    """What rules alone decide: formats are confirmed, roles and titles taken for subjects rejected, equal surfaces linked."""
    operation = F.when(F.col("entity_type").isin(*p0), "confirm_candidate").when(F.col("entity_type").isin(*subjects) & is_role, "reject_candidate")
    evidence = F.when(operation == "confirm_candidate", "format_entity_rule_stable").otherwise("role_or_title_not_subject")
    own = candidates.select(operation.alias("operation"), F.col("candidate_id").alias("target"), evidence.alias("evidence")).where("operation is not null")
    links = constraints_once(constraints).where("kind = 'must_link'").select(F.lit("must_link").alias("operation"), F.concat_ws(",", "left_id", "right_id").alias("target"), "evidence")
    return own.unionByName(links)


def symbolic(subjects: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """subjects (style) with code: a running number in its scope as upper or lower letters, Greek letters or serials."""
    i = F.row_number().over(Window.partitionBy(*scope).orderBy(*order)).cast("long") - 1
    style = F.col("style")
    code = F.when(style == "lower_letter", F.lower(alpha_index(F.col("__i")))).when(style == "official_greek", greek_index(F.col("__i"))).when(style == "cn", serial_index(F.col("__i"))).otherwise(alpha_index(F.col("__i")))
    return subjects.withColumn("__i", i).withColumn("code", code).drop("__i")


def alias_replacements(aliases: DataFrame, groups: DataFrame) -> DataFrame:
    """aliases (doc_id, alias, canonical) with the replacement of the first group (doc_id, place, surface, replacement) that has the
    canonical text as a surface, white space aside; empty if none has."""
    key = lambda c: F.lower(compact(F.col(c)))
    own = groups.select("doc_id", key("surface").alias("__key"), "place", "replacement").where("__key <> ''").groupBy("doc_id", "__key").agg(F.min_by("replacement", "place").alias("replacement"))
    joined = aliases.withColumn("__key", key("canonical")).join(own, ["doc_id", "__key"], "left")
    return joined.select(*aliases.columns, F.coalesce("replacement", F.lit("")).alias("replacement"))


# --- rows that repeat ---


def prefer(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the first by order."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")


#: Types in the order in which a model's readings of one span are preferred.
MODEL_TYPES = {"BANK_NAME": 1, "ACCOUNT_NAME": 2, "ORGANIZATION": 3, "PROJECT": 4, "CONTRACT_NO": 5, "LOCATION": 6, "POSITION": 7, "PERSON": 8}


def model_entities_once(entities: DataFrame) -> DataFrame:
    """One reading of each span: by type, score, a source that is structured or refined, and input order (place)."""
    refined = F.regexp_count("source", F.lit("structured|refined"))
    return prefer(entities, ["doc_id", "start", "end", "text"], [ranked(MODEL_TYPES, F.upper("entity_type")), F.desc("score"), F.desc(refined), F.col("place")])


def tasks_once(tasks: DataFrame) -> DataFrame:
    """One task of each type, page and gap: that of the highest priority, then the first."""
    return prefer(tasks, ["task_type", "page_no", "gap_id"], [F.desc("priority"), F.col("task_id")])


def rejections_once(rejections: DataFrame) -> DataFrame:
    """One rejection of each type, text and place: a decision counts twice a deterministic one or review, then the first."""
    n = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0))
    rank = 2 * n("entity_decision") + n("deterministic_decision") + n("deterministic_review")
    return prefer(rejections, ["doc_id", "entity_type", "text", "start", "end"], [rank.desc(), F.col("place")])


def task_summary(tasks: DataFrame) -> DataFrame:
    """Tasks by type, status, engine and executor; open, for people, of high priority."""
    resolved = F.col("status") == "resolved"
    human = ~resolved & ((F.col("status") == "human_required") | (F.col("next_engine") == "human_review") | (F.col("fallback") == "human_review_required"))
    counted = {"task": F.lit(True), "resolved": resolved, "human_required": human, "high_priority": F.col("priority") >= 85, "type": F.col("task_type"), "status": F.col("status"), "next_engine": F.nullif("next_engine", F.lit("")), "executor": F.nullif("executor", F.lit(""))}
    pages = tasks.where("page_no > 0").agg(F.countDistinct("page_no").alias("n")).select(F.lit("page").alias("kind"), F.lit("true").alias("value"), "n")
    return _tally(tasks, counted).unionByName(pages)


def snippets(rows: DataFrame, limit: int, by: str = "doc_id") -> DataFrame:
    """Snippets (class, key, text, priority, place) that are reviewed: each key once; all of ledger, subject and discovery; of
    structure at least 2 and at most the larger of half the limit and 6; of others what the limit leaves, 1 at least."""
    first = prefer(rows.where(F.trim("text") != ""), [by, "key"], [F.col("priority"), F.col("place")])
    limit = max(1, limit)
    everything = Window.partitionBy(by)
    n_of = lambda c: F.count_if(F.col("class") == c).over(everything)
    structure = F.greatest(F.lit(2), F.least(n_of("structure"), F.lit(max(limit // 2, 6))))
    others = F.greatest(F.lit(1), F.lit(limit) - F.least(structure, n_of("structure")) - n_of("discovery"))
    at = F.row_number().over(Window.partitionBy(by, "class").orderBy("priority", "place"))
    most = F.when(F.col("class") == "structure", structure).when(F.col("class") == "ordinary", others)
    return first.withColumn("__at", at).withColumn("__most", most).where("__most is null or __at <= __most").drop("__at", "__most")


#: Snippets of a type, 2 of others.
SNIPPETS_OF = {"legal_party_block": 3, "address_block": 3, "narrative_hotspot": 5}


def first_snippets(rows: DataFrame, by: str = "doc_id") -> DataFrame:
    """The first few snippets (snippet_type, keyword_place, start) of each type, in the order of their keywords."""
    at = F.row_number().over(Window.partitionBy(by, "snippet_type").orderBy("keyword_place", "start"))
    return rows.withColumn("__at", at).where(F.col("__at") <= ranked(SNIPPETS_OF, F.col("snippet_type"), 2)).drop("__at")


def merged_blocks(blocks: DataFrame, most: int, by: str = "doc_id") -> DataFrame:
    """Blocks (text, categories, tokens, complexity, risk, start, place) with equal text as one: the most complex, riskiest, first
    one's with all categories and the first 8 tokens; the best of each document."""
    key = compact(F.col("text"))
    best = F.struct("complexity", "risk", (-F.col("start")).alias("s"), (-F.col("place")).alias("p"))
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    once_ = blocks.withColumn("normalized", key).where("normalized <> ''").groupBy(by, "normalized").agg(
        F.max_by(F.struct("text", "complexity", "risk", "start"), best).alias("x"), every("categories").alias("categories"), F.slice(every("tokens"), 1, 8).alias("tokens")
    )
    out = once_.select(by, "normalized", "x.*", "categories", "tokens")
    at = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("complexity"), F.desc("risk"), "start", "normalized"))
    return out.withColumn("at", at).where(F.col("at") <= most)


def model_conflicts(spans: DataFrame) -> DataFrame:
    """Per document where the first two readings by uie and by ner that overlap and differ in type begin.

    Spans meet in the fixed-size buckets that they cover, not all of a document with all."""
    size = 64
    covered = F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))).alias("bucket")
    own = spans.where(F.col("source").isin("uie", "ner", "secondary_ner") & (F.col("end") > F.col("start")))
    side = lambda uie, p: own.where((F.col("source") == "uie") == uie).select("doc_id", covered, *[F.col(c).alias(f"{p}_{c}") for c in ("start", "end", "entity_type")])
    met = side(True, "l").join(side(False, "r"), ["doc_id", "bucket"]).where("l_start < r_end and r_start < l_end and l_entity_type <> r_entity_type")
    order = F.struct("l_start", "l_end", "l_entity_type", "r_start", "r_end", "r_entity_type")
    return met.groupBy("doc_id").agg(F.min_by(F.least("l_start", "r_start"), order).alias("start"))


def united_rectangles(rectangles: DataFrame, by: list[str]) -> DataFrame:
    """Rectangles (x0, y0, x1, y1) of a page, top to bottom and left to right, each united with the one before if they share
    45 per cent of a height and the gap is at most 80 per cent of one. One page's rectangles are one row."""
    item = F.struct("y0", "x0", "y1", "x1")
    pages = rectangles.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("all"))

    def step(done: Column, new: Column) -> Column:
        last = F.element_at(done, -1)
        height = lambda r: F.greatest(r["y1"] - r["y0"], F.lit(0.001))
        band = F.least(last["y1"], new["y1"]) - F.greatest(last["y0"], new["y0"]) >= F.least(height(last), height(new)) * 0.45
        near = new["x0"] - last["x1"] <= F.greatest(height(last), height(new)) * 0.8
        both = F.struct(F.least(last["y0"], new["y0"]).alias("y0"), F.least(last["x0"], new["x0"]).alias("x0"), F.greatest(last["y1"], new["y1"]).alias("y1"), F.greatest(last["x1"], new["x1"]).alias("x1"))
        return F.when(F.size(done) == 0, F.array(new)).when(band & near, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(both))).otherwise(F.concat(done, F.array(new)))

    none = F.filter(F.col("all"), lambda _: F.lit(False))
    return pages.select(*by, F.inline(F.aggregate("all", none, step))).select(*by, "x0", "y0", "x1", "y1")


# --- checks of an audit's result ---

#: States of quality in which an audit can be used.
PASSABLE = ("", "no_actionable_candidates", "usable_with_comments", "usable_with_review_queue")


def audit_checks(s: DataFrame) -> DataFrame:
    """audit_id, check, passed and severity, from summaries of audits (one row each; the columns are those named here)."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    checks = (
        ("worker_output_ok", yes("ok"), "fail"), ("engine_is_v4", F.col("engine") == "v4", "fail"), ("comment_count_matches_corrections", F.col("comment_count").eqNullSafe(F.col("correction_count")), "warn"),
        ("reviewed_docx_exists", yes("reviewed_docx"), "fail"), ("reviewed_docx_text_unchanged", ~yes("text_checked") | yes("text_equal"), "fail"), ("audit_report_exists", yes("audit_report"), "fail"),
        ("evidence_zip_exists", yes("evidence_zip"), "fail"), ("evidence_zip_has_core_payloads", zero("missing_entries"), "fail"),
        ("no_mandatory_alpha_numeric_replacements", zero("alpha_numeric"), "fail"), ("no_mandatory_incomplete_numeric_replacements", zero("incomplete_numeric"), "fail"),
        ("quality_inspection_passable", F.coalesce("quality_status", F.lit("")).isin(*PASSABLE), "fail"), ("quality_metrics_present", F.col("full_content_unresolved").isNotNull(), "warn"),
        ("model_gate_metrics_present", F.col("text_reviewed").isNotNull(), "warn"), ("page_taxonomy_metrics_present", ~zero("page_types"), "warn"),
    )
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).alias("passed"), F.lit(v).alias("severity")) for n, c, v in checks])
    return s.select("audit_id", F.inline(rows))


#: Limits that an audit is held to.
GOLD_RECALL, GOLD_FALSE_RATE, GOLD_CRITICAL = 0.95, 0.10, 0


def gold_verdict(samples: DataFrame) -> DataFrame:
    """samples (sample, expected, matched, confirmed, critical_missed) with recall, false_rate and status."""
    recall = F.when(F.col("expected") > 0, F.round(F.col("matched") / F.col("expected"), 4)).otherwise(1.0)
    false = F.when(F.col("confirmed") > 0, F.round((F.col("confirmed") - F.col("matched")) / F.col("confirmed"), 4)).otherwise(0.0)
    out = samples.withColumn("recall", recall).withColumn("false_rate", false)
    passed = (F.col("recall") >= GOLD_RECALL) & (F.col("false_rate") <= GOLD_FALSE_RATE) & (F.col("critical_missed") <= GOLD_CRITICAL)
    return out.withColumn("status", F.when(passed, "passed").otherwise("failed"))
