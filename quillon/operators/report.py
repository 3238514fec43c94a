"""Reports: counts, clusters, risk per page, states, review queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def type_counts(spans: DataFrame, examples: int = 3) -> DataFrame:
    """Per type: count and the first few texts, in order of document and place. Only the first of each partition meet."""
    order = Window.partitionBy("entity_type").orderBy("doc_id", "start", "text")
    first = spans.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= examples)
    shown = first.groupBy("entity_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "text"))), lambda x: x["text"]).alias("examples"))
    return spans.groupBy("entity_type").agg(F.count("*").alias("n")).join(shown, "entity_type")


def counts_by(spans: DataFrame, *columns: str) -> DataFrame:
    """One pass over the input, a count for each value of each column: column, value, n (grouping sets)."""
    wide = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")
    return spans.select(wide).select("x.*").groupBy("column", "value").agg(F.count("*").alias("n"))


def duplicates(units: DataFrame, key: Column, least: int = 24) -> DataFrame:
    """Contents that several units have: key, n, first unit. Short ones don't count."""
    keyed = units.select(key.alias("content"), "unit_id").where(F.length("content") >= least)
    return keyed.groupBy("content").agg(F.count("*").alias("n"), F.min("unit_id").alias("first")).where("n > 1")


def clusters(rows: DataFrame, keys: list[str], flags: dict[str, Column]) -> DataFrame:
    """Groups of several rows by keys, with counts of flags, largest first by rank."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(c).alias(name) for name, c in flags.items()]).where("n > 1")
    return found


#: What makes a page a high risk, what a medium one, and labels that make it a medium one.
HIGH_RISK = ("confirmed", "coverage_gap", "model_conflict")
MEDIUM_RISK = ("suspected", "review_task", "unresolved_coverage")
MEDIUM_LABELS = ("image_pdf_page", "scan_like", "table_heavy", "table_image_page")


def page_risk(spine: DataFrame, tables: dict[str, DataFrame], by: str = "page_no") -> DataFrame:
    """Counts of each table's rows per page, over all pages of the spine, and the level of risk: high for any row of a table
    of HIGH_RISK, medium for any of MEDIUM_RISK or a label (array labels of the spine, if it has one)."""
    out = spine
    for name, rows in tables.items():
        out = out.join(rows.groupBy(by).agg(F.count("*").alias(f"{name}_count")), by, "left").withColumn(f"{name}_count", F.coalesce(f"{name}_count", F.lit(0).cast("long")))
    any_of = lambda names: sum((F.col(f"{name}_count") for name in tables if name in names), F.lit(0)) > 0
    labelled = F.arrays_overlap("labels", F.array(*map(F.lit, MEDIUM_LABELS))) if "labels" in spine.columns else F.lit(False)
    return out.withColumn("risk_level", F.when(any_of(HIGH_RISK), "high").when(any_of(MEDIUM_RISK) | labelled, "medium").otherwise("low"))


REVIEW_STATES = ("human_review_required", "coverage_gap", "model_conflict", "suspected_error")


def terminal_state(pages: DataFrame) -> DataFrame:
    """The state that each page ends in, from its counts; the first that applies."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    state = (
        F.when((n("review_task_count") > 0) | (n("unresolved_coverage_count") > 0), "human_review_required").when(n("coverage_gap_count") > 0, "coverage_gap")
        .when(n("model_conflict_count") > 0, "model_conflict").when(n("suspected_count") > 0, "suspected_error").when(n("confirmed_count") > 0, "confirmed_error").otherwise("covered")
    )
    open_ = sum((F.greatest(n(c), F.lit(0)) for c in ("review_task_count", "unresolved_coverage_count", "coverage_gap_count", "model_conflict_count", "suspected_count")), F.lit(0))
    return pages.withColumn("terminal_state", state).withColumn("requires_human_review", state.isin(*REVIEW_STATES)).withColumn("open_issue_count", open_)


def state_summary(pages: DataFrame) -> DataFrame:
    return pages.groupBy("terminal_state").agg(F.count("*").alias("pages"), F.sum("open_issue_count").alias("open_issues"), F.count_if("requires_human_review").alias("to_review"))


#: From how many unresolved, table, visual and mapping rows a page is a high risk.
HIGH_RISK_LIMITS = {"unresolved_count": 12, "table_count": 8, "visual_count": 6, "mapping_count": 6}


def high_risk(pages: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """Pages on which any count reaches its limit."""
    test = None
    limits = limits or HIGH_RISK_LIMITS
    for column, limit in limits.items():
        one = F.col(column) >= limit
        test = one if test is None else test | one
    return pages.where(test)


def review_queue(tasks: DataFrame, most: int) -> DataFrame:
    """The first tasks by priority, page and type: a top-k, so only k rows of each partition meet."""
    first = tasks.orderBy(F.desc("priority"), "page_no", "task_type", "task_id").limit(most)
    return first.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("priority"), "page_no", "task_type", "task_id")))


def compact_for_review(rows: DataFrame, most: int = 512, by: str = "doc_id") -> DataFrame:
    """Rows that must be kept, all, and of the others the riskiest that fit, once for each type and text."""
    key = Window.partitionBy(by, "entity_type", "text")
    repeated = F.count("*").over(key) > 1
    n = F.length("text")
    risk = (
        F.lit(50) - F.when(F.col("must_keep"), 40).otherwise(0) - F.when(F.col("source") == "fragment_review", 20).otherwise(0)
        - F.when(F.col("entity_type").isin("ORGANIZATION", "GOVERNMENT") & n.between(2, 6), 15).otherwise(0)
        - F.when((F.col("entity_type") == "PERSON") & n.between(2, 4), 8).otherwise(0) - F.when(repeated, 5).otherwise(0)
        - F.when(F.col("source").isin("uie", "ner", "llm"), 3).otherwise(0)
    )
    scored = rows.withColumn("risk", risk)
    once = scored.withColumn("__n", F.row_number().over(key.orderBy(F.desc("must_keep"), "start", "end"))).where("must_keep or __n = 1").drop("__n")
    kept = F.count_if("must_keep").over(Window.partitionBy(by))
    place = F.row_number().over(Window.partitionBy(by, "must_keep").orderBy("risk", "start", F.desc(n), "entity_type", "text"))
    return once.withColumn("__kept", kept).withColumn("place", place).where(F.col("must_keep") | (F.col("place") <= F.lit(most) - F.col("__kept"))).drop("__kept")


def routes(pages: DataFrame) -> DataFrame:
    """Type and layout of each document from shares of its page types (doc_id, page_type): native or image pages on 80 % and
    the other on at most 20 % decide the type; tables, then images, then native pages on 55 % the layout."""
    n = lambda types: F.count_if(F.col("page_type").isin(*types))
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), n(IMAGE_PAGES).alias("image_pages"), n(NATIVE_PAGES).alias("native_pages"), n(TABLE_PAGES).alias("table_pages"))
    share = lambda c: F.col(c) / F.col("pages")
    image, native = share("image_pages"), share("native_pages")
    kind = F.when((native >= 0.8) & (image <= 0.2), "text_pdf").when((image >= 0.8) & (native <= 0.2), "image_pdf").otherwise("mixed_pdf")
    layout = F.when(share("table_pages") >= 0.55, "table_heavy").when(image >= 0.55, "image_text_heavy").when(native >= 0.55, "native_text_heavy").otherwise("mixed_layout")
    return counts.withColumn("document_type", kind).withColumn("layout_family", layout)


#: Page types.
IMAGE_PAGES = ("image_text_page", "image_table_page", "image_form_field_page", "mixed_complex_page")
NATIVE_PAGES = ("native_text_page", "native_table_page")
TABLE_PAGES = ("image_table_page", "native_table_page")


def lifecycle(ledger: DataFrame) -> DataFrame:
    """Counts of states and of reasons (array), in one table: kind, value, n."""
    states = ledger.groupBy(F.col("state").alias("value")).agg(F.count("*").alias("n")).select(F.lit("state").alias("kind"), "value", "n")
    reasons = ledger.select(F.explode("reasons").alias("value")).groupBy("value").agg(F.count("*").alias("n")).select(F.lit("reason").alias("kind"), "value", "n")
    return states.unionByName(reasons)
