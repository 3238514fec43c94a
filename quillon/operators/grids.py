"""Grids of table cells: types and profiles of columns, cells that don't fit, and what is known of each grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize

#: Letters that are read for digits, and kinds of evidence that speak for lost decimal points.
CONFUSABLE = "BDEGILOQSZ"
DECIMAL_ISSUES = ("decimal_point_missing", "decimal_or_punctuation_pollution")
#: Evidence of a column that makes plain integers in it suspect.
LEAST_DECIMAL = 2
GRID = ("page_no", "table_index")


def confusable_numeric(text: Column) -> Column:
    compact = F.upper(normalize(text))
    return (F.length(compact) >= 3) & F.rlike(compact, F.lit("[0-9]")) & ~F.rlike(compact, F.lit("[一-龥]")) & F.rlike(compact, F.lit(f"[{CONFUSABLE}]"))


def value_type(text: Column) -> Column:
    """What a cell holds: empty, date, decimal_number, integer_number, confusable_numeric, mixed_text_number, numeric_text or text."""
    bare = normalize(F.coalesce(text, F.lit("")))
    digit = F.rlike(bare, F.lit("[0-9]"))
    return (
        F.when(bare == "", "empty").when(F.rlike(bare, F.lit("[0-9]{4}年[0-9]{1,2}月|[0-9]{1,2}月[0-9]{1,2}日|[0-9]{4}[./-][0-9]{1,2}")), "date")
        .when(F.rlike(F.replace(bare, F.lit(","), F.lit("")), F.lit(r"^[¥￥]?[0-9]+(?:\.[0-9]+)?$")), F.when(F.contains(bare, F.lit(".")), "decimal_number").otherwise("integer_number"))
        .when(confusable_numeric(bare), "confusable_numeric").when(digit & F.rlike(bare, F.lit("[一-龥]")), "mixed_text_number").when(digit, "numeric_text").otherwise("text")
    )


def column_profiles(cells: DataFrame) -> DataFrame:
    """Per column of cells (page_no, table_index, row_index, col_index, unit_id, text, covered, decision, issue_type): counts, the dominant type
    (the most frequent of cells that aren't empty; in ties the one that comes first in reading order) and evidence."""
    typed = cells.withColumn("kind", value_type(F.col("text")))
    filled = F.col("kind") != "empty"
    each = typed.groupBy(*GRID, "col_index", "kind").agg(
        F.count("*").alias("n"), F.min(F.struct("row_index", "unit_id")).alias("first"), F.count_if(~F.col("covered")).alias("open"), F.count("decision").alias("evidence"),
        F.count_if(F.col("decision") == "confirmed_error").alias("confirmed"), F.count_if(F.col("decision") == "suspected_error").alias("suspected"), F.count_if(F.col("issue_type").isin(*DECIMAL_ISSUES)).alias("decimal"),
    )
    top = F.min(F.when(filled, F.struct((-F.col("n")).alias("n"), "first", "kind")))
    total = lambda c: F.sum(c).alias(c)
    found = each.groupBy(*GRID, "col_index").agg(F.sum("n").alias("cells"), F.coalesce(F.sum(F.when(filled, F.col("n"))), F.lit(0)).alias("nonempty"), top.alias("top"), *map(total, ("open", "evidence", "confirmed", "suspected", "decimal")))
    return found.select(*GRID, "col_index", "cells", "nonempty", F.coalesce("top.kind", F.lit("empty")).alias("dominant_type"), "open", "evidence", "confirmed", "suspected", "decimal")


def anomalies(cells: DataFrame, profiles: DataFrame) -> DataFrame:
    """Cells with evidence of their own, or that look misread: digits with letters like them, or a plain integer in a column
    that has lost decimal points elsewhere."""
    context = profiles.where(F.col("decimal") >= LEAST_DECIMAL).select(*GRID, "col_index", F.lit(True).alias("lossy"))
    seen = cells.join(context, [*GRID, "col_index"], "left")
    plain = F.rlike(normalize(F.col("text")), F.lit("^[0-9]{4,8}$"))
    rule = F.when(confusable_numeric(F.col("text")), "confusable_numeric_text").when(F.col("lossy") & plain, "column_decimal_missing_candidate")
    kind = F.when(F.col("decision").isNotNull(), F.coalesce("issue_type", F.lit("table_cell_evidence"))).otherwise(rule)
    sure = F.when(F.col("decision").isNotNull(), F.col("cell_confidence")).when(kind == "confusable_numeric_text", 0.55).otherwise(0.54)
    out = seen.withColumn("anomaly", kind).where("anomaly is not null")
    return out.select(*GRID, "row_index", "col_index", "unit_id", "anomaly", F.coalesce("decision", F.lit("suspected_error")).alias("decision"), sure.cast("double").alias("confidence"))


def grids(cells: DataFrame, found: DataFrame) -> DataFrame:
    """Per grid: size, cells by state, anomalies, and its status. Cells and anomalies meet in one aggregation."""
    own = cells.select(*GRID, "row_index", "col_index", (value_type(F.col("text")) != "empty").cast("int").alias("full"), (~F.col("covered")).cast("int").alias("open"), F.lit(0).alias("odd"), F.lit(0).alias("confirmed"), F.lit(1).alias("cell"))
    odd = found.select(*GRID, "row_index", "col_index", F.lit(0).alias("full"), F.lit(0).alias("open"), F.lit(1).alias("odd"), (F.col("decision") == "confirmed_error").cast("int").alias("confirmed"), F.lit(0).alias("cell"))
    total = lambda c, name: F.sum(c).alias(name)
    met = own.unionByName(odd).groupBy(*GRID).agg(
        F.max("row_index").alias("rows"), F.max("col_index").alias("columns"), total("cell", "cells"), total("full", "nonempty"), total("open", "unresolved"), total("odd", "anomalies"), total("confirmed", "confirmed")
    )
    status = F.when(F.col("confirmed") > 0, "grid_with_confirmed_errors").when(F.col("anomalies") > 0, "grid_with_suspected_anomalies").when(F.col("unresolved") > 0, "grid_pending_review").otherwise("grid_covered_or_low_risk")
    return met.withColumn("status", status)
