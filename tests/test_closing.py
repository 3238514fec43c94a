"""Coverage states, closers, typed fields and grids on literal rows, with results worked out by hand."""

from pyspark.sql import functions as F

from quillon.operators import closing, grids

EVIDENCE = "unit_id string, kind string, confidence double, detail string"


def ledger(spark, units, rows):
    table = spark.createDataFrame(units, "unit_id string, page_no int, container_type string")
    got = closing.ledger(table, spark.createDataFrame(rows, EVIDENCE))
    return {r.unit_id: (r.status, r.covered, round(r.confidence, 4), r.by, r.n_evidence, r.closed_from) for r in got.collect()}


def test_states_and_closers(spark):
    units = [("a", 1, "body"), ("b", 1, "body"), ("c", 2, "table_row"), ("d", 2, "table_cell"), ("e", 3, "header"), ("f", 3, "body"), ("g", 4, "table_row"), ("h", 4, "body"), ("i", 5, None), ("j", None, "table_row")]
    rows = [
        ("a", "page_text", 0.78, "1"), ("a", "matched", 0.9, "l1"), ("a", "diff", 0.5, None), ("b", "diff", 0.6, None), ("b", "page_text", 0.78, "1"), ("b", "image_text_review", 0.5, "r1"),
        ("c", "mapping_uncertain", 0.5, "l2"), ("c", "table_nearby_page", 0.68, "3"), ("d", "diff", 0.76, None), ("d", "table_same_page", 0.74, "2"), ("e", "page_text_review", 0.9, "r2"), ("e", "image_text_review", 0.95, "r3"),
        ("g", "mapping_uncertain", 0.5, "l3"), ("g", "anomaly", 0.9, None), ("g", "table_same_page", 0.74, "4"), ("g", "page_text_review", 0.1, "r4"), ("h", "table_same_page", 0.74, "4"), ("h", "nearby_page_text", 0.68, "5"), ("h", "nearby_page_text", 0.70, "6"),
        ("unknown", "matched", 1.0, "x"),
    ]
    assert ledger(spark, units, rows) == {
        "a": ("covered", True, 0.9, "matched", 3, None), "b": ("resolved_by_image_text_vl_no_issue", True, 0.74, "image_text_review", 3, "diff_candidate"),
        "c": ("covered_by_nearby_table_page_text_support", True, 0.7, "table_nearby_page", 2, "mapping_uncertain"), "d": ("diff_candidate", False, 0.76, "diff", 2, None),
        "e": ("resolved_by_page_text_qwen_no_issue", True, 0.9, "page_text_review", 2, "low_priority_uncovered"), "f": ("uncovered_docx_content", False, 0.56, None, 0, None),
        "g": ("resolved_by_page_text_qwen_no_issue", True, 0.72, "page_text_review", 4, "mapping_uncertain"), "h": ("covered_by_nearby_page_ocr", True, 0.7, "nearby_page_text", 3, None),
        "i": ("uncovered_docx_content", False, 0.56, None, 0, None), "j": ("table_pending", False, 0.54, None, 0, None),
    }
    assert ledger(spark, [], rows) == {}


def test_fields_and_recall(spark):
    units = spark.createDataFrame([("u1", 3, "合同编号，签订日期 为：1996-03-02"), ("u2", 3, "1996-03-02"), ("u3", 9, "1996-03-02"), ("u4", 9, None)], "unit_id string, page_no int, text string")
    spans = spark.createDataFrame([("u1", "date", 12, 22, "1996-03-02"), ("u2", "date", 0, 10, "1996-03-02"), ("u3", "date", 0, 10, "1996-03-02"), ("u3", "case_no", 2, 4, "x Y")], "unit_id string, entity_type string, start int, end int, text string")
    fields = closing.typed_fields(units, spans)
    assert {(r.unit_id, r.field_type, r.value, r.role) for r in fields.collect()} == {
        ("u1", "date", "1996-03-02", "合同编号，签订日期为："), ("u2", "date", "1996-03-02", "same_aligned_unit"), ("u3", "date", "1996-03-02", "same_aligned_unit"), ("u3", "case_no", "xy", "19"),
    }
    others = spark.createDataFrame([("o1", 2, "date", "1996-03-02"), ("o2", 4, "date", "1996-03-02"), ("o3", 9, "other", "xy")], "other_id string, page_no int, field_type string, value string")
    settled = spark.createDataFrame([("u2",)], "unit_id string")
    got = {(r.unit_id, r.field_type, r.other_id, r.n_fields, r.flag) for r in closing.recall_guard(units, fields, others, settled, 1).collect()}
    assert got == {("u1", "date", "o1", 1, "recall_matched_pdf_field"), ("u3", "date", None, 2, "recall_pdf_field_not_matched")}


def test_grids(spark):
    texts = ["12", "1,234.50", "1996-03-02", "O12", "12号", "a1", "word", " ", None, "1998年3月", "¥15"]
    kinds = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(grids.value_type(F.col("t"))).collect()]
    assert kinds == ["integer_number", "decimal_number", "date", "confusable_numeric", "mixed_text_number", "numeric_text", "text", "empty", "empty", "date", "integer_number"]
    cells = [(1, 1, r, c, f"{r}:{c}", t, True, d, issue, 0.8 if d else None) for r, c, t, d, issue in [
        (1, 1, "A", None, None), (2, 1, "B", None, None), (3, 1, "5", None, None), (1, 2, "1234", "suspected_error", "decimal_point_missing"), (2, 2, "5678", "confirmed_error", "decimal_point_missing"), (3, 2, "9999", None, None), (4, 2, "", None, None), (4, 1, "1O5", None, None)
    ]]
    own = spark.createDataFrame(cells, "page_no long, table_index int, row_index int, col_index int, unit_id string, text string, covered boolean, decision string, issue_type string, cell_confidence double")
    profiles = grids.column_profiles(own)
    assert {(r.col_index, r.cells, r.nonempty, r.dominant_type, r.decimal) for r in profiles.collect()} == {(1, 4, 4, "text", 0), (2, 4, 3, "integer_number", 2)}
    odd = grids.anomalies(own, profiles)
    assert {(r.unit_id, r.anomaly) for r in odd.collect()} == {("1:2", "decimal_point_missing"), ("2:2", "decimal_point_missing"), ("3:2", "column_decimal_missing_candidate"), ("4:1", "confusable_numeric_text")}
    (grid,) = grids.grids(own, odd).collect()
    assert (grid.rows, grid.columns, grid.cells, grid.nonempty, grid.anomalies, grid.confirmed, grid.status) == (4, 2, 8, 7, 4, 1, "grid_with_confirmed_errors")
    assert grids.grids(own.where("false"), odd.where("false")).count() == 0
