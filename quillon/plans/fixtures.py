"""Rules for Chinese documents on literal rows; what they must give was worked out by hand and stands beside them as VALUES."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aliases, identifiers, masks, text
from ..operators import align, coverage, evaluate, recognize, resolve, units, views
from ..sources import docx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _sql(value: object, kind: str) -> str:
    if value is None:
        return f"CAST(NULL AS {kind})"
    shown = "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)
    return f"CAST({shown} AS {kind})"


SQL_TYPES = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def _register(name: str, rows: list[tuple], given: str, result: Callable[[DataFrame], DataFrame], expected: list[tuple], columns: str) -> None:
    """A query that applies result to rows (schema given), held against the expected rows (schema columns)."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return result(spark.createDataFrame(rows, given))

    QUERIES[name] = query
    types = [c.split() for c in columns.split(", ")]
    values = ", ".join("(" + ", ".join(_sql(v, SQL_TYPES[t]) for v, (_, t) in zip(r, types, strict=True)) + ")" for r in expected)
    ORACLES[name] = f"SELECT * FROM (VALUES {values}) AS t({', '.join(chr(34) + c + chr(34) for c, _ in types)})"


def _scalar(name: str, function: Callable[[Column], Column], pairs: list[tuple], kind: str = "string", given: str = "string") -> None:
    """A function of one value on each pair's first, held against its second."""
    rows = [(i, a) for i, (a, _) in enumerate(pairs)]
    _register(name, rows, f"id int, value {given}", lambda d: d.select("id", function(F.col("value")).alias("result")), [(i, b) for i, (_, b) in enumerate(pairs)], f"id int, result {kind}")


def _scalar2(name: str, function: Callable[[Column, Column], Column], rows: list[tuple], kind: str = "string") -> None:
    given = [(i, a, b) for i, (a, b, _) in enumerate(rows)]
    shown = (lambda c: F.round(c, 6)) if kind == "double" else (lambda c: c)
    want = [(i, round(c, 6) if kind == "double" else c) for i, (_, _, c) in enumerate(rows)]
    _register(name, given, "id int, a string, b string", lambda d: d.select("id", shown(function(F.col("a"), F.col("b"))).alias("result")), want, f"id int, result {kind}")


# --- similarity and normal forms ---
_scalar2("similarity_rules", text.similarity, [("", "", 1.0), ("", "x", 0.0), ("合同", "合同", 1.0), ("合同编号", "合同", 0.5), ("abcd efgh", "efgh abcd", 8 / 18), ("abxcd", "abcd", 8 / 9), ("甲乙丙丁", "甲乙戊丁", 0.75)], "double")
_scalar2("text_score_rules", text.text_score, [("甲", "甲", 1.0), ("甲方乙方", "乙方", 0.92), ("", "甲", 0.0), ("甲乙丙丁", "甲乙戊丁", 0.75)], "double")
_scalar("semantic_rules", text.semantic, [("2024年03月05日", "202435"), ("2024-3-05", "202435"), ("（ＡＢ）合同，第〇号", "ａｂ合同第0号"), ("2024部3月", "20243")])
_scalar("clean_candidate_rules", text.clean_candidate, [("  示例\t公司 ", "示例 公司"), ("：示例公司，", "示例公司"), ("", "")])
_scalar("strip_marks_rules", text.strip_marks, [(" 示例：（公司）、", "示例公司、"), ("“甲”", "甲")])
_scalar("page_token_rules", lambda c: F.array_join(text.page_tokens(c), "|"), [("合同编号 abc12", "合同编号|abc12"), ("x", ""), ("示例科技有限公司", "示例科技有限公司|示例科技有限|示例科技|科技有限|有限公司")])

# --- identifiers ---
CASE = "（2023）浙0106民初1234号"
_scalar("case_number_tests", identifiers.is_case_number, [(CASE, True), ("（2023） 浙 0106 民初 1234 号", True), ("2023浙01执恢5号", True), ("HT-2024-001", False), ("", False), (None, False)], "boolean")
_scalar("case_number_extracts", identifiers.case_number, [(f"案号：{CASE}，原告", CASE), ("见（2023） 浙0106 民初12 34号判决", "（2023） 浙0106 民初12 34号"), ("无", ""), (None, "")])
_scalar2("identifier_kinds", identifiers.identifier_kind, [(CASE, None, "case_no"), ("HT-1", "执行 案号", "case_no"), ("HT-1", "合同编号", "contract_no"), (None, None, "contract_no")])
_scalar("label_matches_rules", lambda c: identifiers.label_matches(c, identifiers.CONTRACT_LABELS), [("合 同 编 号：", True), ("本合同号", True), ("编号", False), (None, False)], "boolean")
_scalar("spaced_label_spans", lambda c: F.regexp_extract(c, identifiers.spaced_labels(identifiers.CONTRACT_LABELS), 0), [("一、合  同 编\t号 12", "合  同 编\t号"), ("合同号", "合同号"), ("编号", "")])
_scalar("court_trims", identifiers.court_name, [("不服杭州市中级人民法院", "杭州市中级人民法院"), ("依据判决向西湖区人民法院", "判决向西湖区人民法院"), ("西湖区人民检察院", "西湖区人民检察院"), ("由甲向北京仲裁委员会", "北京仲裁委员会")])
_scalar("numeric_hints", identifiers.numeric_hint, [("12.5O", "12.50"), ("1,2SO.00", ""), ("3.l4 元", "3.14 元"), ("3.x4", ""), ("3.14", "")])
_scalar("joined_dates", identifiers.joined_date, [("2 0 2 4年 3 月1 2日", "2024年3月12日"), ("2024年3月12日", "2024年3月12日"), ("2 0年", "2 0年")])
_scalar("text_hashes", identifiers.text_hash, [("abc", "ba7816bf8f01cfea"), ("", "e3b0c44298fc1c14"), (None, "e3b0c44298fc1c14")])
_scalar("json_answers", lambda c: F.concat_ws("#", identifiers.json_answer(c)["answer"], identifiers.json_answer(c)["error"]), [
    ('见 {"verdict":"ok","reason":"r"} 。', '{"reason": "r", "verdict": "ok"}#'), ('{"a":1}', "json_object_not_final:0"), ("", "empty_response"), ("none", "json_object_not_found"),
    ('```json\n{"decision":"keep","confidence":0.5}\n```', '{"confidence": 0.5, "decision": "keep"}#'), ('{"id":1,"text":"x"}', "json_object_not_final:-24"), ('{"decision":"a"} {"decision":"b"}', '{"decision": "b"}#'),
])
_scalar2("loose_spans_rules", lambda a, b: F.array_join(F.transform(identifiers.loose_spans(a, b), lambda s: F.concat_ws(":", s["start"], s["end"], s["text"])), "|"), [("示例公司与示例公司", "示例公司", "0:4:示例公司|5:9:示例公司"), ("甲 示 例\n公司", "示例公司", "2:8:示 例\n公司"), ("甲", "乙", ""), ("甲", " ", "")])
_register(
    "contract_number_spans", [(1, f"合同编号：HT-2024-001，见{CASE}"), (2, "协议 编号: 甲[2024]第5号\n其他"), (3, "编号：1")], "doc_id long, text string",
    lambda d: recognize.numbered_spans(d).select("doc_id", "start", "end", "text"),
    [(1, 5, 16, "HT-2024-001"), (1, 18, 18 + len(CASE), CASE), (2, 7, 17, "甲[2024]第5号")], "doc_id long, start int, end int, text string",
)

# --- names that stand for others ---
_scalar("person_aliases", masks.person_alias, [("张", "某"), ("张三", "张某"), ("张三丰", "张某丰"), ("欧阳 锋", "欧某锋"), ("", "某")])
_scalar("company_cores", masks.company_alias, [("示例科技", "示某科技"), ("（A）", "（A某）"), ("A B", "A某"), ("（）", "（）某"), ("", "")])
_scalar("company_parts", lambda c: F.concat_ws("|", *[aliases.company_parts(c)[k] for k in ("region", "core", "ending")]), [("北京示例科技有限公司", "北京|示例科技|有限公司"), ("浙江省杭州市示例贸易有限责任公司", "浙江省杭州市|示例贸易|有限责任公司"), ("示例 集团", "|示例|集团"), ("公司", "||公司")])
_scalar("bank_aliases", aliases.bank_alias, [("示例银行朝阳支行", "示某银行朝阳支行"), ("银行", "某银行"), ("杭州市城西信用社", "杭州市城某信用社"), ("", "")])
_scalar("address_aliases", aliases.address_alias, [("浙江省杭州市西湖区文三路1号", "浙江省杭州市西*区某路某号"), ("李家镇3组", "李*镇某村某组"), ("", "某市某区某路某号"), ("杭州市3号", "杭*市某号"), ("1栋2室", "某楼某室")])
_scalar("judicial_aliases", aliases.judicial_alias, [("浙江省杭州市西湖区人民法院", "浙江省杭州市西*区人民法院"), ("西湖区人民法院", "西*区人民法院"), ("最高人民法院", "某人民法院"), ("浙江省高级人民法院", "浙*省高级人民法院"), ("浙江省杭州市中级人民法院", "浙江省杭州市中级人民法院"), ("本院", "本院")])
_scalar("strategies", aliases.strategy, [("official", "official"), (" Serial_Roles ", "serial_roles"), ("symbolic_codes", "symbolic_codes"), ("x", "official"), (None, "official")])
_scalar("upper_amounts", aliases.upper_amount, [(0, "零元整"), (105, "壹佰零伍元整"), (1001, "壹仟零壹元整"), (10000, "壹万元整"), (123456789, "壹亿贰仟叁佰肆拾伍万陆仟柒佰捌拾玖元整"), (20000300, "贰仟万叁佰元整"), (None, None)], given="long")
_scalar("amounts", aliases.amount_value, [("1,234.5万元", 12345000.0), ("人民币壹拾万元整", 110000.0), ("叁仟伍佰元", 3500.0), ("3亿元", 300000000.0), ("无", 100000.0)], "double")
_scalar("alpha_indexes", text.alpha_index, [(0, "A"), (25, "Z"), (26, "AA"), (701, "ZZ"), (702, "AAA"), (475254, "AAAAA"), (-3, "A")], given="long")
# md5 of "x" begins 9dd4e461, which is 2647975009: 1 more than a multiple of 3, 4, 7, 12 and 28
_scalar2("made_up_values", aliases.made_up, [
    ("CN_PHONE", "x", "13947975009"), ("EMAIL_ADDRESS", "x", "contact836@example.com"), ("PROJECT_CODE", "x", "PRJ-2027-509"), ("CN_ID_CARD", "x", "11010119940202509X"), ("DATE", "x", None),
])

# --- recognition, resolution, coverage ---
_register(
    "contract_format_spans", [(1, "电话138 0000 0000，邮箱a.b@示例x.cn"), (2, "价款¥1,200.50元，合人民币壹仟贰佰元整，2024年3月xx日"), (3, "致杭州市西湖区人民法院 91350100M000100Y43")], "doc_id long, text string",
    lambda d: recognize.recognize(d, recognize.CONTRACT_RULES).select("doc_id", "entity_type", "start", "end", "text", "score"),
    [(1, "CN_PHONE", 2, 15, "138 0000 0000", 0.92), (2, "AMOUNT", 2, 12, "¥1,200.50元", 0.86), (2, "AMOUNT", 14, 23, "人民币壹仟贰佰元整", 0.86), (2, "DATE", 24, 34, "2024年3月xx日", 0.88), (3, "COURT", 0, 11, "致杭州市西湖区人民法院", 0.88), (3, "CN_CREDIT_CODE", 12, 30, "91350100M000100Y43", 0.95)],
    "doc_id long, entity_type string, start int, end int, text string, score double",
)
SPANS = "doc_id long, entity_type string, start int, end int, text string, score double, source string"
_register(
    "source_resolution_rules",
    [
        # a format wins over a subject at another place, though its source comes later
        (1, "PERSON", 0, 6, "a", 0.9, "regex"), (1, "CN_PHONE", 3, 14, "b", 0.8, "llm"),
        # of one type the longer wins within two ranks of trust (regex 1, contract 3), not beyond (uie 6)
        (2, "PERSON", 0, 3, "a", 0.9, "regex"), (2, "PERSON", 0, 4, "b", 0.9, "contract"), (3, "PERSON", 0, 3, "a", 0.9, "regex"), (3, "PERSON", 0, 4, "b", 0.9, "uie"),
        # at one place the more specific type wins, then the score
        (4, "ORGANIZATION", 0, 4, "a", 0.95, "regex"), (4, "BANK_NAME", 0, 4, "b", 0.5, "llm"), (5, "PERSON", 0, 4, "a", 0.5, "regex"), (5, "LOCATION", 0, 4, "b", 0.6, "ner"),
        # other overlaps keep the first
        (6, "PERSON", 0, 4, "a", 0.5, "regex"), (6, "LOCATION", 2, 9, "b", 0.9, "ner"),
    ],
    SPANS, lambda d: resolve.by_source(d).select("doc_id", "entity_type", "start", "end", "text", "source"),
    [(1, "CN_PHONE", 3, 14, "b", "llm"), (2, "PERSON", 0, 4, "b", "contract"), (3, "PERSON", 0, 3, "a", "regex"), (4, "BANK_NAME", 0, 4, "b", "llm"), (5, "LOCATION", 0, 4, "b", "ner"), (6, "PERSON", 0, 4, "a", "regex")],
    "doc_id long, entity_type string, start int, end int, text string, source string",
)
_register(
    "priority_resolution_rules",
    [(1, "A", 0, 5, "a", 0.5, "regex", 4), (1, "B", 3, 9, "b", 0.5, "regex", 1), (2, "A", 0, 5, "a", 0.9, "regex", 2), (2, "B", 1, 9, "b", 0.5, "regex", 2), (3, "A", 0, 5, "a", 0.5, "regex", 2), (3, "B", 0, 5, "b", 0.9, "regex", 2), (4, "A", 0, 5, "a", 0.5, "regex", 2), (4, "B", 5, 9, "b", 0.9, "regex", 2)],
    SPANS + ", priority int", lambda d: resolve.by_priority(d).select("doc_id", "entity_type", "start", "end"),
    [(1, "B", 3, 9), (2, "B", 1, 9), (3, "B", 0, 5), (4, "A", 0, 5), (4, "B", 5, 9)], "doc_id long, entity_type string, start int, end int",
)
UNITS = "doc_id long, unit_id string, text string, container_type string, rewritable boolean"
_register(
    "obligation_rules",
    [(1, "a", "开 户 行：示例银行", "body", True), (1, "b", "甲方：示例公司", "table_cell", True), (1, "c", "备注", "table_cell", True), (1, "d", "第一页", "header", False), (1, "e", "由示例科技公司负责", "body", True), (1, "f", "张三先生到场", "body", True), (1, "g", "天气晴朗", "body", True), (1, "h", "天气晴朗", "body", False), (1, "i", "原告李四", "body", True), (1, "j", "（以下简称“甲”）", "footnote", True)],
    UNITS, lambda d: coverage.obligations(d).select("unit_id", "category", "priority", "rewrite_required"),
    [("a", "bank_account_block", "high", False), ("b", "party_block", "high", False), ("c", "table_sensitive_column", "medium", False), ("d", "header_footer_block", "medium", True), ("e", "ordinary_narrative", "medium", False), ("f", "ordinary_narrative", "medium", False), ("h", "boilerplate_low_value", "medium", True), ("i", "legal_caption_block", "high", False), ("j", "definition_block", "high", False)],
    "unit_id string, category string, priority string, rewrite_required boolean",
)
_scalar("canonical_type_rules", coverage.canonical_type, [("SIGNATORY", "PERSON"), ("LEGAL_REPRESENTATIVE", "PERSON"), ("CONTACT_PERSON", "PERSON"), ("COMPANY", "ORGANIZATION"), ("ORG", "ORGANIZATION"), ("LOCATION", "ADDRESS"), ("CASE_NO", "CASE_NO")])

# --- views, labels, names, merging, edges, routes ---
_scalar("recognition_views", views.recognition_view, [("示 例 公司", "示例公司"), ("a b", "a b"), ("A 公司", "A公司"), ("12 a 3", "12a3"), ("甲\n 乙", "甲\n 乙"), ("，  甲", "，  甲"), ("", "")])
_register(
    "original_spans", [(0, "示 例 公司", 0, 4), (1, "示 例 公司", 1, 3), (2, "abc", 1, 2), (3, "示 例", 0, 3), (4, "示 例", 1, 1), (5, "a  1 b", 1, 3)], "id int, text string, s int, e int",
    lambda d: d.withColumn("x", views.original_span(F.col("text"), F.col("s"), F.col("e"))).select("id", F.col("x.start").alias("start"), F.col("x.end").alias("end")),
    [(0, 0, 6), (1, 2, 5), (2, 1, 2), (3, None, None), (4, None, None), (5, 3, 6)], "id int, start int, end int",
)
UNIT_TEXT = "姓名\n张三\n姓名\n李 四\n末"
_register(
    "unit_resolution_rules", [(1, "a", 0, "姓名", 0, 2), (1, "b", 1, "张三", 9, 11), (1, "c", 2, "姓名", None, None), (1, "d", 3, "李四", None, None), (1, "e", 4, "", 0, 0), (1, "f", 5, "无", 0, 1)], "doc_id long, unit_id string, order_index int, text string, start int, end int",
    lambda d: views.resolved_units(d.sparkSession.createDataFrame([(1, UNIT_TEXT), (2, None)], "doc_id long, text string"), d),
    [(1, "a", 0, 2, "exact"), (1, "b", 3, 5, "ordered_forward"), (1, "c", 6, 8, "ordered_forward"), (1, "d", 9, 12, "sanitized_ordered_forward"), (1, "e", -1, -1, "missing_text"), (1, "f", -1, -1, "unresolved")],
    "doc_id long, unit_id string, start int, end int, resolution string",
)
_register(
    "token_entity_rules",
    [(1, i, s, e, label, 0.5 + i / 100) for i, (s, e, label) in enumerate([(0, 1, "B-per"), (1, 2, "I-PER"), (2, 2, "O"), (2, 3, "I-PER"), (3, 4, "O"), (4, 5, "I-ORG"), (5, 6, "I-LOC"), (6, 7, "S-LOC"), (7, 8, "I-LOC"), (8, 9, "MISC"), (9, 10, "X-MISC"), (10, 11, None)])],
    "doc_id long, place int, start int, end int, label string, score double",
    lambda d: views.token_entities(d).select("doc_id", "entity_type", "start", "end", F.round("score", 4).alias("score")),
    [(1, "PER", 0, 3, 0.5133), (1, "ORG", 4, 5, 0.55), (1, "LOC", 5, 6, 0.56), (1, "LOC", 6, 7, 0.57), (1, "LOC", 7, 8, 0.58), (1, "MISC", 8, 9, 0.59), (1, "MISC", 9, 10, 0.6)],
    "doc_id long, entity_type string, start int, end int, score double",
)
_register(
    "definition_span_rules", [(1, "示例科技有限公司（以下简称“示例”）与杭州法院 (下称 杭法) 。"), (2, "示例（简称甲）")], "doc_id long, text string", lambda d: views.definition_spans(d),
    [(1, "ORGANIZATION", 0, 8, "示例科技有限公司", 0.92, "示例科技有限公司"), (1, "ALIAS", 14, 16, "示例", 0.9, "示例科技有限公司"), (1, "GOVERNMENT", 18, 23, "与杭州法院"[0:5], 0.92, "与杭州法院"), (1, "ALIAS", 28, 30, "杭法", 0.9, "与杭州法院")],
    "doc_id long, entity_type string, start int, end int, text string, score double, canonical string",
)
_scalar("natural_names", lambda c: views.natural_name(c, ("张", "李"), ("欧阳", "诸葛")), [("张三", True), ("李 四光", True), ("欧阳锋", True), ("欧阳", False), ("欧阳一二三", False), ("王五", False), ("阿里·买买提", True), ("张", False), (None, False)], "boolean")
_scalar("org_cores", views.org_core, [("北京示例科技有限公司", "示例科技"), ("杭州市西湖区示例贸易有限责任公司", "示例贸易"), ("示例银行", "示例"), ("甲公司", "")])
_scalar("org_brands", views.org_brand, [("北京示例科技有限公司", "示例"), ("示例信息技术有限公司", "示例"), ("科技公司", "科技"), ("甲乙公司", "甲乙")])
_scalar("noise_scores", views.noise_score, [("示例公司", 0), ("联系人：张三", 5), ("张为", 2), ("账号123456", 4), ("统一社会信用代码", 6)], "int")
_register(
    "subject_edge_rules",
    [(1, "s1", 0, "organization", "K1", ["示例科技有限公司"]), (1, "s2", 5, "organization", "K1", ["示例"]), (1, "s3", 9, "organization", "", ["示例 科技有限公司", "甲"]), (1, "s4", 12, "organization", "LEDGER::1", ["北京示例贸易公司"]), (1, "s5", 15, "person", "LEDGER::1", ["示例"]), (2, "t1", 0, "organization", "K1", ["示例"])],
    "doc_id long, subject_id string, place int, family string, canonical_key string, surfaces array<string>", lambda d: views.subject_edges(d),
    [(1, "s2", "s1", "same_canonical_key", 1.0, "confirmed"), (1, "s3", "s1", "same_surface", 0.92, "observed"), (1, "s4", "s1", "same_brand", 0.8, "needs_adjudication")],
    "doc_id long, source_id string, target_id string, relation string, confidence double, status string",
)
_register(
    "recall_merge_rules",
    [
        (1, "ORGANIZATION", 0, 8, "a", 0.9, "rule_organization", 3), (1, "CN_PHONE", 4, 15, "b", 0.5, "ner", 0),  # a format wins
        (2, "PERSON", 0, 3, "张三为", 0.9, "rule_person", 0), (2, "PERSON", 0, 2, "张三", 0.5, "contract_structure_backfill", 0),  # less noise, trust within 5
        (3, "PERSON", 0, 3, "张三为", 0.9, "rule_person", 0), (3, "PERSON", 0, 2, "张三", 0.5, "uie", 0),  # less noise, but far less trust
        (4, "ORGANIZATION", 0, 8, "示例科技有限公司", 0.6, "uie", 3), (4, "LOCATION", 0, 2, "示例", 0.9, "custom", 0),  # an organisation takes in a place
        (5, "PERSON", 0, 4, "a", 0.5, "uie", 0), (5, "ALIAS", 2, 6, "b", 0.9, "rule_alias", 0),  # the trusted one comes first and stays
        (6, "ORGANIZATION", 0, 4, "示例公司", 0.9, "uie", 1), (6, "ORGANIZATION", 0, 6, "示例公司付款", 0.8, "uie", 1),  # noise of the longer
    ],
    SPANS + ", strength int", lambda d: views.recall_merge(d).select("doc_id", "entity_type", "start", "end", "source"),
    [(1, "CN_PHONE", 4, 15, "ner"), (2, "PERSON", 0, 2, "contract_structure_backfill"), (3, "PERSON", 0, 3, "rule_person"), (4, "ORGANIZATION", 0, 8, "uie"), (5, "ALIAS", 2, 6, "rule_alias"), (6, "ORGANIZATION", 0, 4, "uie")],
    "doc_id long, entity_type string, start int, end int, source string",
)
_register(
    "must_keep_rules",
    [(0, "PERSON", {}), (1, "DATE", {"subject_ledger_status": "hard_conflict"}), (2, "PERSON", {"rule_first_action": "keep"}), (3, "DATE", {"rule_first_action": "keep"}), (4, "DATE", {"rule_first_action": "review"}), (5, "DATE", {"candidate_types": "PERSON"}), (6, "DATE", {"subject_ledger_status": "final"}), (7, "DATE", None)],
    "id int, entity_type string, metadata map<string,string>", lambda d: d.select("id", views.must_keep(d).alias("kept")), [(0, False), (1, True), (2, True), (3, False), (4, True), (5, True), (6, False), (7, False)], "id int, kept boolean",
)


# --- packages ---
def _package(**parts: str) -> bytearray:
    """A DOCX package of parts: paragraphs of runs, which | and / part."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            body = "".join("<w:p>" + "".join("<w:r><w:tab/></w:r>" if run == "TAB" else f"<w:r><w:t>{run}</w:t></w:r>" for run in p.split("|")) + "</w:p>" for p in text.split("/"))
            z.writestr(f"word/{name}.xml", f'<w:x xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">{body}</w:x>')
    return bytearray(out.getvalue())


EDITS = "array<struct<start:int,end:int,source:string,replacement:string>>"
_register(
    "docx_rewrite_rules",
    [
        (1, _package(document="甲方：示|例科|技公司/电话138", header1="页眉张三"), [(3, 7, "示例科技", "某某"), (18, 20, "张三", "张某")]),
        (2, _package(document="甲方|TAB|乙方"), [(0, 2, "甲方", "A"), (1, 4, "方\t乙", "x"), (9, 3, "", "x"), (3, 5, "丙方", "y")]),
        (3, _package(document="a|TAB|b"), [(0, 3, "a\tb", "x")]), (4, bytearray(b"no zip"), [(0, 1, "n", "x")]), (5, _package(document="甲/乙"), [(0, 3, "甲\n乙", "x")]), (6, _package(document="甲"), None),
    ],
    f"doc_id long, content binary, edits {EDITS}", lambda d: d.select("doc_id", docx.rewritten(F.col("content"), F.col("edits")).alias("x")).select("doc_id", "x.done", F.array_join("x.failed", ",").alias("failed"), "x.text"),
    [(1, 2, "", "甲方：某某公司\n电话138\n页眉张某"), (2, 1, "1:range_overlap,3:source_range_mismatch,9:invalid_range", "A\t乙方"), (3, 0, "0:unrewritable", "a\tb"), (4, 0, "damaged_package", ""), (5, 0, "0:not_in_one_unit", "甲\n乙"), (6, 0, "", "甲")],
    "doc_id long, done int, failed string, text string",
)
_register(
    "docx_string_rules", [(1, _package(document="示例|公司与示例/示例公司")), (2, _package(document="无", footer1="示例"))], "doc_id long, content binary",
    lambda d: d.select("doc_id", docx.replaced_strings(F.col("content"), [("示例", "示例某"), ("示例公司", "甲")]).alias("x")).select("doc_id", "x.done", "x.text"),
    [(1, 3, "甲与示例某\n甲"), (2, 1, "无\n示例某")], "doc_id long, done int, text string",
)
_register(
    "docx_coverage_rules", [(1, _package(document="甲 方", extra="乙", styles="")), (2, bytearray(b"x"))], "doc_id long, content binary",
    lambda d: d.select("doc_id", F.inline(docx.coverage(F.col("content")))), [(1, "word/document.xml", 2, 2), (1, "word/extra.xml", 1, 1)], "doc_id long, part string, visible int, covered int",
)

# --- alignment, evaluation, segments ---
_register(
    "align_score_rules",
    [(0, "ab", "ab", 0, 0, 5), (1, "abcd", "abxd", 1, 0, 5), (2, "aaaa", "bbbb", 2, 1, 5), (3, "abcd", "ab", 0, 0, 5), (4, "abcd", "ab", 0, 0, 1), (5, "aaaa", "bbbb", 9, 0, 5), (6, "aaaa", "bbbb", 9, 5, 5), (7, "aaaa", "bbbb", 9, 5, -1), (8, "", "b", 0, 0, 5)],
    "id int, a string, b string, shared int, hard int, apart int", lambda d: d.select("id", align.score(F.col("a"), F.col("b"), F.col("shared"), F.col("hard"), F.col("apart")).alias("score")),
    [(0, 1.0), (1, 0.75), (2, 0.79), (3, 0.5), (4, 0.53), (5, 0.98), (6, 0.99), (7, 1.0), (8, 0.0)], "id int, score double",
)


def _walk(pairs: list[tuple]) -> list[tuple]:
    """The plain greedy walk over all pairs by falling score, then ids."""
    left, right, out = set(), set(), []
    for a, b, score in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            out.append((a, b, score, "matched" if score >= align.MATCHED else "mapping_uncertain"))
    return out


CHAIN = [(f"p{i:02d}", f"q{i:02d}", round(0.99 - 0.02 * i, 2)) for i in range(12)] + [(f"p{i + 1:02d}", f"q{i:02d}", round(0.98 - 0.02 * i, 2)) for i in range(12)]
LINKS = [("a1", "b1", 0.9), ("a1", "b2", 0.95), ("a2", "b1", 0.8), ("a2", "b2", 0.94), ("a3", "b3", 0.5), ("a3", "b1", 0.5), *[(f"c{i}", f"d{j}", 0.9) for i in range(3) for j in range(2)], *CHAIN]
_register("greedy_link_rules", LINKS, "left_id string, right_id string, score double", align.assign, _walk(LINKS), "left_id string, right_id string, score double, status string")
ENTITY = "id string, doc_id long, entity_type string, text string, start int, end int"
_register(
    "entity_outcome_rules", [("e1", 1, "PERSON", "张三", 0, 2), ("e2", 1, "ORGANIZATION", "示例公司", 5, 9), ("e3", 1, "LOCATION", "北京", 12, 14), ("e4", 1, "PERSON", "李四", 30, 32), ("e5", 1, "PERSON", "王五", 40, 42), ("e6", 2, "PERSON", "张三", 0, 2)], ENTITY,
    lambda d: evaluate.entity_outcomes(d, d.sparkSession.createDataFrame([("a1", 1, "PERSON", "张三", 0, 2), ("a2", 1, "PERSON", "示例公司", 5, 9), ("a3", 1, "ORGANIZATION", "北京", 20, 22), ("a4", 1, "PERSON", "四某", 31, 33), ("a5", 1, "DATE", "2024", 50, 54)], ENTITY)),
    [("e1", "a1", "exact"), ("e2", "a2", "type_error"), ("e3", "a3", "type_error"), ("e4", "a4", "boundary_error"), ("e5", None, "missed"), ("e6", None, "missed"), (None, "a5", "false_positive")], "e_id string, a_id string, outcome string",
)
_register(
    "soft_segment_rules", [(1, "a", 100, "甲甲甲甲甲，乙乙乙乙乙乙"), (1, "b", 0, "甲" * 10), (1, "c", 7, "甲甲")], "doc_id long, unit_id string, start int, text string",
    lambda d: units.soft_segments(d, 8, 2).select("unit_id", "segment", "start", "end"), [("a", 0, 100, 106), ("a", 1, 106, 112), ("b", 0, 0, 8), ("b", 1, 6, 10), ("c", 0, 7, 9)], "unit_id string, segment int, start int, end int",
)
