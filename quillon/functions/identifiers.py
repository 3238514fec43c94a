"""Contract and case numbers, labels, digits that were misread, JSON in answers of models, spans across white space."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import compact

#: Labels of contract and of case numbers, and the courts' case words.
CONTRACT_LABELS = ("合同编号", "合同号", "协议编号", "项目编号", "招标编号")
CASE_LABELS = (
    "案号", "案件编号", "受理案号", "执行案号", "原审案号", "一审案号", "二审案号", "再审案号", "上诉案号", "审理案号", "申请执行案号", "民事案号", "刑事案号", "行政案号", "仲裁案号",
)
CASE_WORDS = "民(?:初|终|再|申|辖终|辖初|保|特)|刑(?:初|终|申)|行(?:初|终|审|申)|执(?:恢|保|异|监|行|前调)?|知(?:民初|民终|行终|行初|民辖终)|破(?:申|初)?|清(?:申|算)?|仲|财保|审监"
BRACKETED_YEAR = r"[（(〔\[【〖]\s*[0-9]{4}\s*[）)〕\]】〗]"
#: A year, a court, a case word and a number; the parts may stand apart.
CASE_NUMBER = rf"(?:{BRACKETED_YEAR}|20[0-9]{{2}})\s*[A-Za-z一-龥]{{1,12}}\s*[0-9]{{0,8}}\s*(?:{CASE_WORDS})\s*[0-9]{{1,8}}(?:\s*之[一-龥0-9]+)?\s*号?"


def spaced_labels(labels: tuple[str, ...]) -> str:
    """A pattern of labels whose characters may stand apart, the longest first."""
    known = sorted({x.strip() for x in labels if x.strip()}, key=lambda x: (-len(x), x))
    return "|".join("(?:" + r"\s*".join(re.escape(c) for c in x) + ")" for x in known)


def label_matches(label: Column, labels: tuple[str, ...]) -> Column:
    """Whether a label holds one of labels, white space aside."""
    plain = compact(F.coalesce(label, F.lit("")))
    return F.exists(F.array(*[F.lit("".join(x.split())) for x in labels if x]), lambda x: F.contains(plain, x))


def is_case_number(value: Column) -> Column:
    return F.coalesce(compact(value).rlike(f"^(?:{CASE_NUMBER})$"), F.lit(False))


def case_number(value: Column) -> Column:
    """The first case number in value, as it is written there, gaps included; empty if there is none."""
    found = F.regexp_extract(compact(F.coalesce(value, F.lit(""))), f"({CASE_NUMBER})", 1)
    return F.coalesce(F.get(loose_spans(value, found), F.lit(0))["text"], F.lit(""))


def identifier_kind(value: Column, label: Column) -> Column:
    return F.when(label_matches(label, CASE_LABELS) | is_case_number(value), "case_no").otherwise("contract_no")


#: A labelled contract or case number up to the end of its field, or a case number anywhere.
NUMBERED = rf"(?:(?:{spaced_labels(CONTRACT_LABELS + CASE_LABELS)})\s*[:：]\s*[A-Za-z0-9一-龥\-\[\]〔〕（）()/. ]{{4,}}?(?=$|[\r\n\t,，;；])|{CASE_NUMBER})"


def numbered_value(match: Column) -> Column:
    """Of a match of NUMBERED the number alone, which is its end."""
    return F.regexp_replace(match, rf"^(?:{spaced_labels(CONTRACT_LABELS + CASE_LABELS)})\s*[:：]\s*", "")


#: Words before the name of a court that aren't part of it.
BEFORE_COURT = ("根据", "依据", "不服", "此致", "提交", "向", "至", "由")


def court_name(match: Column) -> Column:
    """A court's name without what stands before it: cut after the last place of the first such word that leaves a court."""
    out = match
    for word in reversed(BEFORE_COURT):
        rest = F.substring_index(match, word, -1)
        out = F.when(F.contains(match, F.lit(word)) & rest.rlike("(?:人民法院|仲裁委员会|人民检察院)$"), rest).otherwise(out)
    return out


#: Letters that figures are misread as.
CONFUSED, MEANT = "OoDBbIiLlSsZz", "0008811115522"


def numeric_hint(text: Column) -> Column:
    """What a figure with misread letters after its point may mean; empty if letters stand elsewhere, or some remain."""
    one = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    plain = compact(text)
    whole, fraction = F.regexp_extract(plain, r"^(.*)\.[^.]*$", 1), F.regexp_extract(plain, r"^.*\.([^.]*)$", 1)
    fits = F.contains(plain, F.lit(".")) & ~whole.rlike("[A-Za-z]") & fraction.rlike("[A-Za-z]")
    hint = F.translate(one, CONFUSED, MEANT)
    return F.when(fits & ~hint.rlike("[A-Za-z]"), hint).otherwise("")


def joined_date(text: Column) -> Column:
    """A date whose digits stand apart, without the gaps; other texts as they are."""
    apart = text.rlike(r"^\s*(?:[0-9]\s*){4}年\s*(?:[0-9]\s*){1,2}月\s*(?:[0-9]\s*){1,2}日\s*$") & text.rlike(r"[0-9]\s+[0-9]")
    return F.when(apart, compact(text)).otherwise(text)


def text_hash(text: Column) -> Column:
    return F.left(F.sha2(F.coalesce(text, F.lit("")), 256), F.lit(16))


def loose_spans(text: Column, value: Column) -> Column:
    """array<struct<start,end,text>> of the places of value in text: exact ones, or, if there are none, those that differ in
    white space alone. In Arrow batches."""

    def places(where: str | None, what: str | None) -> list[dict]:
        if not where or not what:
            return []
        found = [m.span() for m in re.finditer(re.escape(what), where)]
        if not found and (parts := "".join(what.split())):
            at = [i for i, c in enumerate(where) if not c.isspace()]
            tight = "".join(where[i] for i in at)
            found = [(at[m.start()], at[m.end() - 1] + 1) for m in re.finditer(re.escape(parts), tight)]
        return [{"start": a, "end": b, "text": where[a:b]} for a, b in found]

    @F.pandas_udf("array<struct<start:int,end:int,text:string>>")
    def spans(texts: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([places(t, v) for t, v in zip(texts, values, strict=True)])

    return spans(text, value)


#: What the keys of an answer are worth. An answer is final from 3 on.
JSON_WORTH = {"verdict": 14, "decision": 8, "suspicious_values": 12, "reason": 5, "confidence": 4, "next_route": 3, "visible_text_excerpt": 3}
JSON_LEAST = 3


def _worth(found: dict) -> int:
    keys = set(map(str, found))
    worth = sum(v for k, v in JSON_WORTH.items() if k in keys)
    worth += 4 * bool(isinstance(found.get("suspicious_values"), list) and found["suspicious_values"])
    worth += 3 * bool(keys & {"preferred_text", "visible_text"}) + 12 * ({"docx_text", "visible_text"} <= keys) + 4 * ({"issue_type", "severity"} <= keys)
    if keys:
        worth -= 30 * (keys <= {"max_suspicious_values", "row_col_type"})
        worth -= 24 * (keys <= {"id", "sample_id", "unit_id", "text", "cat", "status", "row", "col", "row_text"})
        worth -= 24 * (keys <= {"page_no", "unresolved_table_cell_count", "pdf_table_signal", "image_orientation", "docx_samples", "output_limits", "rules"})
    return worth - 12 * bool(keys & {"docx_samples", "rules", "output_limits"})


def json_answer(text: Column) -> Column:
    """struct<answer, error>: of all objects that begin anywhere in a model's answer (a code block, a thought, other text) the
    one that is worth most, the last of equals, with keys in order. In Arrow batches."""

    def best(value: str | None) -> tuple[str | None, str]:
        value = (value or "").strip()
        if not value:
            return None, "empty_response"
        decoder, top = json.JSONDecoder(), None
        for start in [i for i, c in enumerate(value) if c == "{"]:
            try:
                found, _ = decoder.raw_decode(value, start)
            except json.JSONDecodeError:
                continue
            if top is None or _worth(found) >= top[0]:
                top = _worth(found), found
        if top is None:
            return None, "json_object_not_found"
        if top[0] < JSON_LEAST:
            return None, f"json_object_not_final:{top[0]}"
        return json.dumps(top[1], ensure_ascii=False, sort_keys=True), ""

    @F.pandas_udf("struct<answer:string,error:string>")
    def parse(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([best(t) for t in texts], columns=["answer", "error"], dtype=object)

    return parse(text)
