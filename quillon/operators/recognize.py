"""Recognizers: text to spans, from tables of rules.

A rule is a type, a pattern, a score and a priority; the text of a rule is matched by built-in functions, and all rules of a
table run over one scan of the documents. Spans are half-open in code points: doc_id, entity_type, start, end, text, score,
source, priority.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers
from ..functions.text import compact, matches, valid_credit_code, valid_id_number, validation


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    score: float
    priority: int = 9
    #: spans whose text fails are dropped
    test: object = field(default=None, compare=False)


#: Formats, scores and priorities of identifiers in contracts.
CONTRACT_RULES = (
    Rule("CN_ID_CARD", r"(?<!\d)[1-9]\d{5}(?:18|19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx](?!\d)", 0.95, 1),
    Rule("CN_PHONE", r"(?<!\d)1[3-9]\d(?:[ \t\u00a0\-－—–]?\d{4}){2}(?!\d)", 0.92, 2),
    Rule("LANDLINE_PHONE", r"(?<!\d)(?:0\d{2,3}[-－—–]\d{7,8}|0\d{9,11}|400[-－—–]\d{3}[-－—–]\d{4}|400\d{7})(?!\d)", 0.88, 3),
    Rule("CN_CREDIT_CODE", r"(?<![0-9A-Z])(?!\d{18}(?![0-9A-Z]))[0-9A-HJ-NPQRTUWXY]{18}(?![0-9A-Z])", 0.95, 1),
    Rule("CN_BANK_CARD", r"(?<!\d)\d{16,20}(?!\d)", 0.90, 4),
    Rule("COURT", r"[一-龥]{2,40}(?:人民法院|仲裁委员会|人民检察院)", 0.88, 6),
    Rule("EMAIL_ADDRESS", r"(?<![\w.-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?![\w.-])", 0.92, 2),
    Rule("AMOUNT", r"(?:[¥￥]\s*)?\d[\d,]*(?:\.\d+)?\s*(?:亿元|万元|元|万|亿)|(?:人民币)?[零〇一二两三四五六七八九十百千万亿壹贰叁肆伍陆柒捌玖拾佰仟]+(?:元|圆)(?:整|正)?", 0.86, 5),
    Rule("DATE", r"(?:\d{4}[年/-]\d{1,2}[月/-](?:\d{1,2}|xx|XX)[日号]?|\d{4}年\d{1,2}月(?:\d{1,2}|xx|XX)日?)", 0.88, 5),
)
#: The same kinds in Latin text.
LATIN_RULES = (
    Rule("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0.92, 2),
    Rule("BANK_CARD", r"\b[0-9]{16}\b", 0.90, 4),
    Rule("PHONE", r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", 0.92, 2),
    Rule("IP_ADDRESS", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", 0.88, 3),
    Rule("SECRET", r"\b[0-9a-f]{40}\b", 0.95, 1),
)
#: Labels left of a number that say what it is.
CREDIT_LABELS = ("统一社会信用代码", "社会信用代码", "信用代码")
ID_LABELS = ("身份证号码", "身份证号", "公民身份号码", "公民身份证号码")
ACCOUNT_LABELS = ("银行账号", "银行账户", "账号", "帐号", "账户号码", "账户号", "账户", "收款账号", "收款账户", "付款账号", "付款账户")

SPAN = ("doc_id", "entity_type", "start", "end", "text", "score", "source", "priority")


def recognize(docs: DataFrame, rules: tuple[Rule, ...], kinds: list[str] | None = None, source: str = "regex") -> DataFrame:
    """Spans of all rules, or of those of the kinds asked for: other patterns are not run."""
    chosen = [r for r in rules if kinds is None or r.kind in kinds]
    if not chosen:
        return docs.select("doc_id", "text").where("false").select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in zip(SPAN[1:], ("string", "int", "int", "string", "double", "string", "int"), strict=True)])
    def found(rule: Rule) -> Column:
        span = lambda m: F.struct(F.lit(rule.kind).alias("entity_type"), m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), F.lit(rule.score).alias("score"), F.lit(source).alias("source"), F.lit(rule.priority).alias("priority"))
        return F.transform(matches(F.col("text"), rule.pattern), span)

    each = [found(r) for r in chosen]
    # a document that no pattern can match is left before offsets are worked out
    hit = F.col("text").rlike("|".join(f"(?:{r.pattern})" for r in chosen))
    return docs.select("doc_id", "text").where(hit).select("doc_id", F.inline(F.concat(*each))).select(*SPAN)


def checked(spans: DataFrame) -> DataFrame:
    """Without identity numbers and credit codes whose check digit is wrong; scores at least the format's confidence."""
    v = validation(F.col("entity_type"), F.col("text"))
    wrong = (F.col("entity_type") == "CN_ID_CARD") & ~valid_id_number(F.upper("text")) | (F.col("entity_type") == "CN_CREDIT_CODE") & ~valid_credit_code(F.col("text"))
    return spans.where(~wrong).withColumn("score", F.greatest("score", v["confidence"]))


def relabelled(spans: DataFrame, docs: DataFrame, left: int = 24) -> DataFrame:
    """Numbers take the type that a label within ``left`` characters before them names; a credit code's label goes first.
    A number of 20 digits without an account's label is dropped."""
    near = compact(F.substr("whole", F.greatest(F.col("start") - left, F.lit(0)) + 1, F.least(F.col("start"), F.lit(left))))
    labelled = lambda labels: near.rlike("|".join(map(re.escape, labels)))
    number = F.col("entity_type").isin("CN_BANK_CARD", "CN_ID_CARD", "CN_CREDIT_CODE")
    kind = F.when(number & labelled(CREDIT_LABELS), "CN_CREDIT_CODE").when(number & labelled(ID_LABELS), "CN_ID_CARD").otherwise(F.col("entity_type"))
    lost = (F.col("entity_type") == "CN_BANK_CARD") & (F.length("text") == 20) & ~labelled(ACCOUNT_LABELS)
    joined = spans.join(docs.select("doc_id", F.col("text").alias("whole")), "doc_id").where(~lost)
    return joined.withColumn("entity_type", kind).select(*SPAN)


def keywords(docs: DataFrame, words: dict[str, tuple[list[str], float]]) -> DataFrame:
    """Spans of custom keywords: type to words and score. Blank words and repeated ones don't count."""
    rules = tuple(
        Rule(kind, "|".join(rf"\Q{w}\E" for w in sorted({w.strip() for w in own if w.strip()}, key=lambda w: (-len(w), w))), score)
        for kind, (own, score) in words.items() if any(w.strip() for w in own)
    )
    return recognize(docs, rules, source="custom")


def custom_patterns(docs: DataFrame, patterns: list[dict]) -> DataFrame:
    """Spans of custom patterns; those that aren't valid, or match the empty text, are skipped."""
    jvm = docs.sparkSession.sparkContext._jvm
    rules = []
    for p in patterns:
        try:
            if not jvm.java.util.regex.Pattern.compile(p["regex"]).matcher("").matches():
                rules.append(Rule(p["name"].strip().upper(), p["regex"], float(p.get("score", 0.9))))
        except Exception:  # noqa: BLE001, S112  the JVM says why; a bad rule doesn't stop the others
            continue
    return recognize(docs, tuple(rules), source="custom")


def numbered_spans(docs: DataFrame) -> DataFrame:
    """Contract and case numbers after their labels, and case numbers anywhere: doc_id, start, end, text of the number alone."""
    found = docs.select("doc_id", F.explode(matches(F.col("text"), identifiers.NUMBERED)).alias("m"))
    value = identifiers.numbered_value(F.col("m.text"))
    return found.select("doc_id", (F.col("m.end") - F.length(value)).alias("start"), F.col("m.end").alias("end"), F.trim(value).alias("text"))


def aliases(docs: DataFrame) -> DataFrame:
    """Definitions of short names, 全称（以下简称“X”）: doc_id, canonical, alias."""
    pattern = r"([一-龥A-Za-z0-9（）()]{4,60}?)[（(](?:以下)?简称[：:]?[“\"'‘]?([一-龥A-Za-z0-9]{2,20})[”\"'’]?[）)]"
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("canonical"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("alias"))
    return docs.select("doc_id", F.inline(pairs))


def fields(docs: DataFrame) -> DataFrame:
    """label: value pairs of lines, cut at tabs and runs of spaces: doc_id, line, part, label, value."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "whole"))
    parts = lines.select("doc_id", "line", F.posexplode(F.split("whole", r"\t| {2,}")).alias("part", "piece"))
    cut = r"^\s*([^:：]{1,20}?)\s*[:：]\s*(\S.*?)\s*$"
    found = parts.select("doc_id", "line", "part", F.regexp_extract("piece", cut, 1).alias("label"), F.regexp_extract("piece", cut, 2).alias("value"))
    return found.where("label <> ''")


def of_layer(source: Column) -> Column:
    """The layer of a source, by its name."""
    s = F.lower(source)
    return (
        F.when(s.rlike("regex|custom|pattern"), "regex").when(s.rlike("structure|contract"), "structure").when(s.rlike("uie"), "uie")
        .when(s.rlike("ner"), "ner").when(s.rlike("review|llm"), "llm").when(s.rlike("alias|propagat"), "propagation").otherwise("unknown")
    )
