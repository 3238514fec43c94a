"""Texts as recognizers see them, places in them found again, token labels as spans, names by shape, merging for recall, edges
between subjects, routes for review."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bind, compact, matches, strip_marks
from .resolve import _fold, ranked

#: A run of white space inside a line between letters, digits or ideographs, one of which is a digit or an ideograph.
INTRUSIVE = r"(?U)(?:(?<=[一-龥0-9])[^\S\r\n]+(?=[一-龥A-Za-z0-9])|(?<=[A-Za-z])[^\S\r\n]+(?=[一-龥0-9]))"


def recognition_view(text: Column) -> Column:
    """Text without intrusive white space; line breaks stay."""
    return F.regexp_replace(text, INTRUSIVE, "")


def original_span(text: Column, start: Column, end: Column) -> Column:
    """struct<start, end> in text of a span of its recognition view; null for an empty span or one beyond the view."""
    gaps = matches(text, INTRUSIVE)

    def place(at: Column) -> Column:
        # each gap that begins no later than the place moves it on by its length
        return F.aggregate(gaps, at, lambda now, g: F.when(g["start"] <= now, now + g["end"] - g["start"]).otherwise(now))

    known = (start >= 0) & (end > start) & (end <= F.length(recognition_view(text)))
    return F.when(known, F.struct(place(start).alias("start"), (place(end - 1) + 1).alias("end")))


def resolved_units(docs: DataFrame, units: DataFrame) -> DataFrame:
    """Where units (doc_id, unit_id, order_index, text, start, end) stand in texts, in order: at their own place if the text
    is there (exact), else the next place after the unit before (ordered_forward), else the same without intrusive
    white space (sanitized_ordered_forward); others are unresolved or have no text. A document is one row."""
    import re

    gap = re.compile(r"(?:(?<=[一-龥0-9])[^\S\r\n]+(?=[一-龥A-Za-z0-9])|(?<=[A-Za-z])[^\S\r\n]+(?=[一-龥0-9]))")
    own = units.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("order_index", "unit_id", "text", "start", "end"))).alias("units"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(own, "doc_id")

    def walk(text: str, parts: list[dict]) -> Iterator[tuple]:
        cursor, view, places = 0, None, []
        for u in parts:
            want, start, end = u["text"] or "", u["start"], u["end"]
            how, at = "unresolved", None
            if not want:
                how = "missing_text"
            elif start is not None and end is not None and 0 <= start < end <= len(text) and text[start:end] == want:
                how, at = "exact", (start, end)
            elif (found := text.find(want, cursor)) >= 0:
                how, at = "ordered_forward", (found, found + len(want))
            else:
                if view is None:
                    cut = [False] * len(text)
                    for m in gap.finditer(text):
                        cut[m.start() : m.end()] = [True] * (m.end() - m.start())
                    places = [i for i in range(len(text)) if not cut[i]]
                    view = "".join(text[i] for i in places)
                plain = gap.sub("", want)
                # a cursor within a gap counts as the beginning
                after = next((i for i, p in enumerate(places) if p == cursor), 0)
                found = view.find(plain, after) if plain else -1
                if found >= 0:
                    how, at = "sanitized_ordered_forward", (places[found], places[found + len(plain) - 1] + 1)
            if at:
                cursor = max(cursor, at[1])
            yield (u["unit_id"], *(at or (-1, -1)), how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(doc, *x) for doc, text, parts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for x in walk(text, parts)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["doc_id", "unit_id", "start", "end", "resolution"])

    return rows.select(F.col("doc_id").cast("long"), "text", "units").mapInArrow(run, "doc_id bigint, unit_id string, start int, end int, resolution string")


def token_entities(tokens: DataFrame) -> DataFrame:
    """Entities of labelled tokens (doc_id, place, start, end, label, score): a token begins one if its label says B or S, or
    another type than the token before; S ends one at once. Labels without a prefix begin; tokens without a place don't count."""
    plain = F.upper(F.trim(F.coalesce("label", F.lit(""))))
    outside = plain.isin("", "O", "PAD", "[PAD]")
    dash = F.instr(plain, "-")
    known = tokens.where("start < end").withColumn("__kind", F.when(~outside, F.when(dash > 0, F.substr(plain, dash + 1)).otherwise(plain)))
    prefix = F.when(dash == 0, "B").otherwise(F.substring_index(plain, "-", 1))
    known = known.withColumn("__prefix", F.when(prefix.isin("B", "I", "S", "E"), prefix).otherwise("B"))
    order = Window.partitionBy("doc_id").orderBy("place")
    before, ended = F.lag("__kind").over(order), F.lag("__prefix").over(order) == "S"
    new = F.col("__prefix").isin("B", "S") | ~before.eqNullSafe(F.col("__kind")) | F.coalesce(ended, F.lit(False))
    marked = known.withColumn("__new", new.cast("int")).withColumn("__n", F.sum("__new").over(order)).where(F.col("__kind").isNotNull())
    found = marked.groupBy("doc_id", "__n", "__kind").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.avg("score").alias("score"))
    return found.select("doc_id", F.col("__kind").alias("entity_type"), "start", "end", "score")


#: A full name and its short name: 全称（以下简称“X”）.
DEFINITION = r"[一-龥A-Za-z0-9（）()·\-]{2,60}?(?:公司|集团|银行|法院|检察院|商行|工作室|合作社|经营部|事务所)\s*[（(]\s*(?:以下简称|下称|简称|又称)\s*[“\"'‘’]?[一-龥A-Za-z0-9\-]{2,20}[”\"'‘’]?\s*[）)]"
DEFINED = r"^(.*?(?:公司|集团|银行|法院|检察院|商行|工作室|合作社|经营部|事务所))\s*[（(]\s*(?:以下简称|下称|简称|又称)\s*[“\"'‘’]?([一-龥A-Za-z0-9\-]{2,20})[”\"'‘’]?\s*[）)]$"


def definition_spans(docs: DataFrame) -> DataFrame:
    """Two spans of each definition of a short name, the full name and the ALIAS, with the full name as canonical."""
    found = docs.select("doc_id", F.explode(matches(F.col("text"), DEFINITION)).alias("m"))
    full, alias = F.regexp_extract("m.text", DEFINED, 1), F.regexp_extract("m.text", DEFINED, 2)
    # the alias is the last place of its text before the closing marks
    tail = F.length(F.regexp_extract("m.text", r"([”\"'‘’]?\s*[）)])$", 1))
    end = F.col("m.end") - tail
    kind = F.when(F.contains(full, F.lit("法院")), "GOVERNMENT").otherwise("ORGANIZATION")
    one = F.struct(kind.alias("entity_type"), F.col("m.start").alias("start"), (F.col("m.start") + F.length(full)).alias("end"), full.alias("text"), F.lit(0.92).alias("score"))
    two = F.struct(F.lit("ALIAS").alias("entity_type"), (end - F.length(alias)).alias("start"), end.alias("end"), alias.alias("text"), F.lit(0.9).alias("score"))
    return found.select("doc_id", full.alias("canonical"), F.inline(F.array(one, two))).select("doc_id", "entity_type", "start", "end", "text", "score", "canonical")


def natural_name(value: Column, surnames: tuple[str, ...], compound: tuple[str, ...]) -> Column:
    """Whether a value has the shape of a person's name: with a dot, or 2 to 4 ideographs of which the first are a surname."""
    plain = compact(F.coalesce(value, F.lit("")))
    longer = F.exists(F.array(*map(F.lit, compound)), lambda s: F.startswith(plain, s) & (F.length(plain) - F.length(s)).between(1, 2))
    short = plain.rlike("^[一-龥]{2,4}$") & (longer | F.left(plain, F.lit(1)).isin(*surnames))
    return F.when(F.contains(plain, F.lit("·")), plain.rlike("^[一-龥]{1,8}·[一-龥]{2,8}$")).otherwise(short)


# --- cores of company names ---

#: Regions before a company's name, endings of companies, and endings of their business, the longest first.
PROVINCES = (
    "北京|上海|天津|重庆|广州|深圳|杭州|南京|苏州|成都|武汉|西安|长沙|郑州|青岛|宁波|佛山|东莞|厦门|福州|济南|合肥|昆明|南宁|贵阳|南昌|海口|太原|沈阳|长春|哈尔滨|石家庄|呼和浩特|乌鲁木齐|拉萨|银川|西宁|广东|广西|"
    "海南|河北|河南|湖北|湖南|江苏|浙江|安徽|福建|江西|山东|山西|陕西|四川|贵州|云南|辽宁|吉林|黑龙江|甘肃|青海|台湾|内蒙古|宁夏|新疆|西藏|香港|澳门"
)
REGION = rf"^(?:(?:[一-龥]{{2,16}}(?:省|自治区|特别行政区|市|地区|自治州|盟|区|县|旗|自治县|自治旗|镇|乡|街道))+|(?:{PROVINCES}))"
LEGAL = "(?:股份有限公司|有限责任公司|集团有限公司|有限公司|集团|分公司|子公司|公司|商行|工作室|合作社|经营部|银行|支行|分行|营业部|研究院|研究所|服务中心|技术中心|事务所)$"
BUSINESS = (
    "建筑劳务", "工程建设", "工程技术", "工程设计", "建筑工程", "新能源", "新材料", "信息技术", "技术服务", "商务服务", "设计咨询", "检测技术", "供应链服务", "供应链", "科技", "工程", "建设", "贸易", "实业", "发展",
    "咨询", "服务", "管理", "材料", "电力", "能源", "建筑", "环保", "智能", "信息", "网络", "电子", "机械", "设备", "制造", "劳务",
)


def org_core(name: Column) -> Column:
    """A company's name without its region and legal ending; empty if less than two characters are left."""
    core = F.regexp_replace(F.regexp_replace(strip_marks(name), REGION, ""), LEGAL, "")
    return F.when(F.length(core) >= 2, core).otherwise("")


def org_brand(name: Column) -> Column:
    """The core without the longest ending of business that leaves two characters."""
    ends = F.array(*map(F.lit, sorted(BUSINESS, key=lambda x: (-len(x), x))))
    fits = lambda core: F.filter(ends, lambda e: F.endswith(core, e) & (F.length(core) - F.length(e) >= 2))
    return bind(org_core(name), lambda core: F.left(core, F.length(core) - F.coalesce(F.length(F.get(fits(core), F.lit(0))), F.lit(0))))


def subject_edges(subjects: DataFrame) -> DataFrame:
    """Edges of each subject (doc_id, subject_id, place, family, canonical_key, surfaces) to the first that has its canonical key
    (confirmed) or, in its family, a surface (observed), and of organisations of one brand core (needs_adjudication).

    Each is a star to the first of a group, so that a group of very many subjects has as many edges, not all pairs.
    """

    def star(rows: DataFrame, by: list[str], relation: str, confidence: float, status: str) -> DataFrame:
        root = F.first("subject_id").over(Window.partitionBy("doc_id", *by).orderBy("place", "subject_id"))
        return rows.withColumn("target_id", root).where("subject_id <> target_id").select("doc_id", F.col("subject_id").alias("source_id"), "target_id", F.lit(relation).alias("relation"), F.lit(confidence).alias("confidence"), F.lit(status).alias("status")).distinct()

    named = subjects.where("canonical_key <> '' and not startswith(canonical_key, 'LEDGER::')")
    shown = subjects.select("doc_id", "subject_id", "place", "family", F.explode("surfaces").alias("surface")).withColumn("surface", strip_marks(F.col("surface"))).where("surface <> ''").distinct()
    brands = shown.where("family = 'organization'").withColumn("brand", org_brand(F.col("surface"))).where("brand <> ''").select("doc_id", "subject_id", "place", "brand").distinct()
    first = star(named, ["canonical_key"], "same_canonical_key", 1.0, "confirmed").unionByName(star(shown, ["family", "surface"], "same_surface", 0.92, "observed"))
    alike = star(brands, ["brand"], "same_brand", 0.8, "needs_adjudication").join(first.select("doc_id", "source_id", "target_id"), ["doc_id", "source_id", "target_id"], "left_anti")
    return first.unionByName(alike)


# --- merging for recall ---

#: How far sources are trusted (the higher the more), types of formats, types of high risk, words that a subject has too much.
RECALL_PRIORITY = {
    "regex": 100, "rule_format": 100, "rule_official_institution": 99, "rule_organization": 92, "rule_organization_context": 94, "rule_person": 92, "rule_address": 92, "rule_alias": 92, "rule_docx_structure": 94, "custom": 95,
    "contract_structure_backfill": 90, "contract": 85, "docx_structure_uie": 96, "docx_structure_ner": 94, "alias_backscan_review": 97, "propagate": 96, "review_deterministic_decision": 96, "qwen_entity_decision": 95,
    "qwen_fragment_review": 78, "uie": 70, "ner": 65, "secondary_ner": 62, "alias_propagation": 58,
}
P0_TYPES = ("CN_ID_CARD", "CN_PHONE", "LANDLINE_PHONE", "CN_BANK_CARD", "CN_CREDIT_CODE", "EMAIL_ADDRESS", "CONTRACT_NO", "CASE_NO", "TAX_NO", "URL")
HIGH_RISK_TYPES = (
    "CN_ID_CARD", "CN_PHONE", "LANDLINE_PHONE", "CN_BANK_CARD", "CN_CREDIT_CODE", "EMAIL_ADDRESS", "PERSON", "PERSON_NAME", "ORGANIZATION", "COMPANY_NAME", "ACCOUNT_NAME", "BANK_NAME", "ADDRESS", "LOCATION", "GOVERNMENT", "COURT",
    "CONTRACT_NO", "CASE_NO", "ALIAS",
)
NOISE = (
    "统一社会信用代码", "社会信用代码", "信用代码", "法定代表人", "法定代理人", "负责人", "联系人", "开户行", "账号", "账户", "供货方", "采购方", "履约", "结算", "付款", "收款", "交付", "签订", "签署", "承担", "继续", "本合同", "本协议",
)
EXTENSIONS = tuple(x for x in NOISE if x not in ("社会信用代码", "信用代码"))
LINKS = ("系", "为", "与", "和", "及", "向", "对", "由", "的", "并")


def noise_score(text: Column) -> Column:
    """How much of a text is no name: 3 for a colon, 2 for each word of NOISE, a short text that ends in 系 or 为, a long number."""
    words = lambda plain: F.size(F.filter(F.array(*map(F.lit, NOISE)), lambda w: F.contains(plain, w))) * 2
    rest = lambda plain: ((F.length(plain) <= 3) & plain.rlike("[系为]$")).cast("int") * 2 + plain.rlike(r"[0-9]{6}").cast("int") * 2
    return F.when(text.rlike("[:：]"), 3).otherwise(0) + bind(compact(text), lambda plain: words(plain) + rest(plain))


def _suspicious(old: Column, new: Column) -> Column:
    """Whether the longer text adds words that belong to no name."""
    more = F.when(F.startswith(new, old), F.substr(new, F.length(old) + 1)).when(F.endswith(new, old), F.left(new, F.length(new) - F.length(old))).otherwise("")
    more = compact(more)
    has = lambda words: more.rlike("|".join(words))
    return (more != "") & (((F.length(more) <= 3) & has(LINKS)) | has(EXTENSIONS))


def recall_merge(spans: DataFrame) -> DataFrame:
    """Spans (with strength, how far the text has the shape of a name) of which no two overlap the first they meet, in order of
    source, format, score and length. Formats win; of one type the less noisy, stronger, more trusted, longer or higher
    one; organisations take in places; a much longer or trusted one wins."""
    size = lambda s: s["end"] - s["start"]
    format_ = lambda s: s["entity_type"].isin(*P0_TYPES)
    body = lambda s: s["entity_type"].isin("ORGANIZATION", "GOVERNMENT")

    def prefer(new: Column, old: Column) -> Column:
        place = (new["start"] == old["start"]) & (new["end"] == old["end"])
        trusted = new["__trust"] >= old["__trust"] - 5
        of_type = (
            F.when(new["__noise"] != old["__noise"], (new["__noise"] < old["__noise"]) & trusted)
            .when(new["strength"] != old["strength"], (new["strength"] > old["strength"]) & trusted)
            .when(new["__trust"] != old["__trust"], new["__trust"] > old["__trust"])
            .when(size(new) != size(old), (size(new) > size(old)) & ~_suspicious(old["text"], new["text"]))
            .otherwise(new["score"] > old["score"])
        )
        holds = lambda a, b: body(a) & (b["entity_type"] == "LOCATION") & (a["start"] <= b["start"]) & (a["end"] >= b["end"]) & (a["strength"] > 0)
        ahead = new["__trust"] > old["__trust"] + 10
        longer = new["entity_type"].isin(*HIGH_RISK_TYPES) & (size(new) >= size(old) + 3)
        other = (
            F.when(place, new["__trust"] > old["__trust"]).when(holds(old, new), F.lit(False)).when(holds(new, old), F.lit(True))
            .when(longer, (new["__noise"] <= old["__noise"]) & ahead).otherwise(ahead)
        )
        return F.when(format_(new) != format_(old), format_(new)).when(new["entity_type"] == old["entity_type"], of_type).otherwise(other)

    known = spans.withColumn("__trust", ranked(RECALL_PRIORITY, F.col("source"), 1)).withColumn("__noise", noise_score(F.col("text")))
    order = F.struct((-F.col("__trust")).alias("t"), F.when(F.col("entity_type").isin(*P0_TYPES), 0).otherwise(1).alias("p"), (-F.col("score")).alias("c"), (F.col("start") - F.col("end")).alias("l"), "start", "entity_type")
    return _fold(known, order, prefer).drop("__trust", "__noise")


# --- routes for review ---


def review_routes(pages: DataFrame, links: DataFrame, diffs: DataFrame) -> DataFrame:
    """Routes (page_no, route, priority, key) from pages (needs_table_parser, needs_ocr, anchor_chars, labels), links (status) and
    differences (category, diff_id): one table of what each page's evidence asks for."""
    n = F.coalesce("anchor_chars", F.lit(0))
    none = F.lit(None).cast("string")
    asked = F.array(
        F.when(F.col("needs_table_parser"), F.struct(F.lit("needs_table_parser").alias("route"), F.lit(80).alias("priority"))),
        F.when(F.col("needs_ocr") & (n <= 0), F.struct(F.lit("needs_anchor_ocr").alias("route"), F.lit(70).alias("priority")))
        .when(F.col("needs_ocr") & (n < 40) & ~F.col("needs_table_parser"), F.struct(F.lit("needs_region_ocr").alias("route"), F.lit(75).alias("priority"))),
        F.when(F.array_contains("labels", "mapping_risk"), F.struct(F.lit("needs_human_mapping_review").alias("route"), F.lit(60).alias("priority"))),
    )
    of_pages = pages.select("page_no", F.inline(F.filter(asked, lambda x: x.isNotNull()))).withColumn("key", none)
    counts = links.groupBy("page_no").agg(F.count_if(F.col("status") == "matched").alias("matched"), F.count_if(F.col("status") == "mapping_uncertain").alias("uncertain"))
    compared = counts.where("matched > 0").select("page_no", F.lit("text_compare").alias("route"), F.lit(40).alias("priority"), none.alias("key"))
    unsure = counts.where("uncertain > 0 and not (uncertain < 3 and matched >= 2)").select("page_no", F.lit("needs_human_mapping_review").alias("route"), F.lit(90).alias("priority"), none.alias("key"))
    kind = F.when(F.col("category") == "critical_field_changed", F.struct(F.lit("text_compare").alias("route"), F.lit(95).alias("priority")))
    for category, priority in (("unlocated_hard_field", 88), ("page_coverage_gap", 82)):
        kind = kind.when(F.col("category") == category, F.struct(F.lit("needs_recall_guard_review").alias("route"), F.lit(priority).alias("priority")))
    of_diffs = diffs.withColumn("r", kind).where("r is not null").select("page_no", "r.route", "r.priority", F.col("diff_id").alias("key"))
    return of_pages.unionByName(compared).unionByName(unsure).unionByName(of_diffs)


def canonical_groups(entities: DataFrame) -> DataFrame:
    """Groups of entities (doc_id, group_id, canonical_key, text, start): their longest text (the first of equals), texts by length,
    and mentions, the largest first (place)."""
    key = F.coalesce(F.nullif(F.trim("group_id"), F.lit("")), F.nullif(F.trim("canonical_key"), F.lit("")))
    rows = entities.select("doc_id", key.alias("group_id"), F.trim("text").alias("text"), "start").where("group_id is not null")
    longest = F.max_by("text", F.struct(F.length("text").alias("l"), (-F.col("start")).alias("s")))
    texts = F.transform(F.array_sort(F.collect_set(F.struct((-F.length("text")).alias("l"), "text"))), lambda x: x["text"])
    out = rows.groupBy("doc_id", "group_id").agg(longest.alias("primary_text"), texts.alias("aliases"), F.count("*").alias("mentions"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("mentions"), F.desc(F.length("primary_text")), "group_id"))
    return out.withColumn("place", place)


#: States of a subject that only a review can end.
OPEN_STATES = ("ambiguous_short_subject", "unresolved_alias", "alias_without_anchor", "weak_reference", "weak_identity_edge", "hard_conflict")
DEFAULT_SUBJECTS = ("PERSON", "ORGANIZATION", "LOCATION", "GOVERNMENT")


def must_keep(rows: DataFrame) -> Column:
    """Whether a row can't be left out of a review, by its metadata (map<string,string>) and public type."""
    m = lambda k: F.coalesce(F.col("metadata")[k], F.lit(""))
    open_ = m("subject_ledger_status").isin(*OPEN_STATES) | m("subject_ledger_subject_status").isin(*OPEN_STATES)
    tied = (m("subject_ledger_edge_id") != "") | (m("subject_ledger_occurrence_id") != "") | (m("requires_manual_review") == "true")
    ruled = (m("rule_first_action") != "") & (F.col("entity_type").isin(*DEFAULT_SUBJECTS) | (m("rule_first_action") == "review") | (m("rule_first_risk") == "high"))
    odd = (m("candidate_types") != "") | (m("boundary_repaired_from") != "") | (m("validators_failed") != "")
    return open_ | tied | ruled | odd


def unique_anchors(pairs: DataFrame) -> DataFrame:
    """Of pairs (doc_id, alias, anchor) those whose alias has one anchor alone."""
    one = pairs.distinct().groupBy("doc_id", "alias").agg(F.count("*").alias("n"), F.min("anchor").alias("anchor"))
    return one.where("n = 1").drop("n")
