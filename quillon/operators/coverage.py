"""Coverage first: what each unit must be checked for, whether it was, and whether it can be rewritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .resolve import mark_overlaps


class Family:
    """Labels of one kind of block: terms, category, reason and types to expect."""

    def __init__(self, category: str, reason: str, terms: tuple[str, ...], expected: tuple[str, ...], checks: tuple[str, ...]) -> None:
        self.category, self.reason, self.terms, self.expected, self.checks = category, reason, terms, expected, checks


#: Label families in the order they are tried, all of high priority.
FAMILIES = (
    Family("bank_account_block", "bank_or_account_label", ("开户行", "开户银行", "户名", "账户", "账号", "银行账号", "收款单位", "付款单位"), ("ORGANIZATION", "BANK_NAME", "ACCOUNT_NAME", "CN_BANK_CARD"), ("bank_account_coverage", "organization_coverage")),
    Family("party_block", "party_role_label", ("甲方", "乙方", "丙方", "委托方", "受托方", "发包人", "承包人", "采购人", "供应商"), ("ORGANIZATION", "PERSON", "ALIAS"), ("organization_coverage", "person_coverage", "identity_relation_coverage")),
    Family("legal_caption_block", "legal_party_label", ("原告", "被告", "申请人", "被申请人", "上诉人", "被上诉人", "第三人"), ("ORGANIZATION", "PERSON"), ("organization_coverage", "person_coverage")),
    Family("signature_block", "signature_or_seal_label", ("签章", "盖章", "落款", "签署", "签名", "签字"), ("ORGANIZATION", "PERSON"), ("organization_coverage", "person_coverage")),
    Family("contact_block", "contact_or_address_label", ("联系人", "联系电话", "手机号", "电话", "通讯地址", "联系地址", "住所", "住址", "地址"), ("PERSON", "ADDRESS", "LOCATION", "CN_PHONE", "LANDLINE_PHONE"), ("person_coverage", "address_coverage", "phone_or_id_coverage")),
    Family("definition_block", "alias_definition_label", ("以下简称", "下称", "简称", "又称"), ("ORGANIZATION", "PERSON", "ALIAS"), ("alias_definition_coverage", "identity_relation_coverage")),
)
#: Families for Latin text: what the driver's documents have.
LATIN_FAMILIES = (
    Family("contact_block", "contact_label", ("@", "+1 ("), ("EMAIL_ADDRESS", "PHONE"), ("phone_or_id_coverage",)),
    Family("secret_block", "secret_label", ("token =", "password", "key ="), ("SECRET",), ("secret_coverage",)),
    Family("licence_block", "licence_label", ("Licensed", "License", "rights reserved"), (), ("licence_coverage",)),
)
ALL_PARTIES = ("organization_coverage", "person_coverage", "address_coverage")
#: Container, category, reason and expected types of medium priority, in the order they are tried.
CONTAINERS = (
    (("table_cell", "table_row"), "table_sensitive_column", "docx_table_unit_with_sensitive_shape", ("ORGANIZATION", "PERSON", "ADDRESS", "ACCOUNT_NAME", "BANK_NAME"), ALL_PARTIES),
    (("header", "footer"), "header_footer_block", "header_or_footer_visible_text", ("ORGANIZATION", "PERSON", "CONTRACT_NO", "CASE_NO"), ALL_PARTIES[:2]),
    (("textbox",), "textbox_block", "textbox_visible_text", ("ORGANIZATION", "PERSON", "ADDRESS"), ALL_PARTIES),
    (("footnote", "endnote", "comment"), "footnote_comment_block", "note_or_comment_visible_text", ("ORGANIZATION", "PERSON", "ADDRESS"), ALL_PARTIES),
)
#: Shapes of organisations and people. The shapes end in one of these; texts without are not tried, as the shapes are slow to fail.
ORG_ENDS = "公司|集团|银行|法院|检察院|仲裁委员会|中心|研究院|事务所|商行|工作室|合作社"
PERSON_ENDS = "先生|女士|经理|主任|负责人|联系人|代表"
ORG_SHAPE = r"[一-龥A-Za-z0-9·（）()\-]{2,}(?:公司|集团|银行|法院|检察院|仲裁委员会|中心|研究院|事务所|商行|工作室|合作社)"
PERSON_SHAPE = r"[一-龥]{2,4}(?:先生|女士|经理|主任|负责人|联系人|代表)"


def _as(category: str, reason: str, expected: tuple[str, ...], checks: tuple[str, ...], priority: str) -> Column:
    texts = lambda values: F.array(*map(F.lit, sorted(set(values)))).cast("array<string>")
    return F.struct(F.lit(category).alias("category"), F.lit(reason).alias("reason"), texts(expected).alias("expected"), texts(checks).alias("checks"), F.lit(priority).alias("priority"))


def obligations(units: DataFrame, families: tuple[Family, ...] = FAMILIES) -> DataFrame:
    """What units (doc_id, unit_id, text, container_type, rewritable) must be checked for. The first label family, container
    or shape that applies decides; units of low priority that expect nothing are left out."""
    plain = F.regexp_replace("text", r"(?U)\s+", "")
    text = F.col("text") if families is LATIN_FAMILIES else plain
    has = lambda terms: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))
    ladder = None
    for f in families:
        found = _as(f.category, f.reason, f.expected, f.checks, "high")
        ladder = F.when(has(f.terms), found) if ladder is None else ladder.when(has(f.terms), found)
    for types, category, reason, expected, checks in CONTAINERS:
        ladder = ladder.when(F.col("container_type").isin(*types), _as(category, reason, expected, checks, "medium"))
    ladder = ladder.when(plain.rlike(ORG_ENDS) & plain.rlike(ORG_SHAPE), _as("ordinary_narrative", "ordinary_text_with_sensitive_shape", ("ORGANIZATION",), ("organization_coverage",), "medium"))
    ladder = ladder.when(plain.rlike(PERSON_ENDS) & plain.rlike(PERSON_SHAPE), _as("ordinary_narrative", "ordinary_text_with_sensitive_shape", ("PERSON",), ("person_coverage",), "medium"))
    ladder = ladder.otherwise(_as("boilerplate_low_value", "no_sensitive_structure_or_shape", (), (), "low"))
    found = units.where(plain != "").withColumn("o", ladder)
    priority = F.when(~F.col("rewritable") & (F.col("o.priority") == "low"), "medium").otherwise(F.col("o.priority"))
    checks = F.when(F.col("rewritable"), F.col("o.checks")).otherwise(F.array_sort(F.concat(F.col("o.checks"), F.array(F.lit("rewrite_addressability")))))
    out = found.select("doc_id", "unit_id", F.col("o.category").alias("category"), F.col("o.reason").alias("reason"), F.col("o.expected").alias("expected"), checks.alias("checks"), priority.alias("priority"), (~F.col("rewritable")).alias("rewrite_required"))
    return out.where((F.size("expected") > 0) | (F.col("priority") != "low"))


#: Names of one type.
TYPE_ALIASES = {
    "PERSON_NAME": "PERSON", "LEGAL_REPRESENTATIVE": "PERSON", "CONTACT_PERSON": "PERSON", "SIGNATORY": "PERSON", "COMPANY_NAME": "ORGANIZATION", "ORG": "ORGANIZATION", "COMPANY": "ORGANIZATION",
    "LOCATION": "ADDRESS",
}
RULE_SOURCES = ("regex", "custom", "contract_structure_backfill")


def canonical_type(kind: Column) -> Column:
    out = kind
    for name, to in TYPE_ALIASES.items():
        out = F.when(kind == name, to).otherwise(out)
    return out


def match(plan: DataFrame, candidates: DataFrame) -> DataFrame:
    """The status of each obligation, from candidates (unit_id, entity_type, source) of its unit and expected types."""
    wanted = plan.select("unit_id", F.explode(F.array_distinct(F.transform("expected", canonical_type))).alias("kind"))
    found = candidates.select("unit_id", canonical_type(F.col("entity_type")).alias("kind"), "source")
    met = wanted.join(found, ["unit_id", "kind"]).groupBy("unit_id").agg(F.count("*").alias("matches"), F.bool_and(F.col("source").isin(*RULE_SOURCES)).alias("by_rule"))
    status = (
        F.when(F.col("rewrite_required"), "unrewritable")
        .when(F.col("matches") > 0, F.when(F.col("by_rule"), "satisfied_by_rule").otherwise("satisfied_by_candidate"))
        .when(F.col("priority") == "low", "not_sensitive_by_rule").otherwise("uncovered")
    )
    return plan.join(met, "unit_id", "left").withColumn("matches", F.coalesce("matches", F.lit(0).cast("long"))).withColumn("status", status).drop("by_rule")


def arbitration(matched: DataFrame, constraints: DataFrame) -> DataFrame:
    """What must still be decided: kind, key, severity. Open obligations, and links and types that conflict."""
    severity = F.when(F.col("status") == "unrewritable", "hard").when(F.col("priority") == "high", "hard").otherwise("medium")
    open_ = matched.where(F.col("status").isin("uncovered", "unrewritable")).select(F.col("status").alias("kind"), F.col("unit_id").alias("key"), severity.alias("severity"))
    tied = constraints.where(F.col("kind").isin("type_conflict", "maybe_link")).select("kind", "key", F.when(F.col("kind") == "type_conflict", "hard").otherwise("medium").alias("severity"))
    return open_.unionByName(tied)


NOT_REWRITTEN = ("DATE", "AMOUNT")


def rewrite_ledger(entities: DataFrame, units: DataFrame) -> DataFrame:
    """Each entity's rewrite: status ready or failed, and the first reason against it. Overlaps are looked for among the
    otherwise ready ones of a unit."""
    unit = units.select(F.col("unit_id"), F.col("text").alias("u_text"), F.col("start").alias("u_start"), "rewritable")
    joined = entities.join(unit, "unit_id", "left")
    there = F.substr("u_text", F.col("start") - F.col("u_start") + 1, F.col("end") - F.col("start"))
    reason = (
        F.when(F.coalesce("replacement", F.lit("")) == "", "missing_replacement").when(F.col("entity_type").isin(*NOT_REWRITTEN), "non_rewrite_type")
        .when((F.col("end") <= F.col("start")) | (F.col("start") < 0), "invalid_range").when(F.col("u_text").isNull(), "missing_unit")
        .when(~F.col("rewritable"), "unrewritable_policy").when(there != F.col("text"), "source_range_mismatch")
    )
    judged = joined.withColumn("failure_reason", reason).drop("u_text", "u_start", "rewritable")
    ready = mark_overlaps(judged.where("failure_reason is null"), ("unit_id",), "entity_type").withColumn("failure_reason", F.when(F.col("blocked"), "range_overlap"))
    both = ready.drop("overlaps", "blocked").unionByName(judged.where("failure_reason is not null"))
    return both.withColumn("status", F.when(F.col("failure_reason").isNull(), "ready").otherwise("failed"))


def export_ready(ledger: DataFrame) -> DataFrame:
    """One row: how many rewrites are ready and failed, replacements that several subjects share, subjects with several
    replacements, and whether nothing blocks the export."""
    shared = ledger.groupBy("replacement").agg(F.countDistinct("text").alias("n")).where("n > 1 and replacement is not null").agg(F.count("*").alias("shared_replacements"))
    several = ledger.groupBy("entity_type", "text").agg(F.countDistinct("replacement").alias("n")).where("n > 1").agg(F.count("*").alias("split_subjects"))
    counts = ledger.agg(F.count_if(F.col("status") == "ready").alias("ready"), F.count_if(F.col("failure_reason").isin("range_overlap", "source_range_mismatch", "unrewritable_policy")).alias("blocking"))
    one = counts.crossJoin(F.broadcast(shared)).crossJoin(F.broadcast(several))  # one row each
    return one.withColumn("export_ready", (F.col("blocking") == 0) & (F.col("shared_replacements") == 0) & (F.col("split_subjects") == 0))
