"""Gates: which candidates are subjects, of which public family, and what becomes of the others.

Every gate is an expression over columns (entity_type, text, source, and what evidence there is), so a chain of gates stays
one narrow stage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .recognize import of_layer

#: Internal types, by the public family they project to; the last group has none.
FAMILIES = {
    "PERSON": ("PERSON", "PERSON_NAME", "LEGAL_REPRESENTATIVE", "CONTACT_PERSON", "SIGNATORY"),
    "ORGANIZATION": ("ORGANIZATION", "COMPANY_NAME", "ACCOUNT_NAME"),
    "LOCATION": ("LOCATION", "ADDRESS"),
    "GOVERNMENT": ("GOVERNMENT", "GOVERNMENT_AGENCY", "COURT"),
    "FINANCIAL": ("BANK_NAME",),
    "": ("ALIAS", "PROJECT", "CONTRACT_NO", "CASE_NO", "CN_ID_CARD", "CN_PHONE", "LANDLINE_PHONE", "CN_BANK_CARD", "CN_CREDIT_CODE", "EMAIL_ADDRESS", "DATE", "AMOUNT"),
}
KNOWN_TYPES = tuple(t for own in FAMILIES.values() for t in own)
#: What official and financial institutions are called by.
OFFICIAL = ("人民法院", "法院", "人民检察院", "检察院", "公安局", "派出所", "仲裁委员会", "人民政府", "政府", "管理委员会", "委员会")
FINANCIAL = ("银行", "支行", "分行", "营业部", "分理处", "信用社", "联社")
#: Roles of a contract, which name no subject.
ROLES = ("甲方", "乙方", "丙方", "委托方", "受托方", "发包人", "承包人", "采购人", "供应商")
#: Negative signals that reject at once.
HARD = ("leading_subject_linking_verb", "subject_linking_verb_with_unresolved_left_context", "leading_function_prefix", "previous_subject_prefix", "company_prefix_before_official_institution")
NOT_MASKED = ("DATE", "AMOUNT", "POSITION")


def _ends(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike(f"(?:{'|'.join(words)})$")


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(words))


def known(candidates: DataFrame) -> DataFrame:
    """Types in upper case, and only those of the vocabulary."""
    return candidates.withColumn("entity_type", F.upper(F.trim("entity_type"))).where(F.col("entity_type").isin(*KNOWN_TYPES))


def family(kind: Column, text: Column, canonical: Column | None = None) -> Column:
    """The public family of a type and text, null if it has none. Official institutions are governments whatever their
    type; other names that hold an official or financial word have no family; an alias has that of what it stands for,
    but roles have none."""
    official, marked = _ends(text, OFFICIAL), _holds(text, (*OFFICIAL, *FINANCIAL))
    out = (
        F.when(kind.isin(*FAMILIES["PERSON"]), "PERSON").when(kind.isin(*FAMILIES["LOCATION"]), "LOCATION")
        .when(kind.isin(*FAMILIES["GOVERNMENT"], *FAMILIES["FINANCIAL"]), F.when(official, "GOVERNMENT"))
        .when(kind.isin(*FAMILIES["ORGANIZATION"]), F.when(official, "GOVERNMENT").when(~marked, "ORGANIZATION"))
    )
    if canonical is None:
        return out
    named = F.when(_ends(canonical, OFFICIAL), "GOVERNMENT").when(~_holds(canonical, (*OFFICIAL, *FINANCIAL)), "ORGANIZATION")
    return F.when(kind == "ALIAS", F.when((F.coalesce(canonical, F.lit("")) != "") & ~text.isin(*ROLES), named)).otherwise(out)


def person_shape(text: Column) -> Column:
    """Two to four Chinese characters that end in no word of an institution, or two to four capitalised words."""
    return (text.rlike(r"^[一-龥]{2,4}$") & ~_ends(text, (*OFFICIAL, *FINANCIAL, "公司", "集团"))) | text.rlike(r"^\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+){1,3}$")


def organization_shape(text: Column) -> Column:
    return text.rlike(r"^[一-龥A-Za-z0-9·（）()\-&. ]{2,}(?:公司|集团|中心|研究院|事务所|商行|工作室|合作社|Inc\.?|Ltd\.?|GmbH|S\.A\.)$")


def in_place_context(before: Column, after: Column) -> Column:
    """What stands around a name says that it is a place: a word of place before it, or of seat after it."""
    return before.rlike(r"(?:住所|住址|地址|位于|坐落|来到|前往)[^一-龥]{0,3}$") | after.rlike(r"^.{0,4}(?:省|市|区|县|镇|路|街|号)")


def cites_authority(before: Column, after: Column) -> Column:
    """A name of an authority within a citation of its rulings or rules is no party."""
    return before.rlike(r"(?:根据|依据|按照|参照)[^。；]{0,20}$") | after.rlike(r"^[^。；]{0,12}(?:规定|解释|意见|公告|令)")


def decide(candidates: DataFrame) -> DataFrame:
    """action and risk of candidates (entity_type, text, source, rejected, negative array<string>, failed array<string>).

    A false positive or a hard signal rejects; a failed check or another signal asks for review; else what comes from a
    rule or the structure is kept, short names go to review, and the rest is kept.
    """
    hard = F.arrays_overlap("negative", F.array(*map(F.lit, HARD)))
    layer = of_layer(F.col("source"))
    short = F.col("entity_type").isin("PERSON", "ORGANIZATION", "GOVERNMENT") & (F.length("text") <= 3)
    action = (
        F.when(F.col("rejected") | hard, "reject").when((F.size("failed") > 0) | (F.size("negative") > 0), "review")
        .when(layer.isin("regex", "structure"), "keep").when(short, "review").otherwise("keep")
    )
    risk = F.when(action == "reject", "high").when(action == "review", F.when(F.size("failed") > 0, "high").otherwise("medium")).otherwise("low")
    return candidates.withColumn("layer", layer).withColumn("action", action).withColumn("risk", risk)


def masked(entities: DataFrame) -> Column:
    """Whether an entity is desensitised: it has a replacement that isn't its text, and its type is rewritten."""
    new = F.coalesce("replacement", F.lit(""))
    return (new != "") & (new != F.col("text")) & (F.coalesce("replacement_method", F.lit("")) != "preserve") & ~F.col("entity_type").isin(*NOT_MASKED)


def in_group(spans: DataFrame, groups: DataFrame) -> DataFrame:
    """Spans of a document within its groups (doc_id, group, start, end), with offsets from the group's start."""
    g = groups.select(F.col("doc_id").alias("__doc"), "group", F.col("start").alias("g_start"), F.col("end").alias("g_end"))
    inside = (F.col("doc_id") == F.col("__doc")) & (F.col("start") >= F.col("g_start")) & (F.col("end") <= F.col("g_end"))
    return spans.join(g, inside).withColumn("start", F.col("start") - F.col("g_start")).withColumn("end", F.col("end") - F.col("g_start")).drop("__doc", "g_end")


def restored(spans: DataFrame) -> DataFrame:
    """The inverse of in_group."""
    return spans.withColumn("start", F.col("start") + F.col("g_start")).withColumn("end", F.col("end") + F.col("g_start")).drop("g_start")


#: Marks and words that join names.
JOINTS = r"、|以及|及|和|与|, | and "


def split_parallel(spans: DataFrame, least: int = 2, floor: float = 0.82) -> DataFrame:
    """A span of names joined by marks becomes a span each, if at least two of its parts are names of ``least`` characters;
    the others stay as they are. Scores are at least ``floor``."""
    parts = F.split("text", JOINTS, -1)
    gaps = F.regexp_extract_all("text", F.lit(f"({JOINTS})"), F.lit(1))
    ends = lambda x: F.aggregate(F.zip_with(x["parts"], F.concat(x["gaps"], F.array(F.lit(""))), lambda p, g: F.length(p) + F.length(g)), F.array(F.lit(0)), lambda at, n: F.concat(at, F.array(F.element_at(at, -1) + n)))
    placed = lambda x: F.filter(F.zip_with(x["parts"], ends(x), lambda p, s: F.struct(p.alias("text"), s.alias("at"))), lambda t: t["text"].isNotNull() & (F.length(t["text"]) >= least))
    pieces = F.transform(F.array(F.struct(parts.alias("parts"), gaps.alias("gaps"))), placed).getItem(0)
    split = spans.withColumn("__p", pieces).withColumn("__p", F.when(F.size("__p") >= 2, F.col("__p")).otherwise(F.array(F.struct(F.col("text").alias("text"), F.lit(0).alias("at")))))
    several = F.size("__p") >= 2
    out = split.select(*[c for c in spans.columns if c not in ("text", "start", "end", "score")], F.when(several, F.greatest("score", F.lit(floor))).otherwise(F.col("score")).alias("score"), F.col("start").alias("__s"), F.explode("__p").alias("p"))
    return out.select("*", F.col("p.text").alias("text"), (F.col("__s") + F.col("p.at")).alias("start"), (F.col("__s") + F.col("p.at") + F.length("p.text")).alias("end")).drop("p", "__s").select(*spans.columns)


#: What organisations' names end in, and begin with.
LEGAL_ENDS = ("有限责任公司", "股份有限公司", "有限公司", "集团公司", "公司", "集团")
REGIONS = r"^(?:北京|上海|天津|重庆|广东|浙江|江苏|福建|四川|湖北|湖南|山东|河南|河北)(?:省|市)?|^(?:[一-龥]{2,3}(?:省|自治区))?(?:[一-龥]{2,4}(?:市|州))?(?:[一-龥]{1,4}(?:区|县))?"


def org_core(name: Column) -> Column:
    """A name without its region and legal ending; the name itself if nothing of two characters is left."""
    bare = reduce(lambda c, end: F.regexp_replace(c, f"{end}$", ""), LEGAL_ENDS, name)
    core = F.regexp_replace(F.regexp_replace(bare, r"[（(][^（()）]*[）)]", ""), REGIONS, "")
    return F.when(F.length(core) >= 2, core).otherwise(name)
