"""Boundary repair: spans are widened, stripped, cut and split, one rule at a time, until nothing changes.

A policy says what labels, function words, marks and endings are. Each round applies to every span that still moves the
first rule that fits, which gives one or several spans; those that no rule fits are done. Rules after the widening only
shorten, so rounds end by themselves, and only spans that moved are looked at again. Each span keeps where it came from
and what was done to it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bind
from ..session import checkpointed
from .resolve import containing

#: Labels of fields, function words before a name, marks around it, and what names of organisations end in.
FIELD_LABELS = (
    "甲方", "乙方", "丙方", "委托方", "受托方", "发包人", "承包人", "采购人", "供应商", "申请人", "被申请人", "原告", "被告", "第三人",
    "法定代表人", "负责人", "联系人", "户名", "账户名称", "开户名", "开户行", "地址", "住所", "项目地址", "工程地址",
)
FUNCTION_WORDS = (
    "由", "并由", "后续由", "随后由", "另由", "另行由", "同时由", "共同由", "分别由", "通过", "经过", "经由", "根据", "依据", "按照", "要求", "通知", "说明", "确认",
    "请求", "判令", "向", "对", "与", "和", "及", "以及", "被", "在", "经", "为", "由其", "由该", "由本",
)
MARKS = r"\s:：,，;；。.!！?？、（）()《》【】"
ORGANISATION_ENDS = (
    "股份有限公司", "有限责任公司", "集团有限公司", "有限公司", "集团", "分公司", "子公司", "公司", "人民法院", "仲裁委员会", "人民检察院", "公安局", "派出所", "律师事务所",
    "会计师事务所", "研究院", "研究所", "服务中心", "技术中心", "管理委员会", "委员会",
)
OFFICE_VERBS = ("担任", "任职", "就职", "供职", "出任", "为", "是", "系", "兼任", "兼为", "任", "在", "加入", "服务于")
LEAST_SCORE = 0.82
#: Rules that one job takes on a span, before what still moves is written down.
RULES_A_JOB = 6


def any_of(words: tuple[str, ...]) -> str:
    """A pattern of any of words, the longest first."""
    return "(?:" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")"


@dataclass(frozen=True)
class Policy:
    """Patterns of one language. joints is a class of single characters; what joins in several is first replaced, by as
    many. A part between joints is kept if a ``piece`` stands at its beginning, one between breaks if a ``tail`` is in it. ``person``
    ends in a count, which is taken as few times as possible before a verb."""

    label: str
    noise: str
    marks: str
    tail: str
    piece: str
    joints: str
    breaks: str
    joined: tuple[tuple[str, str], ...] = ()
    person: str = ""
    verbs: str = ""
    floor: float = LEAST_SCORE


CHINESE = Policy(
    any_of(FIELD_LABELS) + r"\s*[:：]?\s*", any_of(FUNCTION_WORDS) + r"\s*", MARKS, any_of(ORGANISATION_ENDS), r"[一-龥A-Za-z0-9（）()·\-]{1,40}" + any_of(ORGANISATION_ENDS), "[、/和与及]", "[，,；;。\n]",
    (("以及", "、、"),), "[一-龥]{2,3}", any_of(OFFICE_VERBS),
)
SPAN = "array<struct<entity_type:string,start:int,end:int,text:string,repair:string>>"


def _piece(of: Callable[[str], Column], at: Column, n: Column, kind: Column, repair: str) -> Column:
    value, start = of("text"), of("start") + at
    return F.struct(kind.alias("entity_type"), start.cast("int").alias("start"), (start + n).cast("int").alias("end"), F.substr(value, at + 1, n).alias("text"), F.lit(repair).alias("repair"))


def _pieces(policy: Policy, of: Callable[[str], Column], pattern: str, fit: str, repair: str) -> Column:
    """The parts of a value between what fits pattern that fit as a whole, if there are several."""
    value = of("text")
    even = reduce(lambda v, j: F.replace(v, F.lit(j[0]), F.lit(j[1])), policy.joined, value)
    # places of parts: every joint is one character
    placed = lambda parts: F.transform(parts, lambda p, i: F.struct(F.length(p).alias("n"), F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda t, q: t + F.length(q) + 1).alias("at")))
    cut = bind(F.split(even, pattern, -1), lambda parts: F.transform(placed(parts), lambda p: _piece(of, p["at"], p["n"], of("entity_type"), repair)))
    fits = bind(F.filter(cut, lambda p: F.rlike(p["text"], F.lit(fit))), lambda found: F.when(F.size(found) >= 2, found))
    return F.when(F.rlike(even, F.lit(pattern)), fits)


def step(policy: Policy, of: Callable[[str], Column] = F.col) -> Column:
    """What the first rule that fits makes of a span, whose fields are those of a row or what ``of`` gives: an array of spans,
    or null where none fits."""
    value, kind = of("text"), of("entity_type")
    n = F.length(value)
    found = lambda pattern: F.length(F.regexp_extract(value, pattern, 0))
    less = lambda left, right, repair: F.array(_piece(of, left, n - left - right, kind, repair))
    zero = F.lit(0)
    # each length is worked out once, and only if no rule before it fits
    part = lambda pattern, body: bind(found(pattern), lambda k: F.when((k > 0) & (k < n), body(k)))
    led = part(f"^[{policy.marks}]+", lambda k: less(k, zero, "strip_leading_punctuation"))
    trailed = part(f"[{policy.marks}]+$", lambda k: less(zero, k, "strip_trailing_punctuation"))
    labelled = part(f"^{policy.label}", lambda k: less(k, zero, "strip_field_label"))
    narrative = _pieces(policy, of, policy.breaks, f"(?s)^.*{policy.tail}", "split_narrative_subjects")
    parallel = _pieces(policy, of, policy.joints, f"(?s)^(?:{policy.piece})", "split_parallel_subject")
    ends = part(f"(?s)^.*{policy.tail}", lambda k: less(zero, n - k, "trim_to_organization_shape"))
    after = part(f"^{policy.noise}", lambda k: F.when(F.substr(value, k + 1).rlike(policy.tail), less(k, zero, "strip_leading_noise")))
    bridge = F.lit(None).cast(SPAN)
    if policy.verbs:
        office = f"(?s)^({policy.person}?)({policy.verbs})(.*{policy.tail})"
        group = lambda i: F.length(F.regexp_extract(value, office, i))
        both = lambda k: F.array(_piece(of, zero, k["first"], F.lit("PERSON"), "split_person_org_bridge"), _piece(of, k["first"] + k["verb"], k["rest"], F.lit("ORGANIZATION"), "split_person_org_bridge"))
        lengths = F.when(group(1) > 0, F.struct(group(1).alias("first"), group(2).alias("verb"), group(3).alias("rest")))
        bridge = bind(lengths, lambda k: F.when(k.isNotNull(), both(k)))
    return F.coalesce(led, trailed, labelled, narrative, after, bridge, parallel, ends)


def expanded(spans: DataFrame, shapes: DataFrame) -> DataFrame:
    """Spans with the bounds of the smallest shape (doc_id, start, end, text) that holds them, and expanded, whether they
    grew; the others as they are."""
    own = shapes.select("doc_id", F.concat_ws(":", "start", "end").alias("unit_id"), "start", "end", F.col("start").alias("__s"), F.col("end").alias("__e"), F.col("text").alias("__t"))
    joined = containing(spans, checkpointed(own), ("__s", "__e", "__t"))
    grown = F.coalesce(F.col("__e") - F.col("__s") > F.col("end") - F.col("start"), F.lit(False))
    new = {"start": F.when(grown, F.col("__s")).otherwise(F.col("start")), "end": F.when(grown, F.col("__e")).otherwise(F.col("end")), "text": F.when(grown, F.col("__t")).otherwise(F.col("text"))}
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in spans.columns], grown.alias("expanded"))


def repaired(spans: DataFrame, policy: Policy = CHINESE, shapes: DataFrame | None = None) -> DataFrame:
    """Spans (doc_id, entity_type, start, end, text, score) until no rule fits, one of each place and type: with
    origin_start, origin_end (the first span that led there) and repairs, in order. Shapes are widened into once, first."""
    columns = ["doc_id", "entity_type", "start", "end", "text", "score"]
    began = spans.select(*columns).withColumn("origin_start", F.col("start")).withColumn("origin_end", F.col("end"))
    if shapes is not None:
        began = expanded(began, shapes).withColumn("repairs", F.when(F.col("expanded"), F.array(F.lit("expand_to_full_subject_shape"))).otherwise(F.array().cast("array<string>")))
    else:
        began = began.withColumn("repairs", F.array().cast("array<string>"))
    order = [*columns, "origin_start", "origin_end", "repairs"]
    # several rules a job: a span that no rule fits passes the rest as it is
    own = F.struct("entity_type", "start", "end", "text", "score", "repairs", F.lit(False).alias("moves"))
    made = F.transform(
        step(policy),
        lambda n: F.struct(*[n[c].alias(c) for c in ("entity_type", "start", "end", "text")], F.greatest("score", F.lit(policy.floor)).alias("score"), F.concat("repairs", F.array(n["repair"])).alias("repairs"), F.lit(True).alias("moves")),
    )
    following = F.inline(F.when(F.col("moves"), F.coalesce(made, F.array(own))).otherwise(F.array(own)))
    moving, done = began.select(*order, F.lit(True).alias("moves")), []
    while True:
        for _ in range(RULES_A_JOB):
            moving = moving.select("doc_id", "origin_start", "origin_end", following)
        now = checkpointed(moving)
        done.append(now.where("not moves").select(*order))
        moving = now.where("moves").select(*order, "moves")
        if moving.isEmpty():
            break
    least = F.min(F.struct("origin_start", "origin_end", "repairs")).alias("o")
    whole = reduce(DataFrame.unionByName, done).groupBy("doc_id", "entity_type", "start", "end", "text").agg(F.max("score").alias("score"), least)
    return whole.select(*columns, "o.origin_start", "o.origin_end", "o.repairs")


def repair_counts(raw: DataFrame, spans: DataFrame, accepted: Column) -> DataFrame:
    """How a set of raw spans went through: state (raw, boundary_normalized, a repair, gate, accepted, rejected) and n."""
    count = lambda df, state: df.agg(F.count("*").alias("n")).select(F.lit(state).alias("state"), "n")
    by_repair = spans.select(F.explode("repairs").alias("state")).groupBy("state").agg(F.count("*").alias("n"))
    gated = spans.withColumn("state", F.when(accepted, "accepted").otherwise("rejected")).groupBy("state").agg(F.count("*").alias("n"))
    return reduce(DataFrame.unionByName, [count(raw, "raw"), count(spans, "boundary_normalized"), count(spans.where(F.size("repairs") > 0), "boundary_repaired"), by_repair, gated])


def _settled(spans: Column, policy: Policy) -> Column:
    """Spans (an array of entity_type, start, end, text, origin_start, origin_end, repairs) until no rule fits, within the row: what repaired does in jobs."""
    own = ("entity_type", "start", "end", "text", "origin_start", "origin_end", "repairs")
    fields = lambda s, moves: F.struct(*[s[c].alias(c) for c in own], F.lit(moves).alias("moves"))

    def moved(s: Column) -> Column:
        then = lambda n: F.struct(
            *[n[c].alias(c) for c in own[:4]], *[s[c].alias(c) for c in own[4:6]], F.concat(s["repairs"], F.array(n["repair"])).alias("repairs"), F.lit(True).alias("moves")
        )
        made = F.transform(step(policy, s.__getitem__), then)
        return F.when(s["moves"], F.coalesce(made, F.array(fields(s, False)))).otherwise(F.array(s))

    moving = lambda now: F.exists(now, lambda s: s["moves"])
    one = lambda now, _: F.when(moving(now), F.flatten(F.transform(now, moved))).otherwise(now)
    several = lambda now, _: F.when(moving(now), F.aggregate(F.sequence(F.lit(1), F.lit(RULES_A_JOB)), now, one)).otherwise(now)
    # every rule shortens what it fits, so there are no more steps than characters
    longest = F.coalesce(F.array_max(F.transform(spans, lambda s: F.length(s["text"]))), F.lit(0))
    return F.aggregate(F.sequence(F.lit(0), F.floor(longest / RULES_A_JOB).cast("int")), F.transform(spans, lambda s: fields(s, True)), several)


def _typed(kind: Column) -> Column:
    return F.when(kind == "COMPANY_NAME", "ORGANIZATION").when(kind == "PERSON_NAME", "PERSON").otherwise(kind)


def _supported(kind: Column) -> Column:
    return kind.isin("ORGANIZATION", "PERSON")


def _reason(kind: Column, text: Column, policy: Policy) -> Column:
    shape = F.when(kind == "PERSON", F.rlike(text, F.lit(f"^(?:{policy.person})$"))).otherwise(F.rlike(text, F.lit(f"^(?:{policy.piece})$")))
    return F.when(F.length(text) < 2, "too_short").when(~shape, "no_subject_shape")


def _action(reason: Column, repairs: Column) -> Column:
    return F.when(reason.isNotNull(), "reject").when(F.exists(repairs, lambda r: F.startswith(r, F.lit("split"))), "review").otherwise("keep")


def rule_first_within(docs: DataFrame, policy: Policy = CHINESE) -> DataFrame:
    """What rule_first gives for documents of one row each (doc_id, spans, shapes as arrays) whose spans stand in one text: each
    row is worked out by itself, so nothing is dealt anew or written down."""
    key = ("entity_type", "start", "end", "text")

    def grown(s: Column, shapes: Column) -> Column:
        holds = F.filter(shapes, lambda u: (u["end"] >= u["start"]) & (u["start"] <= s["start"]) & (s["end"] <= u["end"]))
        sized = F.transform(holds, lambda u: F.struct((u["end"] - u["start"]).alias("n"), F.concat_ws(":", u["start"], u["end"]).alias("id"), *[u[c].alias(c) for c in key[1:]]))
        kind, origin = _typed(s["entity_type"]).alias("entity_type"), (s["start"].alias("origin_start"), s["end"].alias("origin_end"))
        wide = lambda u: F.struct(kind, *[u[c].alias(c) for c in key[1:]], *origin, F.array(F.lit("expand_to_full_subject_shape")).alias("repairs"))
        bare = F.struct(kind, *[s[c].alias(c) for c in key[1:]], *origin, F.array().cast("array<string>").alias("repairs"))
        return bind(F.array_min(sized), lambda u: F.when(u["n"] > s["end"] - s["start"], wide(u)).otherwise(bare))

    same = lambda x, y: F.struct(*[x[c] for c in key]).eqNullSafe(F.struct(*[y[c] for c in key]))
    # of each place and type the first by origin and repairs
    firsts = lambda found: bind(F.array_sort(found), lambda all_: F.filter(all_, lambda x, i: (i == 0) | ~same(x, F.get(all_, i - 1))))
    judge = lambda x: F.struct(*[x[c].alias(c) for c in (*key, "repairs")], _reason(x["entity_type"], x["text"], policy).alias("reason"))

    def swept(judged: Column) -> Column:
        before = lambda y, x: (y["start"] < x["start"]) | (y["start"] == x["start"]) & (y["end"] > x["end"])
        over = lambda x: F.exists(judged, lambda y: y["reason"].isNull() & (y["entity_type"] == x["entity_type"]) & before(y, x) & (x["start"] < y["end"]))
        reason = lambda x: F.when(x["reason"].isNotNull(), x["reason"]).when(over(x), "duplicate")
        out = lambda x: bind(reason(x), lambda r: F.struct(*[x[c].alias(c) for c in key], _action(r, x["repairs"]).alias("action"), r.alias("reason")))
        return F.transform(judged, out)

    began = bind(F.col("shapes"), lambda shapes: F.transform(F.filter("spans", lambda s: _supported(_typed(s["entity_type"]))), lambda s: grown(s, shapes)))
    settled = bind(began, lambda spans: _settled(spans, policy))
    own = bind(F.transform(firsts(settled), judge), swept)
    outside = F.transform(
        F.filter("spans", lambda s: ~_supported(_typed(s["entity_type"]))),
        lambda s: F.struct(_typed(s["entity_type"]).alias("entity_type"), *[s[c].alias(c) for c in key[1:]], F.lit("reject").alias("action"), F.lit("unsupported_internal_entity_type").alias("reason")),
    )
    return docs.select("doc_id", F.inline(F.concat(own, outside)))


def rule_first(spans: DataFrame, shapes: DataFrame, policy: Policy = CHINESE) -> DataFrame:
    """Raw spans through types, boundaries, false positives and the gate, as a ledger of spans: what is unsupported, too short to be
    a name, or without an ending or a person's shape is rejected, with its reason; the rest is kept, those that were split are reviewed. Of spans of one
    type that overlap, those that begin first and are longest stay; others are duplicates."""
    typed = spans.withColumn("entity_type", _typed(F.col("entity_type")))
    supported = _supported(F.col("entity_type"))
    outside = typed.where(~supported).select("doc_id", "entity_type", "start", "end", "text", F.lit("reject").alias("action"), F.lit("unsupported_internal_entity_type").alias("reason"))
    own = repaired(typed.where(supported), policy, shapes)
    order = Window.partitionBy("doc_id", "entity_type").orderBy("start", F.desc("end"))
    judged = own.withColumn("reason", _reason(F.col("entity_type"), F.col("text"), policy))
    # a sweep over what passes: a span that begins before the furthest end so far lies over another
    good = judged.where("reason is null").withColumn("furthest", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    good = good.withColumn("reason", F.when(F.col("start") < F.col("furthest"), "duplicate")).drop("furthest")
    every = good.unionByName(judged.where("reason is not null")).withColumn("action", _action(F.col("reason"), F.col("repairs")))
    return every.select("doc_id", "entity_type", "start", "end", "text", "action", "reason").unionByName(outside)
