"""Queries of boundary repair, over contracts that are formed from the order tables and over documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import matches
from ..operators import repair
from ..operators.recognize import Rule, recognize
from .common import documents, sql_matches, table

#: What a digit of a key becomes in a name, and the parts of contracts that keys choose between.
DIGITS = "华信联创东科金鼎恒泰"
PLACES = ("北京市", "上海市", "广东省深圳市", "浙江省杭州市", "")
ENDS = ("有限公司", "股份有限公司", "集团", "公司", "研究院")
LABELS = ("甲方：", "乙方:", "委托方 ", "", "原告：")
WORDS = ("由", "并由与", "经由向对及", "", "随后由为被在与和")
PEOPLE = ("张伟", "王芳", "李建国", "赵敏")


def _pick(words: tuple[str, ...], number: str) -> str:
    return f"CASE {number} % {len(words)} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words)) + " END"


def _name(key: str) -> str:
    return f"translate(CAST({key} AS STRING), '0123456789', '{DIGITS}')"


#: One text, understood by Spark and by DuckDB: a contract for each order, its clause and a name in it.
CONTRACTS = f"""SELECT doc_id, named, clause, concat(clause, '。', remark) AS text FROM (
 SELECT doc_id, named, remark, CASE doc_id % 5
  WHEN 0 THEN concat(label, words, one, '、', two, '以及', three, '共同确认')
  WHEN 1 THEN concat(label, words, one, '，', words, two, '；其他事项')
  WHEN 2 THEN concat(label, person, '担任', one, '负责人')
  WHEN 3 THEN concat(label, words, one, '第', CAST(doc_id AS STRING), '号合同')
  ELSE concat('（', words, one, '与', person, '）') END AS clause FROM (
   SELECT o_orderkey AS doc_id, c_name AS remark, {_name("o_custkey")} AS named,
          concat({_pick(PLACES, "c_nationkey")}, {_name("o_custkey")}, {_pick(ENDS, "o_custkey")}) AS one, concat({_name("o_orderkey % 9973")}, '有限公司') AS two, concat('国家', {_name("c_nationkey")}, '研究所') AS three,
          {_pick(LABELS, "o_orderkey")} AS label, {_pick(WORDS, "(o_orderkey + o_custkey)")} AS words, {_pick(PEOPLE, "o_custkey")} AS person
   FROM orders JOIN customer ON o_custkey = c_custkey))"""
SQL_CONTRACTS = CONTRACTS.replace("AS STRING", "AS VARCHAR")
#: A whole organisation's name where it stands.
SHAPE = r"[一-龥A-Za-z0-9（）()·\-]{2,48}?" + repair.CHINESE.tail

#: Documents: function words of four languages before words, and long words as what a name ends in.
PLAIN_WORDS = tuple("The the Of of And and To to In in Is is It it By by That that La la De de El el Et et Die die Der der".split())
PLAIN = repair.Policy(
    r"(?:Email|Phone|Contact|Address)\s*:?\s*", repair.any_of(PLAIN_WORDS) + r"\s+", r"\s,.;:", "[A-Za-z]{6,}", "[A-Za-z]+(?: [A-Za-z]+)* ?[A-Za-z]{5,}", "[|]", "[;]", ((" and ", "|||||"), (" of ", "||||")),
)
PHRASE = r"[A-Z][a-z]+(?:[ ,]+[a-z]+){1,9}"


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))


def _texts(joined: DataFrame) -> DataFrame:
    return joined.sparkSession.sql(CONTRACTS.replace("orders JOIN customer ON o_custkey = c_custkey", "{joined}"), joined=joined)


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(_joined(spark, sf_dir))


def _raw_spans() -> Column:
    kind = F.when(F.col("doc_id") % 17 == 3, "ADDRESS").when(F.col("doc_id") % 5 == 2, "COMPANY_NAME").otherwise("ORGANIZATION")
    at = F.instr("clause", F.col("named")) - 1
    span = lambda kind, start, end, text, score: F.struct(kind.alias("entity_type"), start.alias("start"), end.alias("end"), text.alias("text"), F.lit(score).cast("double").alias("score"))
    clause = span(kind, F.lit(0), F.length("clause"), F.col("clause"), 0.6)
    bare = span(F.lit("ORGANIZATION"), at, at + F.length("named"), F.col("named"), 0.9)
    return F.array(clause, bare)


def raw_spans(texts: DataFrame) -> DataFrame:
    """What loose recognizers give: the whole clause, and the bare name in it."""
    return texts.select("doc_id", F.inline(_raw_spans()))


def shapes(texts: DataFrame) -> DataFrame:
    return recognize(texts.select("doc_id", "text"), (Rule("ORGANIZATION", SHAPE, 0.9, 1),)).select("doc_id", "start", "end", "text")


def _of_contracts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    texts = contracts(spark, sf_dir)
    return raw_spans(texts), shapes(texts)


def expanded_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, whole = _of_contracts(spark, sf_dir)
    return repair.expanded(raw, whole)


def stepped_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step on every raw span: what the first rule that fits makes of it."""
    raw, _ = _of_contracts(spark, sf_dir)
    made = raw.select("doc_id", F.col("start").alias("from_start"), F.col("end").alias("from_end"), F.explode(repair.step(repair.CHINESE)).alias("n"))
    return made.select("doc_id", "from_start", "from_end", "n.*")


def repaired_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, whole = _of_contracts(spark, sf_dir)
    kept = raw.where("entity_type <> 'ADDRESS'")
    return repair.repaired(kept, repair.CHINESE, whole).withColumn("repairs", F.array_join("repairs", ","))


def split_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of which several came, by the last split that made them."""
    found = repaired_spans(spark, sf_dir).withColumn("split", F.regexp_extract("repairs", "(split_[a-z_]+)", 1)).where("split <> ''")
    return found.select("doc_id", "entity_type", "start", "end", "text", "split", "origin_start", "origin_end")


def rule_first_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts with a key of their own are worked out by themselves; those that share one meet by it."""
    joined = _joined(spark, sf_dir)
    # keys alone tell whether any contracts share one
    twice = lambda name, key: not table(spark, sf_dir, name).groupBy(key).count().where("count > 1").isEmpty()
    if not twice("customer", "c_custkey") and not twice("orders", "o_orderkey"):
        # narrow rows with much work each, which sizes would put into few partitions
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        return _ledger_of_single(_texts(joined.repartition(parts, "o_orderkey")))
    counted = joined.withColumn("copies", F.count("*").over(Window.partitionBy("o_orderkey")))
    single, several = (_texts(counted.where(c)) for c in ("copies = 1", "copies > 1"))
    return _ledger_of_single(single).unionByName(repair.rule_first(raw_spans(several), shapes(several)))


def _ledger_of_single(texts: DataFrame) -> DataFrame:
    found = F.when(F.rlike("text", F.lit(SHAPE)), matches(F.col("text"), SHAPE))
    return repair.rule_first_within(texts.select("doc_id", _raw_spans().alias("spans"), found.alias("shapes")))


def repaired_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recognize(documents(spark, sf_dir), (Rule("ORGANIZATION", PHRASE, 0.5, 1),))
    out = repair.repaired(found, PLAIN)
    return out.select("doc_id", "start", "end", F.md5("text").alias("text_md5"), "score", F.size("repairs").alias("n_repairs"), "origin_start", "origin_end")


def repair_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recognize(documents(spark, sf_dir), (Rule("ORGANIZATION", PHRASE, 0.5, 1),))
    return repair.repair_counts(found, repair.repaired(found, PLAIN), F.length("text") >= 12)


QUERIES = {f.__name__: f for f in (expanded_spans, stepped_spans, repaired_spans, split_subjects, rule_first_ledger, repaired_phrases, repair_states)}


def _q(text: str) -> str:
    return text.replace("'", "''")


def _sql_pieces(policy: repair.Policy, pattern: str, fit: str, name: str) -> str:
    even = '"text"'
    for word, filler in policy.joined:
        even = f"replace({even}, '{_q(word)}', '{filler}')"
    parts = f"string_split_regex({even}, '{pattern}')"
    at = "coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: length(x) + 1)), 0)"
    cut = f"(SELECT list_transform(range(1, len(parts) + 1), lambda i: {{'k': entity_type, 'a': \"start\" + CAST({at} AS INTEGER), 'e': \"start\" + CAST({at} AS INTEGER) + CAST(length(parts[i]) AS INTEGER), 't': substr(\"text\", CAST({at} AS INTEGER) + 1, length(parts[i])), 'r': '{name}'}}) FROM (SELECT {parts} AS parts))"
    return f"(SELECT CASE WHEN len(l) >= 2 THEN l END FROM (SELECT list_filter({cut}, lambda p: regexp_matches(p.t, '{fit}')) AS l))"


def sql_step(policy: repair.Policy) -> str:
    """The same rule of one step in DuckDB's SQL: a list of structs k, a, e, t, r, or null."""
    n = 'CAST(length("text") AS INTEGER)'
    size = lambda p: f"CAST(length(regexp_extract(\"text\", '{_q(p)}')) AS INTEGER)"
    less = lambda left, right, name: f"[{{'k': entity_type, 'a': \"start\" + {left}, 'e': \"end\" - {right}, 't': substr(\"text\", {left} + 1, {n} - {left} - {right}), 'r': '{name}'}}]"
    led, trailed, labelled, noisy, kept = size(f"^[{policy.marks}]+"), size(f"[{policy.marks}]+$"), size(f"^{policy.label}"), size(f"^{policy.noise}"), size(f"(?s)^.*{policy.tail}")
    first = "CASE " + " ".join(
        f"WHEN {x} > 0 AND {x} < {n} THEN {less(*(a, b, name))}"
        for x, a, b, name in ((led, led, "0", "strip_leading_punctuation"), (trailed, "0", trailed, "strip_trailing_punctuation"), (labelled, labelled, "0", "strip_field_label"))
    )
    noise = f"CASE WHEN {noisy} > 0 AND {noisy} < {n} AND regexp_matches(substr(\"text\", {noisy} + 1), '{policy.tail}') THEN {less(noisy, '0', 'strip_leading_noise')} END"
    ends = f"CASE WHEN {kept} > 0 AND {kept} < {n} THEN {less('0', f'({n} - {kept})', 'trim_to_organization_shape')} END"
    steps = [first + " END", _sql_pieces(policy, policy.breaks, f"(?s)^.*{policy.tail}", "split_narrative_subjects"), noise]
    if policy.verbs:
        office = f"(?s)^({policy.person}?)({policy.verbs})(.*{policy.tail})"
        g = [f"CAST(length(regexp_extract(\"text\", '{office}', {i})) AS INTEGER)" for i in (1, 2, 3)]
        part = lambda kind, a, size: f"{{'k': '{kind}', 'a': \"start\" + {a}, 'e': \"start\" + {a} + {size}, 't': substr(\"text\", {a} + 1, {size}), 'r': 'split_person_org_bridge'}}"
        steps.append(f"CASE WHEN {g[0]} > 0 THEN [{part('PERSON', '0', g[0])}, {part('ORGANIZATION', f'({g[0]} + {g[1]})', g[2])}] END")
    steps += [_sql_pieces(policy, policy.joints, f"(?s)^(?:{policy.piece})", "split_parallel_subject"), ends]
    return f"coalesce({', '.join(steps)})"


def sql_repaired(raw: str, policy: repair.Policy) -> str:
    """raw (doc_id, entity_type, start, end, text, score, origin_start, origin_end, repairs as a list) until no rule fits."""
    return f"""w AS (SELECT * FROM ({raw}) UNION ALL
  SELECT doc_id, n.k, n.a, n.e, n.t, greatest(score, {policy.floor}), origin_start, origin_end, list_append(repairs, n.r)
  FROM (SELECT doc_id, score, origin_start, origin_end, repairs, unnest({sql_step(policy)}) AS n FROM w)),
z AS (SELECT doc_id, entity_type, "start", "end", "text", max(score) AS score, min({{'a': origin_start, 'b': origin_end, 'c': repairs}}) AS o FROM w WHERE {sql_step(policy)} IS NULL GROUP BY ALL)"""


SQL_RAW = f"""SELECT doc_id, CASE WHEN doc_id % 17 = 3 THEN 'ADDRESS' WHEN doc_id % 5 = 2 THEN 'COMPANY_NAME' ELSE 'ORGANIZATION' END AS entity_type, 0 AS "start", CAST(length(clause) AS INTEGER) AS "end", clause AS "text", CAST(0.6 AS DOUBLE) AS score FROM c
 UNION ALL SELECT doc_id, 'ORGANIZATION', CAST(strpos(clause, named) - 1 AS INTEGER), CAST(strpos(clause, named) - 1 + length(named) AS INTEGER), named, 0.9 FROM c"""
_SHAPES = sql_matches("ORGANIZATION", SHAPE, 0.9, 1).replace("FROM documents", "FROM c")
#: At each place the smallest shape around a raw span.
SQL_WITH = f"""WITH RECURSIVE c AS ({SQL_CONTRACTS}), raw AS ({SQL_RAW}), h AS ({_SHAPES}),
x AS (SELECT r.*, h."start" AS hs, h."end" AS he, h."text" AS ht FROM raw r LEFT JOIN h ON h.doc_id = r.doc_id AND h."start" <= r."start" AND r."end" <= h."end" AND h."end" - h."start" > r."end" - r."start"
      QUALIFY row_number() OVER (PARTITION BY r.doc_id, r.entity_type, r."start", r."end" ORDER BY h."end" - h."start", h."start" || ':' || h."end") = 1)"""
_GROWN = """SELECT doc_id, entity_type, coalesce(hs, "start") AS "start", coalesce(he, "end") AS "end", coalesce(ht, "text") AS "text", score, "start" AS origin_start, "end" AS origin_end,
 CASE WHEN hs IS NULL THEN CAST([] AS VARCHAR[]) ELSE ['expand_to_full_subject_shape'] END AS repairs FROM x"""
_REPAIRED = f"""{SQL_WITH}, {sql_repaired(_GROWN + " WHERE entity_type <> 'ADDRESS'", repair.CHINESE)}"""
_TYPED = _GROWN.replace("SELECT doc_id, entity_type,", "SELECT doc_id, replace(entity_type, 'COMPANY_NAME', 'ORGANIZATION') AS entity_type,") + " WHERE entity_type <> 'ADDRESS'"
_PHRASES = f"""WITH RECURSIVE raw AS ({sql_matches("ORGANIZATION", PHRASE, 0.5, 1)}), {sql_repaired('''SELECT doc_id, entity_type, "start", "end", "text", score, "start" AS origin_start, "end" AS origin_end, CAST([] AS VARCHAR[]) AS repairs FROM raw''', PLAIN)}"""
ORACLES = {
    "expanded_spans": f"""{SQL_WITH} SELECT doc_id, entity_type, coalesce(hs, "start") AS "start", coalesce(he, "end") AS "end", coalesce(ht, "text") AS "text", score, hs IS NOT NULL AS expanded FROM x""",
    "stepped_spans": f"""WITH c AS ({SQL_CONTRACTS}), raw AS ({SQL_RAW}) SELECT doc_id, from_start, from_end, n.k AS entity_type, n.a AS "start", n.e AS "end", n.t AS "text", n.r AS repair
  FROM (SELECT doc_id, "start" AS from_start, "end" AS from_end, unnest({sql_step(repair.CHINESE)}) AS n FROM raw)""",
    "repaired_spans": f"""{_REPAIRED} SELECT doc_id, entity_type, "start", "end", "text", score, o.a AS origin_start, o.b AS origin_end, array_to_string(o.c, ',') AS repairs FROM z""",
    "split_subjects": f"""{_REPAIRED} SELECT doc_id, entity_type, "start", "end", "text", regexp_extract(array_to_string(o.c, ','), '(split_[a-z_]+)', 1) AS split, o.a AS origin_start, o.b AS origin_end FROM z WHERE len(list_filter(o.c, lambda r: r LIKE 'split%')) > 0""",
    "rule_first_ledger": f"""{SQL_WITH}, {sql_repaired(_TYPED, repair.CHINESE)},
 j AS (SELECT *, CASE WHEN length("text") < 2 THEN 'too_short' WHEN NOT regexp_matches("text", CASE WHEN entity_type = 'PERSON' THEN '^(?:{repair.CHINESE.person})$' ELSE '^(?:{repair.CHINESE.piece})$' END) THEN 'no_subject_shape' END AS reason FROM z),
 g AS (SELECT * EXCLUDE (reason), CASE WHEN "start" < max("end") OVER (PARTITION BY doc_id, entity_type ORDER BY "start", "end" DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'duplicate' END AS reason FROM j WHERE reason IS NULL),
 f AS (SELECT doc_id, entity_type, "start", "end", "text", o, reason FROM g UNION ALL SELECT doc_id, entity_type, "start", "end", "text", o, reason FROM j WHERE reason IS NOT NULL)
 SELECT doc_id, entity_type, "start", "end", "text", CASE WHEN reason IS NOT NULL THEN 'reject' WHEN len(list_filter(o.c, lambda r: r LIKE 'split%')) > 0 THEN 'review' ELSE 'keep' END AS action, reason FROM f
 UNION ALL SELECT doc_id, entity_type, "start", "end", "text", 'reject', 'unsupported_internal_entity_type' FROM raw WHERE entity_type = 'ADDRESS'""",
    "repaired_phrases": f"""{_PHRASES} SELECT doc_id, "start", "end", md5("text") AS text_md5, score, CAST(len(o.c) AS INTEGER) AS n_repairs, o.a AS origin_start, o.b AS origin_end FROM z""",
    "repair_states": f"""{_PHRASES} SELECT 'raw' AS state, count(*) AS n FROM raw UNION ALL SELECT 'boundary_normalized', count(*) FROM z UNION ALL SELECT 'boundary_repaired', count(*) FROM z WHERE len(o.c) > 0
 UNION ALL SELECT r, count(*) FROM (SELECT unnest(o.c) AS r FROM z) GROUP BY r UNION ALL SELECT CASE WHEN length("text") >= 12 THEN 'accepted' ELSE 'rejected' END, count(*) FROM z GROUP BY 1""",
}
