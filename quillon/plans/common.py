"""Tables and relations that the registered queries start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import units
from ..operators.recognize import Rule, recognize

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
CARD = r"[0-9]{16}"
PHONE = r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"
IP = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
SECRET = r"[0-9a-f]{40}"
NUMBER = r"[0-9]{6,}"
WORD = r"[A-Z][a-z]+"
#: Rules without look-around, so that SQL engines of other regular expressions read them alike.
RULES = (
    Rule("SECRET", SECRET, 0.95, 1), Rule("EMAIL_ADDRESS", EMAIL, 0.92, 2), Rule("PHONE", PHONE, 0.92, 2),
    Rule("IP_ADDRESS", IP, 0.88, 3), Rule("BANK_CARD", CARD, 0.90, 4),
)
OVERLAPPING = (*RULES, Rule("LONG_NUMBER", NUMBER, 0.60, 5))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def spans(spark: SparkSession, sf_dir: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return recognize(documents(spark, sf_dir), rules)


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised words as mentions: their type follows from their length, but for a second source that sees places."""
    found = recognize(documents(spark, sf_dir), (Rule("WORD", WORD, 0.8, 5),)).where(F.length("text") >= 3)
    n = F.length("text")
    kind = F.when(F.pmod("start", F.lit(7)) == 0, "LOCATION").when(n <= 5, "PERSON").when(n <= 8, "ALIAS").otherwise("ORGANIZATION")
    return found.withColumn("entity_type", kind).withColumn("source", F.when(kind == "LOCATION", "ner").otherwise("regex")).withColumn("candidate_id", F.concat_ws(":", "doc_id", "start"))


def lines(spark: SparkSession, sf_dir: str, of: Column | None = None) -> DataFrame:
    """Lines of documents (of a condition) as units; those with a tab or bar are table cells, those of long documents can't be
    rewritten."""
    docs = documents(spark, sf_dir)
    found = units.lines(docs if of is None else docs.where(of))
    container = F.when(F.contains("text", F.lit("|")), "table_row").otherwise("body")
    return found.withColumn("container_type", container).withColumn("rewritable", F.col("order_index") < 40)


#: The same relations in SQL.
SQL_GAPS = """list_transform(generate_series(1, len(m)), lambda i: {'start': list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), 'text': m[i]})"""


def sql_matches(kind: str, pattern: str, score: float, priority: int, source: str = "regex") -> str:
    return f"""SELECT doc_id, '{kind}' AS entity_type, CAST(s.start AS INTEGER) AS "start", CAST(s.start + length(s.text) AS INTEGER) AS "end", s.text AS "text", CAST({score} AS DOUBLE) AS score, '{source}' AS source, {priority} AS priority
FROM (SELECT doc_id, unnest({SQL_GAPS}) AS s FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM documents) WHERE len(m) > 0)"""


def sql_spans(rules: tuple[Rule, ...] = RULES) -> str:
    return " UNION ALL ".join(sql_matches(r.kind, r.pattern, r.score, r.priority) for r in rules)


SQL_MENTIONS = f"""SELECT doc_id, CASE WHEN "start" % 7 = 0 THEN 'LOCATION' WHEN length("text") <= 5 THEN 'PERSON' WHEN length("text") <= 8 THEN 'ALIAS' ELSE 'ORGANIZATION' END AS entity_type,
"start", "end", "text", score, CASE WHEN "start" % 7 = 0 THEN 'ner' ELSE 'regex' END AS source, priority, doc_id || ':' || "start" AS candidate_id FROM ({sql_matches('WORD', WORD, 0.8, 5)}) WHERE length("text") >= 3"""
SQL_LINES = """SELECT doc_id, doc_id || ':' || (i - 1) AS unit_id, CAST(i - 1 AS INTEGER) AS order_index, w[i] AS "text",
CAST(coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x) + 1)), 0) AS INTEGER) AS "start",
CAST(coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x) + 1)), 0) + length(w[i]) AS INTEGER) AS "end",
CASE WHEN w[i] LIKE '%|%' THEN 'table_row' ELSE 'body' END AS container_type, i - 1 < 40 AS rewritable
FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents)) WHERE trim(w[i], ' ') <> ''"""
