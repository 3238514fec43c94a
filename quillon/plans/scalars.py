"""Queries of the scalar functions and masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import masks, text
from .common import documents, spans, sql_spans, table


def scalar_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return documents(spark, sf_dir).select(
        "doc_id", F.length(text.compact(t)).alias("n_compact"), F.md5(text.compact(t)).alias("compact_md5"),
        F.size(text.numeric_tokens(t)).alias("n_numbers"), F.size(text.page_tokens(F.regexp_replace(t, "[^A-Za-z0-9]+", " "))).alias("n_tokens"),
        F.length(F.left(F.trim(F.regexp_replace(t, r"\s+", " ")), F.lit(120))).alias("n_clean"),
    )


def scalar_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("p_name"), F.col("p_type")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.levenshtein(a, b).alias("distance"), text.bounded_distance(a, b, 12).alias("bounded"),
        F.round(text.edit_similarity(a, b), 6).alias("alike"), F.round(text.similarity(a, F.left(a, F.lit(4))), 6).alias("held"), F.round(text.text_score(a, F.substr(a, F.lit(3))), 6).alias("score"),
    )


def scalar_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", masks.mask(v).alias("masked"), masks.mask(v, n=3, from_end=True).alias("tail"), masks.keep_ends(v, 3, 4).alias("ends"), masks.hashed(v).alias("md5_8"),
        masks.hashed(v, "sha256").alias("sha_16"), masks.redact(v).alias("redacted"), masks.replace(v, F.col("c_mktsegment")).alias("typed"), masks.mask_digits(v).alias("digits"), masks.encrypt(v).alias("token"),
    )


def scalar_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    iso = F.date_format(day, "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", text.mask_date(iso).alias("iso"), text.mask_date(F.date_format(day, "yyyy/M/d")).alias("slashed"), text.mask_date(F.date_format(day, "yyyy年M月d日")).alias("cn"),
        text.mask_date(F.date_format(day, "yyyy-MM")).alias("month"), F.date_format(text.shift_date(day, F.col("o_orderkey").cast("string")), "yyyy-MM-dd").alias("shifted"), masks.mask_digits_keep_year(F.concat(F.lit("No 12 of "), iso)).alias("kept"),
    )


def scalar_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("c_custkey") % 20_000
    return table(spark, sf_dir, "customer").select("c_custkey", text.alpha_index(i).alias("alpha"), text.greek_index(i).alias("greek"), text.serial_index(i).alias("serial"), text.stable_seed(F.col("c_name")).alias("seed"))


def validate_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(spark, sf_dir).where("entity_type in ('BANK_CARD', 'EMAIL_ADDRESS')")
    kind = F.when(F.col("entity_type") == "BANK_CARD", "CN_BANK_CARD").otherwise(F.col("entity_type"))
    v = text.validation(kind, F.col("text"))
    return found.select("doc_id", "start", "text", F.array_join(v["passed"], ",").alias("passed"), F.array_join(v["failed"], ",").alias("failed"), v["confidence"].alias("confidence"))


def typed_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("entity_type") == "BANK_CARD", "CN_BANK_CARD").otherwise(F.col("entity_type"))
    return spans(spark, sf_dir).select("doc_id", "entity_type", "start", masks.mask_typed(kind, F.col("text")).alias("masked"), masks.mask_default(F.col("entity_type"), F.col("text")).alias("plain"))


QUERIES = {f.__name__: f for f in (scalar_text, scalar_similarity, scalar_masks, scalar_dates, scalar_numbers, validate_formats, typed_masks)}
LUHN = "list_sum(list_transform(generate_series(1, length(text)), lambda i: CASE WHEN (length(text) - i) % 2 = 1 THEN (2 * CAST(text[i] AS INTEGER)) // 10 + (2 * CAST(text[i] AS INTEGER)) % 10 ELSE CAST(text[i] AS INTEGER) END)) % 10 = 0"
ALIKE = "1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type))"
GREEK = "αβγδεζηθικλμνξοπρστυφχψω"
ORACLES = {
    "scalar_text": r"""SELECT doc_id, CAST(length(regexp_replace(text, '\s+', '', 'g')) AS INTEGER) AS n_compact, md5(regexp_replace(text, '\s+', '', 'g')) AS compact_md5,
        CAST(len(regexp_extract_all(text, '[0-9]{2,}')) AS INTEGER) AS n_numbers, CAST(len(list_distinct(list_concat(list_concat(list_filter(string_split(lower(regexp_replace(text, '[^A-Za-z0-9]', ' ', 'g')), ' '), lambda t: length(t) BETWEEN 4 AND 40), list_filter([lower(regexp_replace(text, '[^A-Za-z0-9]', '', 'g'))], lambda t: length(t) >= 3)),
          flatten(list_transform(list_filter(string_split(lower(regexp_replace(text, '[^A-Za-z0-9]', ' ', 'g')), ' '), lambda t: length(t) > 40), lambda t: list_filter(list_transform(generate_series(0, length(t) - 1, 18), lambda i: substr(t, i + 1, 18)), lambda c: length(c) >= 6)))))) AS INTEGER) AS n_tokens,
        CAST(length(left(trim(regexp_replace(text, '\s+', ' ', 'g')), 120)) AS INTEGER) AS n_clean FROM documents""",
    "scalar_similarity": f"""SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS INTEGER) AS distance, CAST(least(levenshtein(p_name, p_type), 13) AS INTEGER) AS bounded, round({ALIKE}, 6) AS alike,
        round(CASE WHEN left(p_name, 4) = p_name THEN 1 ELSE 4 / length(p_name) END, 6) AS held,
        CAST(CASE WHEN substr(p_name, 3) = '' THEN 0 ELSE 0.92 END AS DOUBLE) AS score FROM part""",
    "scalar_masks": """SELECT c_custkey, CASE WHEN length(c_name) <= 4 THEN repeat('*', length(c_name)) ELSE repeat('*', length(c_name) - 4) || right(c_name, 4) END AS masked,
        CASE WHEN length(c_name) <= 4 THEN repeat('*', length(c_name)) ELSE left(c_name, length(c_name) - 3) || '***' END AS tail,
        CASE WHEN length(c_name) <= 7 THEN c_name ELSE left(c_name, 3) || repeat('*', length(c_name) - 7) || right(c_name, 4) END AS ends,
        left(md5(c_name), 8) AS md5_8, left(sha256(c_name), 16) AS sha_16, '' AS redacted, '[' || c_mktsegment || ']' AS typed, regexp_replace(c_name, '[0-9]', '*', 'g') AS digits,
        left(to_base64(unhex(array_to_string(list_transform(generate_series(1, length(c_name)), lambda i: printf('%02x', xor(ascii(c_name[i]), ascii(('default_key')[(i - 1) % 11 + 1])))), ''))), 16) || '...' AS token FROM customer""",
    "scalar_dates": """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
        SELECT o_orderkey, year(d) || '-**-**' AS iso, year(d) || '/**/**' AS slashed, year(d) || '年**月**日' AS cn, year(d) || '-**' AS month,
        strftime(d + CAST(CAST('0x' || left(md5(CAST(o_orderkey AS VARCHAR)), 8) AS BIGINT) % 120 + 7 AS INTEGER), '%Y-%m-%d') AS shifted, 'No ** of ' || year(d) || '-**-**' AS kept FROM o""",
    "scalar_numbers": f"""WITH c AS (SELECT c_custkey, c_name, c_custkey % 20000 AS i FROM customer)
        SELECT c_custkey, CASE WHEN i < 26 THEN chr(CAST(65 + i AS INTEGER)) WHEN i < 702 THEN chr(CAST(65 + i // 26 - 1 AS INTEGER)) || chr(CAST(65 + i % 26 AS INTEGER))
          WHEN i < 18278 THEN chr(CAST(65 + (i // 26 - 1) // 26 - 1 AS INTEGER)) || chr(CAST(65 + (i // 26 - 1) % 26 AS INTEGER)) || chr(CAST(65 + i % 26 AS INTEGER))
          ELSE chr(CAST(65 + ((i // 26 - 1) // 26 - 1) // 26 - 1 AS INTEGER)) || chr(CAST(65 + ((i // 26 - 1) // 26 - 1) % 26 AS INTEGER)) || chr(CAST(65 + (i // 26 - 1) % 26 AS INTEGER)) || chr(CAST(65 + i % 26 AS INTEGER)) END AS alpha,
        ('{GREEK}')[i % 24 + 1] || CASE WHEN i >= 24 THEN CAST(i // 24 + 1 AS VARCHAR) ELSE '' END AS greek,
        CASE WHEN i < 10 THEN ('甲乙丙丁戊己庚辛壬癸')[i + 1] ELSE '第' || (i + 1) END AS serial, CAST('0x' || left(md5(c_name), 8) AS BIGINT) AS seed FROM c""",
    "validate_formats": f"""WITH s AS ({sql_spans()}), v AS (SELECT doc_id, "start", text, entity_type = 'EMAIL_ADDRESS' AS mail, entity_type = 'BANK_CARD' AND len(list_distinct(string_split(text, ''))) > 1 AS card,
          CASE WHEN entity_type = 'BANK_CARD' THEN {LUHN} END AS luhn FROM s WHERE entity_type IN ('BANK_CARD', 'EMAIL_ADDRESS'))
        SELECT doc_id, "start", text, CASE WHEN mail THEN 'email_shape' WHEN card AND luhn THEN 'bank_card_shape,luhn' WHEN card THEN 'bank_card_shape' ELSE '' END AS passed,
          CASE WHEN mail OR card THEN '' ELSE 'bank_card_shape' END AS failed, CAST(CASE WHEN mail THEN 0.96 WHEN card AND luhn THEN 0.95 WHEN card THEN 0.88 ELSE 0.35 END AS DOUBLE) AS confidence FROM v""",
    "typed_masks": f"""WITH s AS ({sql_spans()}) SELECT doc_id, entity_type, "start", CASE WHEN entity_type = 'BANK_CARD' THEN left(text, 4) || repeat('*', length(text) - 8) || right(text, 4)
          WHEN entity_type = 'EMAIL_ADDRESS' THEN left(text, 1) || repeat('*', greatest(1, instr(text, '@') - 2)) || substr(text, instr(text, '@')) ELSE repeat('*', length(text)) END AS masked,
          repeat('*', length(text) - 4) || right(text, 4) AS plain FROM s""",
}
