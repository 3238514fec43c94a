import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from quillon.functions import masks, text


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("value", "good"), [("11010519491231002X", True), ("110105194912310021", False), ("11010519491231002", False), ("", False)])
def test_id_number(spark, value, good):
    assert one(spark, text.valid_id_number(F.col("v")), v=value) is good


@pytest.mark.parametrize(("value", "good"), [("91350100M000100Y43", True), ("91350100M000100Y44", False), ("91350100I000100Y43", False)])
def test_credit_code(spark, value, good):
    assert one(spark, text.valid_credit_code(F.col("v")), v=value) is good


def test_mask(spark):
    v = F.col("v")
    assert one(spark, masks.mask(v), v="abc") == "***"
    assert one(spark, masks.mask(v), v="13800000000") == "*******0000"
    assert one(spark, masks.mask(v, n=4, from_end=True), v="13800000000") == "1380000****"
    assert one(spark, masks.keep_ends(v, 3, 4), v="1234567") == "1234567"
    assert one(spark, masks.keep_ends(v, 3, 4, strict=True), v="1234567") == "*******"
    assert one(spark, masks.mask_email(v), v="@x.org") == "*@x.org"
    assert one(spark, masks.mask_email(v), v="a@x.org") == "a*@x.org"
    assert one(spark, masks.mask_email(v), v="abcd@x.org") == "a***@x.org"
    assert one(spark, masks.hashed(v), v="é") == hashlib.md5("é".encode()).hexdigest()[:8]
    key = "default_key"
    xored = bytes(ord(c) ^ ord(key[i % len(key)]) for i, c in enumerate("hello world, hello"))
    assert one(spark, masks.encrypt(v), v="hello world, hello") == base64.b64encode(xored).decode()[:16] + "..."
    assert one(spark, masks.encrypt(v), v="é") is None


@pytest.mark.parametrize(
    ("kind", "value", "masked"),
    [("CN_ID_CARD", "11010519491231002X", "110105********002X"), ("CN_PHONE", "13812345678", "138****5678"), ("CN_PHONE", "1381234567", "**********"), ("CN_CREDIT_CODE", "91350100M000100Y43", "91350100********43"), ("CN_BANK_CARD", "6222020000001234", "6222********1234"), ("AMOUNT", "5万元", "[金额]"), ("X", "abc", "***")],
)
def test_typed(spark, kind, value, masked):
    assert one(spark, masks.mask_typed(F.col("k"), F.col("v")), k=kind, v=value) == masked


@pytest.mark.parametrize(("value", "masked"), [("2024年3月5日", "2024年**月**日"), ("2024-3-5", "2024-**-**"), ("2024/3", "2024/**"), ("3月5日", "[日期]")])
def test_dates(spark, value, masked):
    assert one(spark, text.mask_date(F.col("v")), v=value) == masked


def test_numbers(spark):
    i = F.col("i")
    assert [one(spark, text.alpha_index(i), i=x) for x in (0, 25, 26, 701, 702, 18277, 18278)] == ["A", "Z", "AA", "ZZ", "AAA", "ZZZ", "AAAA"]
    assert [one(spark, text.serial_index(i), i=x) for x in (0, 9, 10)] == ["甲", "癸", "第11"]
    assert [one(spark, text.greek_index(i), i=x) for x in (0, 23, 24)] == ["α", "ω", "α2"]
    assert one(spark, text.stable_seed(F.col("v")), v="x") == int(hashlib.md5(b"x").hexdigest()[:8], 16)
    assert one(spark, text.amount(F.col("v")), v="1,234.5万元") == 12_345_000
    assert one(spark, masks.mask_digits_keep_year(F.col("v")), v="号12于2024年3月，2024") == "号**于2024年*月，****"


def test_similarity(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, text.similarity(a, b), a="abcd", b="abcd") == 1
    assert one(spark, text.similarity(a, b), a="abcd", b="ab") == 0.5
    assert one(spark, text.similarity(a, b), a="abcd", b="abxd") == 0.75
    assert one(spark, text.similarity(a, b), a="", b="") == 1 and one(spark, text.similarity(a, b), a="", b="x") == 0
    assert one(spark, text.similarity(a, b), a="abcd efgh", b="efgh abcd") == pytest.approx(2 * 4 / 18)
    assert one(spark, text.similarity(a, b), a="abxcd", b="abcd") == pytest.approx(8 / 9)
    assert one(spark, text.text_score(a, b), a="abcd", b="ab") == 0.92
    assert one(spark, text.bounded_distance(a, b, 1), a="abcd", b="xyzw") == 2


def test_matches_are_code_points(spark):
    found = one(spark, text.matches(F.col("v"), "b+"), v="😀abbéb")
    assert [tuple(x) for x in found] == [(2, 4, "bb"), (5, 6, "b")]
    assert one(spark, text.matches(F.col("v"), "b+"), v="") == []


def test_page_tokens(spark):
    got = one(spark, text.page_tokens(F.col("v")), v="北京示例科技有限公司，No.12 abc ￥1234")
    cjk = "北京示例科技有限公司"
    assert got == [cjk, "no12", "￥1234", "no12abc", cjk[:8], cjk[:6], cjk[3:9], cjk[:4], cjk[2:6], cjk[4:8], cjk[6:]]
    assert one(spark, text.page_tokens(F.col("v")), v="x" * 45) == ["x" * 18, "x" * 9, "x" * 45]
    assert one(spark, text.page_tokens(F.col("v")), v="") == []


def test_semantic_and_normalize(spark):
    assert one(spark, text.normalize(F.col("v")), v="（甲） 方：A；！") == "(甲)方:A;！"
    assert one(spark, text.semantic(F.col("v")), v="二〇24年 与 2024年03月05日，2024-3-5") == "二024与202435202435"


def test_page_tokens_look_at_a_text_once(spark):
    """the text and what is made of the whole are worked out once each; tokens as before."""
    t = F.regexp_replace("text", "[^A-Za-z0-9]+", " ")
    df = spark.createDataFrame([("abcd, ABCD 北京市朝阳区华信公司 x12y " + "z" * 45,), ("",), (None,)], "text string")
    got = [r[0] for r in df.select(text.page_tokens(F.col("text"))).collect()]
    want = {"abcd", "北京市朝阳区华信公司", "x12y", "z" * 18, "z" * 9, "abcdabcd", "北京市朝阳区华信", "北京市朝阳区", "朝阳区华信公", "北京市朝", "市朝阳区", "阳区华信", "华信公司"}
    assert set(got[0]) >= want and len(got[0]) == len(set(got[0]))
    assert got[1:] == [[], None]
    plan = df.select(text.page_tokens(t).alias("tokens"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("[^A-Za-z0-9]+") == 1


def test_matches_in_one_pass(spark):
    """matches are found once, also in a text that has the mark of matches itself."""
    rows = [("ab 12 cd 345",), (f"1{text.MARK}22{text.MARK}x333",), ("none",), (None,)]
    df = spark.createDataFrame(rows, "text string")
    got = [r[0] and [tuple(m) for m in r[0]] for r in df.select(text.matches(F.col("text"), "[0-9]+").alias("m")).collect()]
    assert got == [[(3, 5, "12"), (9, 12, "345")], [(0, 1, "1"), (2, 4, "22"), (6, 9, "333")], [], got[3]] and not got[3]
