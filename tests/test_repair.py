"""Boundary repair and intervals on literal rows, with results worked out by hand or pair by pair."""

import random
from itertools import product

from pyspark.sql import functions as F

from quillon.operators import repair, resolve

SPAN = "doc_id long, entity_type string, start int, end int, text string, score double"


def spans(spark, *texts, kind="ORGANIZATION"):
    return spark.createDataFrame([(i, kind, 10, 10 + len(t), t, 0.5) for i, t in enumerate(texts)], SPAN)


def repaired(spark, *texts, **more):
    rows = repair.repaired(spans(spark, *texts, **more)).orderBy("doc_id", "start").collect()
    assert all(r.text == texts[r.doc_id][r.start - 10 : r.end - 10] and r.origin_start == 10 and r.origin_end == 10 + len(texts[r.doc_id]) for r in rows)
    return [(r.doc_id, r.entity_type, r.text, list(r.repairs)) for r in rows]


def test_each_rule(spark):
    got = repaired(
        spark, "北京华信有限公司", "：北京华信有限公司", "华信集团。；", "甲方：华信集团", "并由华信集团", "由于本案", "华信集团，另由联创公司", "华信公司和联创公司", "华信公司和张三", "李建国担任华信集团经理", "华信公司第3号", "与和",
    )
    org = "ORGANIZATION"
    assert got == [
        (0, org, "北京华信有限公司", []), (1, org, "北京华信有限公司", ["strip_leading_punctuation"]), (2, org, "华信集团", ["strip_trailing_punctuation"]),
        (3, org, "华信集团", ["strip_field_label"]), (4, org, "华信集团", ["strip_leading_noise"]), (5, org, "由于本案", []),
        (6, org, "华信集团", ["split_narrative_subjects"]), (6, org, "联创公司", ["split_narrative_subjects", "strip_leading_noise"]),
        (7, org, "华信公司", ["split_parallel_subject"]), (7, org, "联创公司", ["split_parallel_subject"]), (8, org, "华信公司", ["trim_to_organization_shape"]),
        (9, "PERSON", "李建国", ["split_person_org_bridge"]), (9, org, "华信集团", ["split_person_org_bridge"]),
        (10, org, "华信公司", ["trim_to_organization_shape"]), (11, org, "与和", []),
    ]


def test_many_rounds(spark):
    """A chain of rules longer than any fixed number of rounds, and a split of what came of a split."""
    chain = "甲方：由并由与向对及经为被在与和由" * 2 + "华信集团"
    ((_, _, text, steps),) = repaired(spark, chain)
    assert text == "华信集团" and len(steps) > 20
    several = repaired(spark, "（由华一公司、华二公司和华三公司，与华四公司以及华五公司第9号）")
    assert [x[2] for x in several] == [f"华{n}公司" for n in "一二三四五"]


def test_copies_unite_and_nulls_stay(spark):
    rows = [(1, "ORGANIZATION", 0, 5, "由华信公司", 0.5), (1, "ORGANIZATION", 1, 5, "华信公司", 0.9), (1, "ORGANIZATION", 1, 5, "华信公司", 0.9), (2, "ORGANIZATION", 0, 0, "", 0.1), (3, "ORGANIZATION", 0, 3, None, 0.1)]
    got = repair.repaired(spark.createDataFrame(rows, SPAN)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text, r.score, r.origin_start) for r in got] == [(1, "华信公司", 0.9, 0), (2, "", 0.1, 0), (3, None, 0.1, 0)]
    assert repair.repaired(spark.createDataFrame([], SPAN)).count() == 0


def test_expansion(spark):
    shapes = spark.createDataFrame([(1, 0, 8, "北京华信有限公司"), (1, 2, 8, "华信有限公司"), (2, 0, 4, "甲乙丙丁")], "doc_id long, start int, end int, text string")
    rows = [(1, "ORGANIZATION", 2, 4, "华信", 0.9), (1, "ORGANIZATION", 0, 2, "北京", 0.9), (1, "ORGANIZATION", 0, 8, "北京华信有限公司", 0.9), (3, "ORGANIZATION", 0, 2, "华信", 0.9)]
    got = {(r.doc_id, r.start, r.end, r.text, r.expanded) for r in repair.expanded(spark.createDataFrame(rows, SPAN), shapes).collect()}
    assert got == {(1, 2, 8, "华信有限公司", True), (1, 0, 8, "北京华信有限公司", True), (1, 0, 8, "北京华信有限公司", False), (3, 0, 2, "华信", False)}


def intervals(rng, n, most, width):
    return [(d, a, a + rng.randrange(width)) for d, a in ((rng.randrange(3), rng.randrange(most)) for _ in range(n))]


def test_intervals_against_pairs(spark):
    rng = random.Random(7)
    units = [(d, f"u{i}", a, b) for i, (d, a, b) in enumerate(intervals(rng, 80, 200, 60) + [(0, 0, 4000), (1, 5, 5)])]
    held = intervals(rng, 150, 220, 25) + [(9, 1, 2), (1, 5, 5)]
    own = spark.createDataFrame(held, "doc_id int, start int, end int")
    table = spark.createDataFrame(units, "doc_id int, unit_id string, start int, end int")
    got = {(r.doc_id, r.start, r.end): r.unit_id for r in resolve.containing(own, table).collect()}
    assert got == {s: min(((b - a, u) for d, u, a, b in units if d == s[0] and a <= s[1] and s[2] <= b), default=(0, None))[1] for s in held}
    free = {r.unit_id for r in resolve.outside(table, own).collect()}
    met = {u for (d, u, a, b), (e, s, t) in product(units, held) if d == e and s < t and s < b and t > a}
    assert free == {u[1] for u in units} - met


def test_many_intervals_of_one_document(spark):
    """10^5 lines and 10^5 spans of one document: no product of them."""
    lines = spark.range(100_000).selectExpr("1 AS doc_id", "id AS unit_id", "CAST(id * 50 AS INT) AS start", "CAST(id * 50 + 49 AS INT) AS end")
    found = spark.range(100_000).selectExpr("1 AS doc_id", "CAST(id * 50 + 10 AS INT) AS start", "CAST(id * 50 + 15 AS INT) AS end")
    got = resolve.containing(found, lines)
    assert got.where("unit_id = div(start, 50)").count() == 100_000
    assert resolve.outside(lines, found.where("start % 100 = 10")).count() == 50_000


def test_several_rules_a_job(spark, monkeypatch):
    """F6, F7, F8, F15, F17, F20: a chain of more than 20 rules is written down a few times, not once a rule."""
    calls = []
    monkeypatch.setattr(repair, "checkpointed", lambda df, real=repair.checkpointed: calls.append(1) or real(df))
    ((_, _, text, steps),) = repaired(spark, "甲方：由并由与向对及经为被在与和由" * 2 + "华信集团")
    assert text == "华信集团" and len(steps) > 20 and len(calls) <= len(steps) // 4


def test_rule_first_within_rows(spark, tmp_path, monkeypatch):
    """contracts of keys of their own give the ledger that jobs give, with nothing written down; those that share a key too."""
    from quillon.plans import repairs

    orders, customer = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("orders", "customer"))
    shared = orders.where("o_orderkey % 7 = 0").withColumn("o_custkey", F.col("o_custkey") % 50 + 1)
    for name, more in (("own", orders.limit(0)), ("shared", shared)):
        orders.unionByName(more).write.parquet(f"{tmp_path}/{name}/orders.parquet")
        customer.withColumn("c_name", F.when(F.col("c_custkey") % 9 > 0, "c_name").otherwise(F.lit("与华信集团（由联创公司）"))).write.parquet(f"{tmp_path}/{name}/customer.parquet")
        texts = repairs.contracts(spark, f"{tmp_path}/{name}")
        want = sorted(map(str, repair.rule_first(repairs.raw_spans(texts), repairs.shapes(texts)).collect()))
        written = []
        monkeypatch.setattr(repair, "checkpointed", lambda df, real=repair.checkpointed: written.append(1) or real(df))
        got = repairs.rule_first_ledger(spark, f"{tmp_path}/{name}")
        monkeypatch.undo()
        assert sorted(map(str, got.collect())) == want and bool(written) == (name == "shared")


def test_rule_first_within_literal_rows(spark):
    """nulls, chains, copies of a place, spans within others and unsupported types."""
    texts = ["甲方：由并由与向对及经为被在与和由华信集团", "华信公司和联创公司", "李建国担任华信集团经理", "与和", "", None]
    shapes = spark.createDataFrame([(0, 2, 23, texts[0][2:]), (1, 0, 4, "华信公司"), (1, 2, 1, "")], "doc_id long, start int, end int, text string")
    rows = [(i, kind, 0, len(t) if t is not None else None, t, 0.5) for i, t in enumerate(texts) for kind in ("ORGANIZATION", "COMPANY_NAME", "PERSON_NAME", "ADDRESS")]
    rows += [(1, "ORGANIZATION", 0, 2, "华信", 0.9), (1, "ORGANIZATION", 2, 4, "公司", 0.1), (7, "ORGANIZATION", 0, 8, "北京华信有限公司", 0.5), (7, "ORGANIZATION", 2, 8, "华信有限公司", 0.5)]
    raw = spark.createDataFrame(rows, SPAN)
    held = shapes.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "text")).alias("shapes"))
    docs = raw.groupBy("doc_id").agg(F.collect_list(F.struct("entity_type", "start", "end", "text", "score")).alias("spans")).join(held, "doc_id", "left")
    got, want = repair.rule_first_within(docs), repair.rule_first(raw, shapes)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.where("reason = 'duplicate'").count() > 0
