import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions.text import anchors
from quillon.operators import align, coverage, evaluate, gate, identity, recognize, report, resolve, units
from quillon.plans.common import RULES

CONTRACT = (
    "甲方：北京示例科技有限公司（以下简称“示例科技”）\n统一社会信用代码：91350100M000100Y43\n联系人：张三  联系电话：138-1234-5678\n"
    "身份证号：11010519491231002X\n开户行账号：6222020000001234\n金额：1,200.50万元，签于2024年3月5日，邮箱 a.b@example.com。"
)


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_contract_rules(spark):
    spans = recognize.recognize(docs(spark, CONTRACT), recognize.CONTRACT_RULES)
    found = {(r.entity_type, r.text) for r in spans.collect()}
    assert found >= {("CN_CREDIT_CODE", "91350100M000100Y43"), ("CN_PHONE", "138-1234-5678"), ("CN_ID_CARD", "11010519491231002X"), ("CN_BANK_CARD", "6222020000001234"), ("AMOUNT", "1,200.50万元"), ("DATE", "2024年3月5日"), ("EMAIL_ADDRESS", "a.b@example.com")}
    assert all(CONTRACT[r.start : r.end] == r.text for r in spans.collect())
    assert {r.entity_type for r in recognize.recognize(docs(spark, CONTRACT), recognize.CONTRACT_RULES, ["DATE"]).collect()} == {"DATE"}
    assert recognize.recognize(docs(spark, CONTRACT), recognize.CONTRACT_RULES, []).count() == 0
    assert recognize.checked(spans).where("entity_type = 'CN_ID_CARD'").first().score == 0.99
    assert recognize.relabelled(spans, docs(spark, CONTRACT)).count() > 0
    assert [tuple(r)[1:] for r in recognize.aliases(docs(spark, CONTRACT)).collect()] == [("北京示例科技有限公司", "示例科技")]
    labels = {(r.label, r.value) for r in recognize.fields(docs(spark, CONTRACT)).collect()}
    assert ("联系人", "张三") in labels and ("联系电话", "138-1234-5678") in labels


def test_bad_rules_are_skipped(spark):
    found = recognize.custom_patterns(docs(spark, "AB-1234"), [{"name": "t", "regex": "[A-Z]{2}-[0-9]+"}, {"name": "bad", "regex": "("}, {"name": "empty", "regex": "x*"}])
    assert [(r.entity_type, r.start, r.end) for r in found.collect()] == [("T", 0, 7)]
    assert recognize.keywords(docs(spark, "x"), {"K": ([" ", ""], 0.5)}).count() == 0


def spans_of(spark, rows):
    return spark.createDataFrame([(d, k, s, e, "x" * (e - s), c, src, p) for d, k, s, e, c, src, p in rows], "doc_id long, entity_type string, start int, end int, text string, score double, source string, priority int")


def fold(rows, key, prefer):
    taken = []
    for new in sorted(rows, key=key):
        at = next((i for i, t in enumerate(taken) if new[2] < t[3] and new[3] > t[2]), None)
        if at is None:
            taken.append(new)
        elif prefer(new, taken[at]):
            taken[at] = new
    return taken


@pytest.mark.parametrize("seed", range(3))
def test_resolution_is_the_greedy_fold(spark, seed):
    rng = random.Random(seed)
    rows = []
    for doc in range(20):
        for _ in range(rng.randrange(1, 12)):
            s = rng.randrange(30)
            rows.append((doc, rng.choice("AB"), s, s + rng.randrange(1, 12), rng.choice([0.5, 0.8, 0.9]), rng.choice(["regex", "ner", "uie", "custom"]), rng.randrange(1, 4)))
    rows = list(dict.fromkeys(rows))
    size = lambda r: r[3] - r[2]
    by_priority = lambda n, o: n[6] < o[6] if n[6] != o[6] else size(n) > size(o) if size(n) != size(o) else n[4] > o[4]
    want = [t for d in range(20) for t in fold([r for r in rows if r[0] == d], lambda r: (r[2], r[6], -size(r), -r[4], r[1], r[5]), by_priority)]
    got = [tuple(r[c] for c in ("doc_id", "entity_type", "start", "end", "score", "source", "priority")) for r in resolve.by_priority(spans_of(spark, rows)).collect()]
    assert sorted(got) == sorted(want)
    kinds = {"A": "CN_PHONE", "B": "PERSON"}
    rows = [(r[0], "ALIAS" if r[2] % 5 == 0 else kinds[r[1]], *r[2:]) for r in rows]
    rows = list({r[:6]: r for r in rows}.values())
    rank = resolve.SOURCE_PRIORITY
    sure = lambda r: r[1] == "CN_PHONE"
    specific = {"CN_PHONE": 1, "PERSON": 2, "ALIAS": 3}

    def by_source(n, o):
        if n[2:4] == o[2:4]:
            return specific[n[1]] < specific[o[1]] if n[1] != o[1] else n[4] > o[4]
        if sure(n) != sure(o):
            return sure(n)
        return n[1] == o[1] and size(n) > size(o) and rank[n[5]] <= rank[o[5]] + 2

    want = [t for d in range(20) for t in fold([r for r in rows if r[0] == d], lambda r: (rank[r[5]], -r[4], -size(r), r[2], r[3], r[1]), by_source)]
    got = [tuple(r[c] for c in ("doc_id", "entity_type", "start", "end", "score", "source")) for r in resolve.by_source(spans_of(spark, rows).drop("priority")).collect()]
    assert sorted(got) == sorted(w[:6] for w in want)


def test_rewrite(spark):
    d = docs(spark, "abcdef", "none", "")
    edits = spark.createDataFrame([(0, 0, 2, "X"), (0, 3, 4, ""), (0, 5, 6, "long")], "doc_id long, start int, end int, replacement string")
    assert {tuple(r) for r in resolve.rewrite(d, edits).collect()} == {(0, "Xcelong", 3), (1, "none", 0), (2, "", 0)}


def test_soft_segments_cover_lines(spark):
    rng = random.Random(5)
    text = "\n".join("".join(rng.choice("abc，。 ") for _ in range(rng.randrange(1, 900))) for _ in range(6))
    found = units.soft_segments(units.lines(docs(spark, text)), 100, 20).collect()
    for unit in {r.unit_id for r in found}:
        own = sorted((r.start, r.end, r.text) for r in found if r.unit_id == unit)
        assert all(text[s:e] == t and 0 < e - s <= 100 for s, e, t in own)
        assert all(a[0] < b[0] <= a[1] and b[1] > a[1] for a, b in itertools.pairwise(own))
    covered = {i for r in found for i in range(r.start, r.end)}
    assert covered == {i for line in units.lines(docs(spark, text)).collect() for i in range(line.start, line.end)}


def test_page_groups(spark):
    sizes = [5000, 16000, 100, 25000, 100] + [10] * 12
    pages = spark.createDataFrame([(1, i, n) for i, n in enumerate(sizes)], "doc_id long, page_no int, n_chars long")
    got = [r.group for r in sorted(units.page_groups(pages).collect(), key=lambda r: r.page_no)]
    assert got == [0, 1, 1, 2] + [3] * 10 + [4] * 3


def test_assignment_is_greedy(spark):
    rng = random.Random(2)
    pairs = [(f"l{a}", f"r{b}", rng.choice([0.5, 0.6, 0.8, 0.9])) for a in range(15) for b in range(15) if rng.random() < 0.3]
    left, right, want = set(), set(), set()
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in left and b not in right:
            left.add(a), right.add(b), want.add((a, b, s, "matched" if s >= 0.75 else "mapping_uncertain"))
    assert {tuple(r) for r in align.assign(spark.createDataFrame(pairs, "left_id string, right_id string, score double")).collect()} == want
    assert align.assign(spark.createDataFrame([], "left_id string, right_id string, score double")).count() == 0


def test_assignment_takes_all_copies(spark):
    """60 copies on 70 and rows that overlap them only in part: every link that the walk takes, no matter how many rounds."""
    rng = random.Random(3)
    pairs = [(f"l{a:02}", f"r{b:02}", 1.0) for a in range(60) for b in range(70)]
    pairs += [(f"l{a:02}", f"s{b:02}", 0.9) for a in range(60) for b in range(5)] + [(f"m{a:02}", f"r{b:02}", 0.8) for a in range(8) for b in range(55, 70)]
    pairs += [(f"x{a}", f"y{b}", rng.choice([0.5, 0.6])) for a in range(12) for b in range(12) if rng.random() < 0.6]
    left, right, want = set(), set(), set()
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in left and b not in right:
            left.add(a), right.add(b), want.add((a, b, s))
    got = align.assign(spark.createDataFrame(pairs, "left_id string, right_id string, score double"))
    assert {tuple(r)[:3] for r in got.collect()} == want and len(want) > 70


def test_links_are_those_of_all_candidates(spark):
    """Copies, ties, white space, ids of several texts and null ids: the links of the walk over all pairs of units."""
    rng = random.Random(5)
    starts, ends = ["Lorem ipsum dolor", "Tempor incididunt ut", "Lorem ipsum color"], ["labore et dolore.", "magna aliqua enim.", "quis nostrud exer 123456"]

    def side(name, n):
        rows = [(f"{name}{i}", f"{rng.choice(starts)} {' ' * rng.randrange(2)}{rng.choice(['sit amet', 'sed do', 'elit x', ''])} {rng.choice(ends)}") for i in range(n)]
        rows += [(f"{name}{i}", "a different text 654321 of one id") for i in range(3)] + [(None, rows[0][1]), (f"{name}x", "short"), (f"{name}y", None)]
        return spark.createDataFrame(rows, "unit_id string, text string")

    a, b, by = side("l", 60), side("r", 45), anchors(F.col("text"))
    want, got = align.assign(align.candidates(a, b, by)).drop("shared"), align.links(a, b, by)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 40
    assert align.links(a.where("false"), b, by).count() == 0


def test_copies_are_compared_once(spark):
    """A line that stands 4,000 times on either side makes no 16,000,000 pairs."""
    a, b = (spark.range(4000).select(F.format_string(f"{x}%04d", "id").alias("unit_id"), F.lit("the same footer on every page").alias("text")) for x in "lr")
    got = align.links(a, b, anchors(F.col("text"))).collect()
    assert {tuple(r) for r in got} == {(f"l{i:04}", f"r{i:04}", 1.0, "matched") for i in range(4000)} and len(got) == 4000


def test_coverage_chain(spark):
    u = units.lines(docs(spark, CONTRACT)).withColumn("container_type", F.lit("body")).withColumn("rewritable", F.lit(True))
    plan = {r.category for r in coverage.obligations(u).collect()}
    assert {"party_block", "contact_block", "bank_account_block"} <= plan
    spans = resolve.containing(recognize.recognize(docs(spark, CONTRACT), recognize.CONTRACT_RULES), u)
    status = {r.category: r.status for r in coverage.match(coverage.obligations(u), spans.select("unit_id", "entity_type", "source")).collect()}
    assert status["bank_account_block"] == "satisfied_by_rule" and status["party_block"] == "uncovered"


def test_ledger_blocks_overlaps(spark):
    """A card number within a secret: neither can be rewritten by its exact range, as in the reference."""
    text = "key " + "a" * 4 + "1234567890123456" + "b" * 20 + " and a@b.org"
    u = units.lines(docs(spark, text)).withColumn("rewritable", F.lit(True))
    found = resolve.containing(recognize.recognize(docs(spark, text), RULES), u).withColumn("replacement", F.concat(F.lit("R"), "entity_type"))
    entries = coverage.rewrite_ledger(found, u)
    assert {(r.entity_type, r.status, r.failure_reason) for r in entries.collect()} == {("SECRET", "failed", "range_overlap"), ("BANK_CARD", "failed", "range_overlap"), ("EMAIL_ADDRESS", "ready", None)}
    assert tuple(coverage.export_ready(entries).first()) == (1, 2, 0, 0, False)


def test_renumbering_uses_free_numbers(spark):
    rows = [(1, "a", 1, "公司1"), (1, "b", 2, "公司1"), (1, "c", 3, "公司3"), (1, "d", 4, "公司3"), (2, "e", 1, "公司1")]
    got = {r.subject_id: r.replacement for r in identity.renumbered(spark.createDataFrame(rows, "doc_id long, subject_id string, first_start int, replacement string")).collect()}
    assert got == {"a": "公司1", "b": "公司2", "c": "公司3", "d": "公司4", "e": "公司1"}


def test_components(spark):
    cards = [(1, 1, "x"), (1, 2, "x"), (1, 2, "y"), (1, 3, "y"), (1, 4, "z"), (2, 1, "x")]
    got = {(r.doc_id, r.card): r.subject for r in identity.card_components(spark.createDataFrame(cards, "doc_id long, card long, surface string")).collect()}
    assert got == {(1, 1): 1, (1, 2): 1, (1, 3): 1, (1, 4): 4, (2, 1): 1}


def test_entity_outcomes(spark):
    schema = "id string, doc_id long, entity_type string, text string, start int, end int"
    e = [("e1", 1, "A", "x", 0, 1), ("e2", 1, "A", "y", 5, 8), ("e3", 1, "B", "z", 10, 12), ("e4", 1, "B", "q", 20, 22)]
    a = [("a1", 1, "A", "x", 0, 1), ("a2", 1, "B", "y", 5, 8), ("a3", 1, "B", "zz", 11, 14), ("a4", 1, "C", "n", 40, 41)]
    got = {(r.e_id, r.a_id, r.outcome) for r in evaluate.entity_outcomes(spark.createDataFrame(e, schema), spark.createDataFrame(a, schema)).collect()}
    assert got == {("e1", "a1", "exact"), ("e2", "a2", "type_error"), ("e3", "a3", "boundary_error"), ("e4", None, "missed"), (None, "a4", "false_positive")}


def test_gold_matches(spark):
    schema = "id string, sample_id string, page_no int, old_text string, new_text string"
    e = spark.createDataFrame([("e1", "s", 1, "abc", "abd"), ("e2", "s", 2, "abc", "abd")], schema)
    f = spark.createDataFrame([("f1", "s", 1, "abc", "abd"), ("f2", "s", 1, "abcd", "abd"), ("f3", "s", 3, "abc", "abd")], schema)
    assert [tuple(r)[:2] for r in evaluate.gold_matches(e, f).collect()] == [("e1", "f1")]


def test_terminal_states(spark):
    columns = ["review_task_count", "unresolved_coverage_count", "coverage_gap_count", "model_conflict_count", "suspected_count", "confirmed_count"]
    rows = [(1, 0, 0, 0, 0, 0), (0, 1, 1, 1, 1, 1), (0, 0, 2, 1, 1, 1), (0, 0, 0, 1, 0, 1), (0, 0, 0, 0, 1, 1), (0, 0, 0, 0, 0, 1), (0, 0, 0, 0, 0, 0)]
    got = [r.terminal_state for r in report.terminal_state(spark.createDataFrame(rows, columns)).collect()]
    assert got == ["human_review_required", "human_review_required", "coverage_gap", "model_conflict", "suspected_error", "confirmed_error", "covered"]


@pytest.mark.parametrize(
    ("kind", "text", "canonical", "want"),
    [("COMPANY_NAME", "示例科技有限公司", None, "ORGANIZATION"), ("ORGANIZATION", "某市人民法院", None, "GOVERNMENT"), ("ORGANIZATION", "某银行公司", None, None), ("BANK_NAME", "示例银行", None, None), ("COURT", "某区人民法院", None, "GOVERNMENT"), ("ALIAS", "示例", "示例公司", "ORGANIZATION"), ("ALIAS", "甲方", "示例公司", None), ("ALIAS", "示例", None, None), ("DATE", "2024年", None, None), ("SIGNATORY", "张三", None, "PERSON")],
)
def test_families(spark, kind, text, canonical, want):
    df = spark.createDataFrame([(kind, text, canonical)], "k string, t string, c string")
    assert df.select(gate.family(F.col("k"), F.col("t"), F.col("c"))).first()[0] == want


def test_parallel_names_are_split(spark):
    spans = spans_of(spark, [(1, "PERSON", 3, 12, 0.5, "ner", 1), (1, "PERSON", 20, 23, 0.5, "ner", 1)])
    spans = spans.withColumn("text", F.when(F.col("start") == 3, "张三、李四和王小五").otherwise("独名者"))
    got = sorted((r.start, r.end, r.text, r.score) for r in gate.split_parallel(spans).collect())
    assert got == [(3, 5, "张三", 0.82), (6, 8, "李四", 0.82), (9, 12, "王小五", 0.82), (20, 23, "独名者", 0.5)]


def test_org_core(spark):
    df = spark.createDataFrame([("北京示例科技有限公司",), ("示例（上海）集团",), ("公司",)], "n string")
    assert [r[0] for r in df.select(gate.org_core(F.col("n"))).collect()] == ["示例科技", "示例", "公司"]


def test_bounded_similarity_and_classes_of_candidates(spark):
    """a bounded ratio is the whole one or not above its bound; pairs of classes with their members are all pairs of units."""
    import random

    from quillon.functions import text
    from quillon.functions.text import anchors

    rng = random.Random(5)
    words = [("".join(rng.choices("abcd ", k=rng.randrange(0, 260))), "".join(rng.choices("abcde", k=rng.randrange(0, 260))), rng.choice([0.0, 0.3, 0.5, 0.63])) for _ in range(300)]
    words += [(a[:40] + b, b + a[:9], z) for a, b, z in words] + [(None, "a", 0.1), ("a", "a", 0.9)]
    got = spark.createDataFrame(words, "a string, b string, z double").select("*", text.similarity(F.col("a"), F.col("b")).alias("s"), text.similarity(F.col("a"), F.col("b"), F.col("z")).alias("t")).collect()
    assert all(r.s == r.t or (r.t == 0 and r.s <= r.z) for r in got) and any(r.t == r.s > r.z for r in got) and any(r.t == 0 < r.s for r in got)
    line = lambda i: f"shared phrase {i % 2} of a longer line number {i % 3} and 1234567"
    a, b = (spark.createDataFrame([(f"{s}{i:02d}", line(i * k)) for i in range(n)] + [(f"{s}x", "short")], "unit_id string, text string") for s, n, k in (("a", 30, 1), ("b", 20, 3)))
    want = {tuple(r) for r in align.candidates(a, b, anchors(F.col("text"))).collect()}
    rows = align.class_candidates(a, b, anchors(F.col("text"))).collect()
    members = {"left": {}, "right": {}}
    for r in rows:
        if r.kind != "pair":
            side = r.kind.split("_")[0]
            members[side].setdefault(r[f"{side}_id"], []).append(r.unit_id)
    pairs = [r for r in rows if r.kind == "pair"]
    assert {(x, y, r.shared, r.score) for r in pairs for x in members["left"][r.left_id] for y in members["right"][r.right_id]} == want and len(pairs) < len(want) / 4
