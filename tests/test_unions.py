"""Guarded unions against a union-find that takes links one after another."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import unions

LINKS = "left string, right string, ord struct<phase:int,at:long,by:string,id:string>"


def slow(nodes, links):
    root, keys = {n: n for n in nodes}, {n: set(k or ()) for n, k in nodes.items()}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for left, right, _ in sorted(links, key=lambda x: x[2]):
        a, b = find(left), find(right)
        if a != b and not (keys[a] and keys[b] and not keys[a] & keys[b]):
            root[b] = a
            keys[a] |= keys[b]
    groups = {}
    for n in nodes:
        groups.setdefault(find(n), []).append(n)
    return {n: min(g) for g in groups.values() for n in g}


def guarded(spark, nodes, links):
    entities = spark.createDataFrame([(n, k) for n, k in nodes.items()], "node string, keys array<string>")
    return {r.node: r.subject for r in unions.guarded(entities, spark.createDataFrame(links, LINKS)).collect()}


@pytest.mark.parametrize(("groups", "in_task"), [(25, 10_000), (3, 0)])
def test_random_orders(spark, monkeypatch, groups, in_task):
    monkeypatch.setattr(unions, "IN_TASK", in_task)
    rng = random.Random(11)
    nodes, links = {}, []
    for g in range(groups):  # many small documents at once, of which most have conflicts
        own = [f"{g:02}-{i}" for i in range(rng.randrange(2, 12))]
        nodes |= {n: rng.sample("pqr", rng.choice([0, 0, 1, 1, 2])) or None for n in own}
        for i in range(rng.randrange(1, 16)):
            a, b = rng.choice(own), rng.choice(own)
            links.append((a, b, (0, rng.randrange(1000), f"{i:02}", b)))
    assert guarded(spark, nodes, links) == slow(nodes, links)


def test_order_decides(spark):
    nodes = {"a": ["p"], "b": None, "c": ["q"], "d": ["p", "q"]}
    early = [("a", "b", (0, 1, "", "b")), ("b", "c", (0, 2, "", "c")), ("a", "d", (0, 3, "", "d")), ("b", "c", (0, 4, "", "c"))]
    assert guarded(spark, nodes, early) == slow(nodes, early) == {"a": "a", "b": "a", "c": "a", "d": "a"}
    assert guarded(spark, nodes, early[:3]) == {"a": "a", "b": "a", "c": "c", "d": "a"}
    late = [("a", "b", (0, 1, "", "b")), ("a", "d", (0, 2, "", "d")), ("b", "c", (0, 3, "", "c"))]
    assert set(guarded(spark, nodes, late).values()) == {"a"}
    assert guarded(spark, {"x": None}, []) == {"x": "x"}


@pytest.mark.parametrize("in_task", [10_000, 0])
def test_hot_block(spark, monkeypatch, in_task):
    """5,000 mentions of one token: all that may be linked are, in a few rounds."""
    monkeypatch.setattr(unions, "IN_TASK", in_task)
    nodes = {f"n{i:04}": [["p"], ["q"], None][i % 3] for i in range(5000)}
    entities = spark.createDataFrame([(1, n, int(n[1:]), ["t"], k) for n, k in nodes.items()], "doc_id long, node string, pos long, tokens array<string>, keys array<string>")
    links = unions.token_links(entities)
    assert links.count() == 4999
    got = {r.node: r.subject for r in unions.guarded(entities, links).collect()}
    assert got == {n: "n0000" if i % 3 != 1 else n for i, n in enumerate(nodes)}


def test_links_and_pairs(spark):
    rows = [
        (1, "a", 0, "org", "华信有限公司", None, None), (1, "b", 5, "org", "北京华信有限公司", "k1", None), (1, "c", 9, "org", "华信有限公司", "k2", "甲方"), (1, "d", 12, "org", "信有限公司", None, "乙方"),
        (1, "e", 20, "person", "华信有限公司", None, None), (1, "f", 30, "org", "公司", None, None), (2, "g", 0, "org", "北京华信有限公司", None, None), (2, "h", 1, "org", None, None, None),
    ]
    own = spark.createDataFrame(rows, "doc_id long, node string, pos long, family string, text string, canonical string, role string")
    got = {(r.left, r.right) for r in unions.contained_links(own).collect()}
    pair = own.alias("l").join(own.alias("r"), F.expr("l.doc_id = r.doc_id and l.node < r.node"))
    s = lambda side: F.struct(*[F.col(f"{side}.{c}").alias(c) for c in ("family", "text", "canonical", "role")])
    linked = pair.where(unions.share_identity(s("l"), s("r"))).select("l.node", "r.node", F.expr("l.text = r.text").alias("equal")).collect()
    assert got == {("a", "b"), ("a", "d"), ("b", "d")}
    assert {(r[0], r[1]) for r in linked if not r.equal} == got and {(r[0], r[1]) for r in linked if r.equal} == {("a", "c")}


@pytest.mark.parametrize("in_task", [10_000, 5])
def test_groups_stream_by(spark, monkeypatch, in_task):
    """F3, F16: what streams by group is what rounds give, with and without groups that are too large for a task."""
    from quillon.operators import identity

    rng = random.Random(3)
    nodes = [(d, f"{d}:{i}", rng.choice([None, ["k1"], ["k2"], ["k1", "k3"]])) for d in range(6) for i in range(9)]
    links = [(d, f"{d}:{a}", f"{d}:{b}", (0, rng.randrange(4), "t", f"{d}:{b}")) for d in range(6) for a, b in (rng.sample(range(9), 2) for _ in range(2 + 2 * d))]
    entities, edges = spark.createDataFrame(nodes, "doc_id long, node string, keys array<string>"), spark.createDataFrame(links, "doc_id long, " + LINKS)
    want = slow({n: k for _, n, k in nodes}, [((x[1], x[2], (x[3], x[1], x[2]))) for x in links])
    monkeypatch.setattr(unions, "IN_TASK", in_task)
    monkeypatch.setattr(identity, "IN_TASK", in_task)
    got = {r.node: r.subject for r in unions.guarded(entities, edges, "doc_id").collect()}
    assert got == want
    cards = spark.createDataFrame([(d, rng.randrange(12), rng.choice("abcdef")) for d in range(5) for _ in range(2 + 2 * d)], "doc_id long, card long, surface string")
    assert sorted(identity.card_components(cards).collect()) == sorted(identity._components_in_rounds(cards.distinct()).select("doc_id", "card", "subject").collect())
