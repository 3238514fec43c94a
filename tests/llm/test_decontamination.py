import random

import pytest

from quillon.llm import decontamination as dc

from .helpers import clashing, docs, empty

BENCH = "item_id long, text string, key long, item string"


def cases():
    rng = random.Random(8)
    vocabulary = ["a", "b", "c", "é", "1", "中文"]
    item = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, item(10)), (2, item(25)), (3, "lone"), (4, "two words"), (5, None), (6, ""), (7, "?!"), (2, item(12)), (None, item(3)), (11, item(11)), (8, "A-B_c É")]
    texts = [None, "", "none here", "so LONE!", "two  words, TWO WORDS", "a b c é", "a b c É " * 3000]
    for _ in range(60):
        parts = [item(rng.randrange(0, 30))] + [rng.choice([t for _, t in items if t]) for _ in range(rng.randrange(3))] + [item(rng.randrange(0, 30))]
        texts.append(rng.choice([" ", ", ", "\n"]).join(parts))
    return texts, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_against_brute_force(spark, block_bytes):
    texts, items = cases()
    d = clashing(docs(spark, *texts, texts[-1]), "key", "spans", "items", "__key")
    d = d.unionByName(clashing(docs(spark, texts[7]), "key", "spans", "items", "__key")).unionByName(clashing(docs(spark, "other lone"), "key", "spans", "items", "__key"))
    bench = spark.createDataFrame([(*i, 1, "x") for i in items], BENCH)
    got = sorted(tuple(r) for r in dc.summary(dc.find(d, bench, block_bytes=block_bytes)).collect())
    known = [i for i in items if i[0] is not None]
    want = []
    for i, t in [*enumerate([*texts, texts[-1]]), (0, texts[7]), (0, "other lone")]:
        n, hit, ids, digest = dc.brute_force(t, known)
        want.append((i, n, hit, len(ids), digest, hit > 0))
    assert got == sorted(want)


def test_clean(spark):
    d = clashing(docs(spark, "x one two", "fine", None), "__hit", "spans")
    bench = spark.createDataFrame([(1, "one two", 1, "x")], BENCH)
    kept = dc.clean(d, bench)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
    assert dc.find(empty(spark), bench).count() == 0
    assert dc.summary(dc.find(d, spark.createDataFrame([], BENCH))).where("contaminated").count() == 0


def test_long_items_and_several_blocks(spark, monkeypatch):
    """Items are cut into pieces that keep all their windows; clean finds the hits of every block."""
    monkeypatch.setattr(dc, "PIECE_WINDOWS", 7)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    long = " ".join(rng.choice(words) for _ in range(300))
    texts = [" ".join(long.split()[i : i + 10]) for i in range(0, 290, 13)] + [long, None, "", "nothing here", "x " * 50_000]
    bench = spark.createDataFrame([(1, long, 0, "x"), (2, "alone", 0, "x"), (3, "x y", 0, "x")], BENCH)
    d = clashing(docs(spark, *texts), "__hit", "key")
    for block_bytes in (1 << 20, 300):
        got = sorted(tuple(r)[:4] for r in dc.summary(dc.find(d, bench, block_bytes=block_bytes)).collect())
        assert got == [(i, *((n := dc.brute_force(t, [(1, long), (2, "alone")]))[0], n[1], len(n[2]))) if i < len(texts) - 1 else (i, 50_000, 0, 0) for i, t in enumerate(texts)]
        kept = dc.clean(d, bench, block_bytes=block_bytes)
        assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [i for i, n in enumerate(got) if not n[2]]
