import random

from pyspark.sql import functions as F

from quillon.llm import mixing

from .helpers import DOCS, clashing, empty


def fill(sizes, weights=(5, 2, 1), most=3):
    """Targets by resharing: sources in order, null last."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, out = sum(sizes.values()), {}
    while len(out) < len(names):
        left = full - sum(out.values())
        open_ = [s for s in names if s not in out]
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return out | share
        out |= {s: float(most * sizes[s]) for s in over}
    return out


def rows(spark, n, seed=0):
    rng = random.Random(seed)
    sources = ["a", "b", "B", "é", "z", None, "tiny"]
    out = []
    for i in range(n):
        s = rng.choices(sources, [20, 3, 3, 2, 1, 1, 0.2])[0]
        out.append((i, "w " * rng.choice([0, 1, 5, 20, 100]), "en", s, 0))
    return spark.createDataFrame([*out, (n, None, "en", "a", 0)], DOCS)


def test_targets_and_totals(spark):
    d = rows(spark, 3000)
    got = mixing.totals(mixing.mix(d, block_docs=64)).collect()
    by_id = {r.doc_id: (r.source, len((r.text or "").split())) for r in d.collect()}
    sizes = {}
    for s, n in by_id.values():
        sizes[s] = sizes.get(s, 0) + n
    want, taken = fill(sizes), {}
    assert len(got) == len(by_id)
    for r in got:
        s, n = by_id[r.doc_id]
        assert (r.size, r.source_size) == (n, sizes[s]) and abs(r.target - want[s]) < 1e-6
        assert r.taken <= 3 * n and (n == 0 or r.taken % n == 0)
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 50 for s in sizes), (taken, want)
    again = mixing.totals(mixing.mix(d.repartition(7), block_docs=64)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_tree_keeps_quotas_and_shares_them(spark):
    q = spark.createDataFrame([(0, 4000), (1, 40), (2, 0), (3, 7)], "rank int, q long")
    for shards in (1, 2, 5, 8):
        bounds = {r.rank: list(r.bounds) for r in mixing.split_tree(q, shards).collect()}
        assert {k: b[-1] for k, b in bounds.items()} == {0: 4000, 1: 40, 2: 0, 3: 7}
        assert all(len(b) == shards and sorted(b) == b for b in bounds.values())
        sizes = [sum(b[i] - (b[i - 1] if i else 0) for b in bounds.values()) for i in range(shards)]
        assert max(sizes) - min(sizes) <= shards
    ones = [mixing.split_tree(q, 2, seed).where("rank = 1").first().bounds[0] for seed in range(30)]
    assert len(set(ones)) > 3 and 17 < sum(ones) / len(ones) < 23


def test_draw(spark):
    d = clashing(rows(spark, 300, 1), "key", "shards", "copies", "__order")
    out = mixing.draw(d)
    assert out.columns == d.columns
    times = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    want = {r.doc_id: len(r.shards) for r in mixing.mix(d).collect() if r.shards}
    assert times == want
    assert mixing.draw(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0
    twice = rows(spark, 20).unionByName(rows(spark, 20))
    assert mixing.mix(twice).count() == 42 and mixing.draw(twice).count() > 0
    assert mixing.mix(spark.createDataFrame([(1, None, "en", None, 0)], DOCS)).select(F.size("shards")).count() == 1


def test_shards_stand_together(spark):
    """Each shard's rows are in one partition, and as many as the mix gave it; a very long text is one document."""
    d = rows(spark, 800, 2).unionByName(spark.createDataFrame([(9_000, "w " * 200_000, "en", "a", 0)], DOCS))
    given = mixing.mix(d, shards=5, block_docs=16).select("doc_id", F.posexplode("shards").alias("copy", "shard"))
    want = {r.shard: r["count"] for r in given.groupBy("shard").count().collect()}
    out = mixing.draw(d, shards=5, block_docs=16).withColumn("part", F.spark_partition_id())
    sizes = sorted(r["count"] for r in out.groupBy("part").count().collect())
    assert sum(sizes) == sum(want.values()) and len(want) == 5
    homes = [{r.shard for r in out.join(given, "doc_id").where(F.col("part") == p).select("shard").distinct().collect()} for p in range(5)]
    assert sum(len(h) > 0 for h in homes) == len(sizes)
    # shards have equal numbers of blocks, so of rows about
    assert max(want.values()) < 2 * min(want.values())


def reached(sizes, most, target):
    """How near any choice of documents, each up to most times, comes to target."""
    sums = {0}
    for n in sizes:
        sums = {s + k * n for s in sums for k in range(most + 1)}
    return min(abs(s - target) for s in sums)


def test_few_long_documents(spark):
    """Sources of some long documents come within one of their shortest, or of three hundredths, of what subset sums can reach."""
    rng = random.Random(8)
    sizes = {f"s{i}": [rng.choice([300, 700, 1100, 2400]) + rng.randrange(200) for _ in range(rng.randrange(3, 9))] + [rng.randrange(20, 90)] for i in range(9)}
    table, i = [], 0
    for s, own in sizes.items():
        for n in own:
            table.append((i, "w " * n, "en", s, 0))
            i += 1
    # rows that agree in id, source and size are taken alike
    table += [(i, "w " * 500, "en", "s0", 0)] * 2
    got = mixing.totals(mixing.mix(spark.createDataFrame(table, DOCS))).join(spark.createDataFrame(table, DOCS).select("doc_id", "source").distinct(), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    for r in got:
        own = sizes[r.source] + ([1000] if r.source == "s0" else [])
        assert abs(r.taken - r.target) <= reached(own, 3, r.target) + max(min(own), 0.03 * r.target), (r, own)
