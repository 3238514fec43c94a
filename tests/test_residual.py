"""Residual mentions against a search that looks at every place again in every round."""

import random
import time

from quillon.operators import residual

MEMORY = "doc_id long, entity_type string, key string, surface string"
SPANS = "doc_id long, start int, end int"


def slow(text, surfaces, spans):
    taken, out, n = list(spans), [], 0
    while True:
        n, before = n + 1, len(out)
        for kind, key, s in surfaces:
            at, end = 0, 0
            while (at := text.find(s, end)) >= 0:
                end = at + len(s)
                if not any(at < e and end > b for b, e in taken):
                    taken.append((at, end))
                    out.append((kind, key, s, at, end, n))
                    break
        if len(out) == before:
            return out


def test_against_slow_search(spark):
    rng = random.Random(2)
    docs, memory, spans, want = [], [], [], set()
    for d in range(30):
        text = "".join(rng.choice("ab华 ") for _ in range(rng.randrange(0, 200)))
        own = sorted({(k, "key", s) for k in "PQ" for s in {"".join(rng.choice("ab华") for _ in range(rng.randrange(2, 5))) for _ in range(6)}}, key=lambda x: (x[0], x[1], -len(x[2]), x[2]))
        held = [(a, a + rng.randrange(6)) for a in (rng.randrange(200) for _ in range(rng.randrange(5)))]
        docs.append((d, text))
        memory += [(d, *o) for o in own]
        spans += [(d, *h) for h in held]
        want |= {(d, *x) for x in slow(text, own, [h for h in held if h[1] > h[0]])}
    rng.shuffle(memory)
    table = spark.createDataFrame(memory * 2 + [(0, "P", "key", None), (1, "P", "key", "a"), (99, "P", "key", "absent")], MEMORY)
    got = residual.materialized(spark.createDataFrame([*docs, (99, None), (98, "ab ab")], "doc_id long, text string"), table, spark.createDataFrame(spans, SPANS))
    rows = {tuple(r) for r in got.collect()}
    assert rows == want and max(r[-1] for r in rows) > 4 and got.count() == len(rows)
    first = {tuple(r)[:6] for r in residual.materialized(spark.createDataFrame(docs, "doc_id long, text string"), table, spark.createDataFrame(spans, SPANS), 1).collect()}
    assert first == {r[:6] for r in want if r[6] == 1}


def test_hits_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "alpha beta alpha gamma beta")], "doc_id long, text string")
    memory = spark.createDataFrame([(1, "P", "k", "alpha"), (1, "P", "k", "alpha b"), (1, "P", "k", "delta"), (1, "Q", "k", "beta")], MEMORY)
    got = {(r.surface, r.start) for r in residual.hits(docs, memory, spark.createDataFrame([(1, 0, 5)], SPANS)).collect()}
    assert got == {("alpha", 11), ("beta", 6)}
    assert residual.hits(docs, memory.where("false"), spark.createDataFrame([], SPANS)).count() == 0


def test_tens_of_thousands_of_surfaces():
    """One pass over a text of half a million characters, with 50,000 surfaces."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(5, 12))) for _ in range(50_000)]
    text = " ".join(words)
    began = time.time()
    got = list(residual.rounds(text, [("P", "k", w) for w in dict.fromkeys(words)], [(i, i + 3) for i in range(0, len(text), 1000)], None))
    assert time.time() - began < 20 and len(got) > 45_000
    covered = sorted((a, b) for *_, a, b, _ in got)
    assert all(b <= c for (_, b), (c, _) in zip(covered, covered[1:]))
