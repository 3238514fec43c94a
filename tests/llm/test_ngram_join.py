import random

import pytest

from quillon.llm import graph, ngram_join
from quillon.llm.common import words

from .helpers import clashing, docs, empty


def sets(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts, least=75):
    s = [sets(t) for t in texts]
    root = list(range(len(s)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            common = len(s[i] & s[j])
            if s[i] and s[j] and 100 * common >= least * (len(s[i]) + len(s[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(i, len(s[i]), find(i)) for i in range(len(s))]


def edited(rng, base, n):
    out = list(base)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return " ".join(out)


def run(spark, texts):
    return sorted(tuple(r)[:3] for r in ngram_join.join(docs(spark, *texts)).collect())


def test_odd_cases(spark):
    texts = [None, "", " \t\n", "one", "ONE", "one two", "one two three four five", "ÉCOLE a b c d", "école a b c d", "x" * 100_000, "a b c d e f " * 500, "a b c d e f " * 499]
    assert run(spark, texts) == brute(texts)
    assert ngram_join.join(empty(spark)).count() == 0
    clash = clashing(docs(spark, "a b c d e", "a b c d e"), "v", "w", "n", "rep", "comp", "component_id", "prefix", "key")
    assert sorted(tuple(r)[:3] for r in ngram_join.join(clash).collect()) == [(0, 1, 0), (1, 1, 0)]


def test_repeated_ids(spark):
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (5, "other words than those before now"), (7, "a b c d e f g"), (None, "a b c d e f g")]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, 3, -1), (5, 2, 5), (5, 3, 5), (5, 3, 5), (7, 3, 5)]


@pytest.mark.parametrize("seed", range(2))
def test_groups_chains_and_shared_passages(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(6):  # near copies at many distances, in chains
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(8, 120))]
        texts += [edited(rng, base, rng.randrange(0, 4)) for _ in range(rng.randrange(1, 12))]
        step = base
        for _ in range(4):
            step = edited(rng, step, 1).split()
            texts.append(" ".join(step))
    for _ in range(40):  # a passage that most of each text is
        texts.append(" ".join(passage + [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(4, 40))]))
    texts += [" ".join(rng.choice(vocabulary[:6]) for _ in range(rng.randrange(1, 14))) for _ in range(60)]
    texts += ["exact copy of one text with words enough for shingles"] * 30
    rng.shuffle(texts)
    assert run(spark, texts) == brute(texts)


def test_hot_group(spark):
    """A large group whose members are near the threshold of each other: only some pairs link."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    texts = [edited(rng, base, rng.randrange(1, 5)) for _ in range(250)]
    assert run(spark, texts) == brute(texts)


def test_deduplicate(spark):
    near = "a b c d e f g h i j k l m n o p"
    d = clashing(docs(spark, near, near, "z y x w v u t", None, ""), "v", "comp", "__doc")
    kept = ngram_join.deduplicate(d)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4]
    twice = docs(spark, near).unionByName(docs(spark, near))
    assert ngram_join.deduplicate(twice).count() == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(200, 260)] + [(7, 7)]
    got = {r.v: r.comp for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in [100, *range(200, 260)]}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
