import math
import random

import numpy as np
import pytest

from quillon.llm import toxicity

from .helpers import clashing, docs, empty
from .test_quality import held

LABELS = "doc_id long, quality int, toxic int, x string"
NEUTRAL = ["the", "of", "house", "river", "runs", "over", "and", "stones", "slowly", "bright", "maison", "für"]
BAD = ["vile", "scoundrel", "Rotten", "wretch"]


def corpus(n=500):
    rng = random.Random(5)
    texts, marks = [], []
    for _ in range(n):
        words = [rng.choice(NEUTRAL) for _ in range(rng.randrange(20, 120))]
        bad = rng.random() < 0.25
        for _ in range(rng.randrange(3, 6) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        texts.append(" ".join(words) + ".")
        marks.append(int(bad))
    return texts, marks


def slow_segments(scores):
    """Maximal segments by their definition: the best one (shortest, then first), then the same on both sides of it."""

    def within(a, b):
        best = max(((sum(scores[i:j]), i - j, -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None, key=lambda x: (round(x[0], 9), *x[1:3]))
        if best is None or best[0] <= 1e-9:
            return []
        s, *_, i, j = best
        return [*within(a, i), (i, j, round(s, 6)), *within(j, b)]

    return within(0, len(scores))


def test_segments_against_definition():
    rng = random.Random(1)
    for _ in range(300):
        weights = [rng.choice([0, 0, 0, rng.uniform(-2, 4), rng.uniform(1, 3)]) for _ in range(rng.randrange(0, 14))]
        at = [i for i, w in enumerate(weights) if w]
        got = toxicity.maximal_segments(at, [weights[i] for i in at], 0.7)
        assert [(a, b, round(s, 6)) for a, b, s in got] == slow_segments([w - 0.7 for w in weights])


def test_segments_are_linear():
    n = 300_000
    for weights in ([2.0] * n, [1.5 + (i % 7) for i in range(n)], [3.0 if i % 2 else -9.0 for i in range(n)], [1.5 + i / n for i in range(n)]):
        assert toxicity.maximal_segments(range(0, 3 * n, 3), weights)


def test_held_out_accuracy_and_passages(spark):
    texts, marks = corpus()
    odd = ["", None, "word " * 100_000, "vile WRETCH scoundrel rotten vile wretch"]
    d = clashing(docs(spark, *texts, *odd), "label", "score", "held_out", "segments", "word", "toxic")
    labels = spark.createDataFrame([(i, 0, m, "c") for i, m in enumerate(marks)] + [(0, 0, None, "c"), (None, 0, 1, "c")], LABELS)
    got = {r.doc_id: r for r in toxicity.classify(d, labels).collect()}
    assert len(got) == len(texts) + len(odd) and all(r.held_out == held(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    own = [i for i in range(len(texts)) if held(i)]
    assert sum(got[i].predicted == marks[i] for i in own) >= 0.97 * len(own)
    assert [got[len(texts) + i].predicted for i in range(4)] == [0, 0, 0, 1]
    # held-out labels teach nothing
    flipped = spark.createDataFrame([(i, 0, 1 - m if held(i) else m, "c") for i, m in enumerate(marks)], LABELS)
    again = {r.doc_id: r.score for r in toxicity.classify(d, flipped).collect()}
    assert all(abs(again[i] - r.score) < 1e-9 for i, r in got.items())
    found = toxicity.passages(d, labels).collect()
    whole = texts + odd
    assert all(whole[r.doc_id][r.start : r.end] == r.text and r.expected < toxicity.ALPHA for r in found)
    last = [r for r in found if r.doc_id == len(whole) - 1]
    assert [r.text for r in last] == [odd[-1]]
    per_doc = {}
    for r in found:
        per_doc[r.doc_id] = per_doc.get(r.doc_id, 0) + 1
    assert all(per_doc.get(i, 0) == r.n_passages for i, r in got.items())


def test_against_plain_counts(spark):
    """Weights, LAMBDA, K, evidence and scores worked out without Spark."""
    texts, marks = corpus(240)
    texts, marks = texts + texts[:20], marks + marks[:20]  # copies
    labels = spark.createDataFrame([(i, 0, m, "c") for i, m in enumerate(marks)], LABELS)
    d = docs(spark, *texts)
    got = {r.doc_id: r for r in toxicity.classify(d, labels).collect()}
    words = [[w.lower().strip(".") for w in t.split()] for t in texts]
    known = [i for i in range(len(texts)) if not held(i)]
    n = [sum(marks[i] == c for i in known) for c in (0, 1)]
    share = n[1] / sum(n)
    weights = {}
    for w in {w for i in known for w in words[i]}:
        own = [sum(w in words[i] for i in known if marks[i] == c) for c in (0, 1)]
        a, b = own[1] + share, own[0] + 1 - share
        odds, sd = math.log(a / b) - math.log(share / (1 - share)), math.sqrt(1 / a + 1 / b)
        if sum(own) >= 3 and abs(odds) > 2 * sd:
            weights[w] = math.copysign(abs(odds) - sd, odds)
    model = toxicity.weigh(d, labels)
    assert {k.decode(): v for k, v in model.weights.items()} == pytest.approx(weights)
    clean = [weights.get(w, 0.0) - 1 for i in known if marks[i] == 0 for w in words[i]]
    if max(clean) > 0:
        assert np.mean(np.exp(model.rate * np.array(clean))) == pytest.approx(1)
    segments = [slow_segments([weights.get(w, 0.0) - 1 for w in ws]) if set(ws) & set(weights) else [] for ws in words]
    top = [max((s for *_, s in x), default=0.0) for x in segments]
    of = [i for i in known if marks[i] == 0]
    k = (sum(top[i] > 0 for i in of) + 1) / (sum(len(words[i]) * math.exp(-model.rate * top[i]) for i in of) + 1)
    evidence = [sum(max(model.rate * s - math.log(k * len(ws)) + math.log(0.05), 0) for *_, s in x) for ws, x in zip(words, segments)]
    order = sorted(range(len(texts)), key=lambda i: evidence[i])
    assert all(got[a].score <= got[b].score + 1e-12 for a, b in zip(order, order[1:]) if evidence[b] - evidence[a] > 1e-6)
    assert all(got[i].n_passages == sum(model.rate * s - math.log(k * len(words[i])) > -math.log(0.05) for *_, s in segments[i]) for i in got)


def test_few_labels(spark):
    d = docs(spark, "a", "b", None)
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in toxicity.classify(d, none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 0, 1, "c") for i in range(3)], LABELS)
    assert all(r.score > 0.5 for r in toxicity.classify(d, one).collect())
    assert toxicity.classify(empty(spark), none).count() == 0 and toxicity.passages(empty(spark), none).count() == 0


def test_monotone():
    assert toxicity.monotone(np.array([0.0]), np.array([0.0])) == [0.5]
    levels = toxicity.monotone(np.array([1.0, 5, 0, 3, 9]), np.array([100.0, 10, 0, 10, 10]))
    assert levels == sorted(levels) and len(levels) == 5 and levels[1] == levels[3]
