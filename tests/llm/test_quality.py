import random
import zlib

import numpy as np

from quillon.llm import quality

from .helpers import clashing, docs, empty

LABELS = "doc_id long, quality int, toxic int, x string"


def corpus(spark, n=600):
    rng = random.Random(3)
    texts, marks = [], []
    for _ in range(n):
        words = [rng.choice(["the", "of", "house", "river", "runs", "over", "and", "stones", "slowly", "bright"]) for _ in range(rng.randrange(20, 200))]
        bad = rng.random() < 0.3
        if bad:
            kind = rng.randrange(3)
            words = [w + "###" for w in words] if kind == 0 else ["spam"] * len(words) if kind == 1 else [w.upper() + "!!" for w in words]
        texts.append(" ".join(words).capitalize() if not bad else " ".join(words))
        marks.append(int(not bad))
    return texts, marks


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_held_out_accuracy(spark):
    texts, marks = corpus(spark)
    d = clashing(docs(spark, *texts, None, ""), "x", "label", "score", "held_out")
    labels = spark.createDataFrame([(i, m, 0, "c") for i, m in enumerate(marks)] + [(0, None, 0, "c")], LABELS)
    got = {r.doc_id: r for r in quality.classify(d, labels).collect()}
    assert len(got) == len(texts) + 2 and all(r.held_out == held(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    own = [i for i in range(len(texts)) if held(i)]
    assert sum(got[i].predicted == marks[i] for i in own) >= 0.98 * len(own)
    # held-out labels teach nothing
    flipped = spark.createDataFrame([(i, 1 - m if held(i) else m, 0, "c") for i, m in enumerate(marks)], LABELS)
    again = {r.doc_id: r.score for r in quality.classify(d, flipped).collect()}
    assert all(abs(again[i] - r.score) < 1e-9 for i, r in got.items())
    kept = quality.keep(d, labels)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_few_labels(spark):
    d = docs(spark, "a", "b", None)
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in quality.classify(d, none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1, 0, "c") for i in range(3)], LABELS)
    assert {r.predicted for r in quality.classify(d, one).collect()} == {1}
    assert quality.classify(empty(spark), none).count() == 0


def test_against_plain_densities(spark):
    """Scores from class densities written out: shrunk covariances, their inverses and determinants."""
    texts, marks = corpus(spark, 300)
    texts += [None, "", "word " * 100_000]
    labels = spark.createDataFrame([(i, m, 0, "c") for i, m in enumerate(marks)], LABELS)
    got = {r.doc_id: r.score for r in quality.classify(docs(spark, *texts), labels).collect()}
    x = np.array([quality.statistics(t) for t in texts])
    log = []
    for c in (0, 1):
        own = np.array([x[i] for i, m in enumerate(marks) if m == c and not held(i)])
        known = sum(not held(i) for i in range(len(marks)))
        cov = np.cov(own.T)
        cov = (1 - quality.SHRINKAGE) * cov + quality.SHRINKAGE * np.diag(np.diag(cov)) + quality.LEAST * np.eye(quality.N)
        off = x - own.mean(axis=0)
        log.append(np.log(len(own) / known) - 0.5 * np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off) - 0.5 * np.linalg.slogdet(cov)[1])
    want = 1 / (1 + np.exp(-np.clip((log[1] - log[0]) / quality.TEMPER, -500, 500)))
    assert all(abs(got[i] - want[i]) < 1e-6 for i in range(len(texts)))
    assert quality.keep(docs(spark), labels).count() == 0


def test_one_python_node_a_stage(spark, tmp_path, monkeypatch):
    """However few the labels, the statistics and their sums are apart by a shuffle: a task needs one Python worker."""
    rows = docs(spark, *[f"word {i} and more of it" * (1 + i % 4) for i in range(40)])
    spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels")
    labels = spark.read.parquet(f"{tmp_path}/labels")  # a table that Spark knows to be small
    plans, collect = [], type(rows).collect

    def collected(self):
        out = collect(self)
        plans.append(self._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])
        return out

    with monkeypatch.context() as m:
        m.setattr(type(rows), "collect", collected)
        quality.keep(rows, labels)
    between = [p.split("MapInArrow") for p in plans if p.count("MapInArrow") == 2]
    assert between and all("Exchange" in middle for _, middle, _ in between)
