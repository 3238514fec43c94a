import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import hard_negatives as hn

from .helpers import clashing

ROWS = "vec_id long, label int, embedding array<float>"


def slow(rows, k=5, low=80, high=100, every=100):
    known = {}
    for i, y, v in rows:
        if i is None or y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own = (y, [math.floor(256 * float(np.float32(x))) for x in v])
        known[i] = min(own, known.get(i, own))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (y, v) in known.items():
        if a % every:
            continue
        scored = sorted((-dot(v, w), i, z) for i, (z, w) in known.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == y][:k]:
            fit = [x for x in scored if x[2] != y and low * -s <= 100 * -x[0] <= high * -s][:k]
            out += [(a, p, r, n, -s, -t) for r, (t, n, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, every=100, **more):
    df = spark.createDataFrame(rows, ROWS)
    got = hn.mine(clashing(df, "v", "pivot", "key", "block", "group", "anchor", "score"), F.col("vec_id") % every == 0, **more)
    assert dict(got.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
    return sorted(map(tuple, got.collect()))


def vectors(n, dim=6, seed=1, spread=0.35, centres=5):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    return [(i, int(rng.integers(3)), [float(x) for x in c[rng.integers(centres)] + spread * rng.normal(size=dim)]) for i in range(n)]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK", 40)
    monkeypatch.setattr(hn, "GROUP", 4)
    rows = vectors(700)
    assert mined(spark, rows, 20) == slow(rows, every=20)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK", 16)
    monkeypatch.setattr(hn, "GROUP", 2)
    rows = vectors(200, dim=3, seed=2)
    rows += [(1000 + i, i % 2, [0.5, 0.25, 0.125]) for i in range(120)]  # a large group of copies: ties by id, one cell
    rows += [(2000, 0, None), (2001, None, [1.0, 1.0, 1.0]), (None, 0, [1.0, 1.0, 1.0]), (2002, 0, [1.0, None, 1.0]), (2003, 1, [float("nan")] * 3), (2004, 1, [float("inf")] * 3)]
    rows += [(2100, 0, []), (2101, 1, [0.5]), (2200, 2, [0.0, 0.0, 0.0]), (3000, 7, [2.0, 2.0, 2.0]), (-100, 1, [0.4, 0.2, 0.1])]
    rows += [(0, 2, [9.0, 9.0, 9.0]), rows[5], rows[7]]  # ids that repeat
    assert mined(spark, rows, 10) == slow(rows, every=10)
    assert mined(spark, rows, 10, k=2, low=50, high=90) == slow(rows, 2, 50, 90, 10)


def test_few_rows(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, 0, [1.0])]) == [] and mined(spark, [(100, 0, [1.0])]) == []
    two = [(100, 0, [1.0, 0.5]), (1, 0, [1.0, 0.5]), (2, 1, [1.0, 0.25])]
    assert mined(spark, two) == slow(two) != []


def test_keys_prune_and_lose_nothing():
    """Blocks out of reach hold no row within the radius; on clustered vectors most are out of reach."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-4000, 4000, size=(12, 8))
    v = centres[rng.integers(12, size=3000)] + rng.integers(-40, 40, size=(3000, 8))
    keys = hn.Keys(hn.fitted_pivots(v[:500]), int((v**2).sum(axis=1).max()), 1.0)
    near, far = keys.of_rows(v)
    keys.width = far.max() / 100
    Cell = __import__("collections").namedtuple("Cell", "pivot bin n anchors low high")
    bins = (far // keys.width).astype(int)
    cells = [Cell(p, b, n, 0, far[(near == p) & (bins == b)].min(), far[(near == p) & (bins == b)].max()) for (p, b), n in Counter(zip(near.tolist(), bins.tolist())).items()]
    keys.blocks = hn.blocks_of(cells)
    block = np.array([next(i for i, x in enumerate(keys.blocks) if x["pivot"] == p and x["first"] <= b <= x["last"]) for p, b in zip(near, bins)])
    anchors = v[rng.integers(3000, size=20)]
    distance = np.sqrt(keys.most + (anchors**2).sum(axis=1)[:, None] - 2.0 * anchors @ v.T)
    radius = np.sort(distance, axis=1)[:, 30]
    inner = np.sort(distance, axis=1)[:, 10]
    touched = keys.touched(anchors, radius, inner)
    for i in range(20):
        assert touched[i][block[(distance[i] >= inner[i]) & (distance[i] <= radius[i])]].all()
    assert not keys.touched(anchors, np.full(20, -1.0), inner).any()


def test_large_components():
    a = np.array([[2**30, -(2**30)], [1, 2]], dtype=np.int64)
    assert hn.products(a, a).tolist() == [[2**61, -(2**30)], [-(2**30), 5]]


@pytest.mark.parametrize("k", [1, 3])
def test_best(k):
    rng = random.Random(k)
    for _ in range(50):
        scores = np.array([rng.randrange(4) for _ in range(12)])
        allowed = np.array([rng.random() < 0.6 for _ in range(12)])
        assert hn._best(scores, allowed, k).tolist() == sorted(np.flatnonzero(allowed), key=lambda i: (-scores[i], i))[:k]
