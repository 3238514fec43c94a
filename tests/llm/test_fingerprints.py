import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from quillon.llm import fingerprints as fp

from .helpers import clashing, docs, empty


def slow_syncmers(text, s=fp.S):
    """Closed syncmers one by one, by the hashes of the operator."""
    hashes, places = fp.syncmers(text, s)
    inner = {}
    for i in range(len(text) - s + 1):
        inner[i] = _inner(text[i : i + s])
    want = [i for i in range(len(text) - 2 * s + 1) if min(inner[j] for j in range(i, i + s + 1)) in (inner[i], inner[i + s])]
    return places.tolist(), want, hashes


def _inner(piece):
    h = 0
    for c in piece:
        h = (h * 0x9E3779B97F4A7C15 + ord(c)) % (1 << 64)
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) % (1 << 64)
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) % (1 << 64)
    return h ^ (h >> 31)


def test_anchors_depend_on_themselves_alone():
    rng = random.Random(1)
    text = "".join(rng.choice("abcdé 😀") for _ in range(400))
    got, want, hashes = slow_syncmers(text)
    assert got == want and 0.2 < len(got) / len(text) < 0.45
    later, places = fp.syncmers("zzz" + text + "yy")
    shifted = dict(zip((places - 3).tolist(), later.tolist(), strict=True))
    assert all(shifted[i] == h for i, h in zip(got, hashes.tolist(), strict=True))


def test_likeness():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    a, b = " ".join(words[:600]), " ".join(words[1000:1600])
    assert fp.likeness(fp.fingerprint(a), fp.fingerprint(a)) == 1
    assert fp.likeness(fp.fingerprint(a), fp.fingerprint(b)) < 0.1
    assert 0.6 < fp.likeness(fp.fingerprint(a), fp.fingerprint(fp.edit(a, b))) < 0.9
    moved, n = fp.shift(fp.fingerprint(a), fp.fingerprint("shift by 12 " + a))
    assert moved == 12 and n > 60
    assert fp.likeness("", "") == 1 and fp.likeness("", fp.fingerprint("x")) == 0
    assert fp.fingerprint("abc") != fp.fingerprint("abd") and len(fp.fingerprint("abc")) == fp.ANCHOR
    words_ = a.split()
    rng.shuffle(words_)
    halves = " ".join(words[300:600] + words[:300])
    assert fp.likeness(fp.fingerprint(a), fp.fingerprint(halves)) > 0.9  # two runs
    assert fp.likeness(fp.fingerprint(a), fp.fingerprint(" ".join(words_))) < 0.1
    rep = "spam " * 500
    assert fp.likeness(fp.fingerprint(rep), fp.fingerprint(fp.edit(rep, a))) > 0.5


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        edited = fp.edit(text, after)
        a, e, n = fp.fingerprint(text), fp.fingerprint(edited), fp.fingerprint(after)
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, e, fp.likeness(a, e), fp.likeness(a, n)))
    return sorted(map(str, out))


def test_neighbours(spark):
    rng = random.Random(4)
    texts = [None, "", "ab", "abc" * 30, "abc" * 30, "😀" * 40, "w " * 40_000] + ["".join(rng.choice("abc d") for _ in range(rng.randrange(300))) for _ in range(60)]
    rows = [(i * 3 - 20, t) for i, t in enumerate(texts)] + [(None, "null id"), (1, "tie b"), (1, "tie a")]
    for n in (1, 2, 5, len(rows)):
        own = rows[-n:]
        d = clashing(spark.createDataFrame(own, "doc_id long, text string"), "part", "lent", "fingerprint")
        assert sorted(str(tuple(r)) for r in fp.compare_neighbours(d).collect()) == brute(own)
    assert fp.compare_neighbours(empty(spark)).count() == 0
    assert docs(spark).count() == 0


def test_long_texts_keep_all_anchors():
    """A passage of 50 words that two texts of 20,000 words share is found, with its shift."""
    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 10))) for _ in range(n))
    passage = words(50)
    a, b = f"{words(12_000)} {passage} {words(8_000)}", f"{words(3_000)} {passage} {words(17_000)}"
    one, two = fp.fingerprint(a), fp.fingerprint(b)
    assert len(one) >= fp.ANCHOR * len(fp.syncmers(a)[0])
    moved, n = fp.shift(one, two)
    assert moved == b.index(passage) - a.index(passage) and n > 50
    assert fp.likeness(one, two) >= 2 * n / (len(one) + len(two)) * fp.ANCHOR > 0


def test_one_scheme_at_every_length():
    """A text and its first three quarters, or near copies, are alike on both sides of any length."""
    rng = random.Random(7)
    text = "".join(rng.choice("abcdefgh ijklmnop") for _ in range(400))
    found = {n: [fp.likeness(fp.fingerprint(text[i : i + n]), fp.fingerprint(fp.edit(text[i : i + n], ""))) for i in range(100)] for n in (4, 8, 13, 40, 64, 70, 85, 90, 300)}
    assert all(min(v) > 0 for v in found.values())
    # texts of 4 code points have one or two anchors
    assert all(0.75 < sum(v) / len(v) < 0.95 for n, v in found.items() if n > 4), found
    assert fp.likeness(fp.fingerprint(text[:63]), fp.fingerprint(text[:70])) > 0.8
    assert fp.likeness(fp.fingerprint(text[:63]), fp.fingerprint("zz" + text[:68])) > 0.5
    assert fp.likeness(fp.fingerprint(text[:63]), fp.fingerprint(text[200:270])) < 0.1


def test_matches_by_chance_do_not_count():
    """A lone equal anchor elsewhere in the text is no likeness; equal anchors of one movement are."""
    a, b = fp._pack(np.array([5, 9], dtype=np.uint64), np.array([0, 40], dtype=np.uint64)), fp._pack(np.array([5, 7], dtype=np.uint64), np.array([300, 2], dtype=np.uint64))
    assert fp.likeness(a, b) == 0 and fp.likeness(a, a) == 1
    moved = fp._pack(np.array([5, 9], dtype=np.uint64), np.array([300, 340], dtype=np.uint64))
    assert fp.likeness(a, moved) == 1 and fp.shift(a, moved) == (300, 2)


def test_anchors_and_places_in_six_characters():
    """All anchors of a text come back from its fingerprint, at six characters each: places stand close together."""
    rng = random.Random(8)
    for text in ("", "a", "abcd", "ab" * 500, "a" * 3000, "😀é" * 300, "".join(rng.choice("abcdefgh ijklmnop") for _ in range(20_000))):
        hashes, places = fp._anchors(text)
        print_ = fp.fingerprint(text)
        assert len(print_) == 6 * len(hashes)
        assert all((a == b).all() and len(a) == len(b) for a, b in zip(fp._unpack(print_), (hashes, places), strict=True))
    odd = np.array([3, 2**32 - 1, 0, 7, 9], dtype=np.uint64), np.array([2**32 - 1, 5, 5, 40, 0], dtype=np.uint64)
    assert all((a == b).all() for a, b in zip(fp._unpack(fp._pack(*odd)), odd, strict=True))


def test_each_range_in_its_own_partition(spark):
    """Ranges are dealt evenly: none shares a partition with another while partitions stay empty."""
    d = docs(spark, *(f"text of document {i}" for i in range(400)))
    sizes = [r[0] for r in fp.compare_neighbours(d).groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 2 * min(sizes)
