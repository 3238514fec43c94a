import hashlib
import random
import zlib

from quillon.llm import conversation_trie as trie

from .helpers import clashing

ROWS = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def slow(rows):
    own = {}
    for c, t, r, x in sorted((row for row in rows if row[0] is not None), key=lambda row: (row[0], row[1] is not None, row[1] or 0, row[2] or "", row[3] or "")):
        own.setdefault(c, []).append((r or "", x or ""))
    whole = {}
    for c, said in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
        whole[c] = own.get(base, [])[:h] + said[h:]
    nodes = {}
    for c, said in whole.items():
        for d in range(len(said) + 1):
            nodes.setdefault(tuple(said[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        kids = lambda p: sum(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes)
        ends = sorted(c for c in members if len(whole[c]) == len(path))
        out.append((
            min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), kids(path), sum(not kids(p) for p in below),
            sum((len(nodes[p]) - 1) * len(p[-1][1].split()) for p in below if p), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def encoded(spark, rows):
    df = clashing(spark.createDataFrame(rows, ROWS), "a", "b", "depth", "rep", "i", "words", "at", "part")
    got = trie.encode(df)
    kept = got.collect()
    assert all(t == "bigint" for n, t in got.dtypes if n != "ends_sha256")
    # the intervals are those of the tree: each node's holds its children's, one after another
    at = {r.preorder: r for r in kept}
    assert sorted(at) == list(range(len(kept)))
    for r in kept:
        inside = [at[i] for i in range(r.preorder + 1, r.end)]
        assert all(x.depth > r.depth and x.end <= r.end for x in inside) and sum(x.depth == r.depth + 1 for x in inside) == r.n_children
    return sorted((tuple(r[c] for c in COLUMNS) for r in kept), key=repr)


def test_against_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for c in [*range(-25, 60), 1000, 1003, 1019]:
        if rng.random() < 0.9:
            rows += [(c, t, ["user", "assistant"][t % 2], rng.choice(["a", "b c", "c d e"])) for t in range(rng.choice([1, 1, 2, 3, 5]))]
    assert encoded(spark, rows) == slow(rows)


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "x"), (5, None, "user", "first"), (5, 0, None, None), (5, 0, "a", "x"), (5, 0, "a", "x"), (5, 1, "user", ""), (6, 0, "us", "erx"), (6, 1, "user", "x"),
        (7, 3, "user", "x"), (7, 2, "u\x00", "é ü"), (20, 0, "user", "word " * 50_000), (21, 0, "user", "other"), (22, 1, "user", "other"), (23, 0, "user", None), (41, 0, "user", "alone"),
    ]
    assert encoded(spark, rows) == slow(rows)
    assert encoded(spark, []) == []
    assert encoded(spark, [(3, 0, "user", "one turn")]) == slow([(3, 0, "user", "one turn")])


def test_long_conversations_and_copies(spark, monkeypatch):
    """Ranks by pairs of runs, over several levels; one conversation many times, and one that holds a third of all rows."""
    monkeypatch.setattr(trie, "CHUNK", 3)
    rows = [(c, t, "user", f"t{t}" if t < 30 or c % 3 else f"t{t} {c % 2}") for c in range(200, 230) for t in range([5, 31, 47, 30, 29][c % 5])]
    rows += [(c, t, "user", f"same {t}") for c in range(400, 460) for t in range(4)]
    rows += [(900, t, "user", f"t{t}") for t in range(700)]
    small = [r for r in rows if r[0] != 900]
    assert encoded(spark, small) == slow(small)
    whole = encoded(spark, rows)
    assert max(r[1] for r in whole) == 700 and sum(r[1] == 0 for r in whole) == 1
