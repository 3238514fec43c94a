"""Maps of ids against walks along them, one by one."""

import random

from quillon.operators import adjudicate

LOG = "seq long, edge_id string, occurrence_id string, action string, source_subject_id string, target_subject_id string"


def slow(steps):
    out = {}
    for a in steps:
        seen = [a]
        while seen[-1] in steps and steps[seen[-1]] not in seen:
            seen.append(steps[seen[-1]])
        if seen[-1] in steps:  # into a circle
            out[a] = min(seen[seen.index(steps[seen[-1]]) :])
        else:
            out[a] = seen[-1]
    return {a: b for a, b in out.items() if a != b}


def test_random_maps(spark):
    rng = random.Random(6)
    steps = {f"s{a:03}": f"s{rng.randrange(300):03}" for a in rng.sample(range(300), 220)}
    steps = {a: b for a, b in steps.items() if a != b} | {f"chain{i:03}": f"chain{i + 1:03}" for i in range(150)}
    log = [(i, f"e{i}", None, "merge_to_canonical", a, b) for i, (a, b) in enumerate(steps.items())]
    got = {r.source: r.target for r in adjudicate.id_map(spark.createDataFrame(log, LOG)).collect()}
    assert got == slow(steps)


def test_order_of_decisions(spark):
    merge, rows = "merge_to_canonical", []
    rows += [(1, "e1", None, merge, "a", "b"), (2, "e2", None, merge, "b", "c"), (3, "e1", None, "keep_separate", None, None), (4, "e3", None, merge, "a", "d"), (5, "e4", None, merge, "a", "c"), (6, "e5", None, merge, "x", "x")]
    rows += [(7, None, "o1", "reject", None, None), (8, None, "o1", "confirm", None, None), (9, None, "o2", "reject", None, None), (10, None, "o3", "reject", None, None)]
    log = spark.createDataFrame(rows, LOG)
    ids = adjudicate.id_map(log)
    assert {r.source: r.target for r in ids.collect()} == {"a": "c", "b": "c"}
    edges = spark.createDataFrame([("e1", "open"), ("e2", "open"), ("e9", "open")], "edge_id string, status string")
    assert {r.edge_id: r.status for r in adjudicate.resolved_edges(edges, log).collect()} == {"e1": "adjudicated_keep_separate", "e2": "adjudicated_merge", "e9": "open"}
    own = spark.createDataFrame([("o1", "z", "t", "s"), ("o2", "b", "t", "s"), ("o3", "z", "u", "s"), ("o4", None, None, "s")], "occurrence_id string, subject_id string, text string, status string")
    done = adjudicate.resolved_occurrences(own, log, ids)
    assert {(r.occurrence_id, r.subject_id, r.original_subject_id, r.status) for r in done.collect()} == {("o1", "z", None, "confirmed_subject"), ("o2", "c", "b", "confirmed_subject"), ("o3", "z", None, "rejected_subject"), ("o4", None, None, "s")}
    assert {(r.subject_id, r.occurrences, r.surfaces, r.merged) for r in adjudicate.resolved_subjects(done, ids).collect()} == {("z", 2, 2, 0), ("c", 1, 1, 2), (None, 1, 0, 0)}
    assert adjudicate.id_map(log.where("false")).count() == 0


def test_rounds_follow_the_longest_way(spark, monkeypatch):
    # circles of 1 to 4 ids with ways of up to 3 into them, the smallest id anywhere, and short chains: 16 ids at most on a way
    rng, steps = random.Random(14), {}
    for g in range(120):
        ids = rng.sample([f"g{g:03}n{i}" for i in range(9)], 9)
        if g % 3:
            circle = ids[: 2 + g % 3]
            steps |= dict(zip(circle, circle[1:] + circle[:1], strict=True)) | {ids[5]: ids[6], ids[6]: ids[7], ids[7]: rng.choice(circle)}
        else:
            steps |= dict(zip(ids, ids[1:], strict=False))
    log = [(i, f"e{i}", None, "merge_to_canonical", a, b) for i, (a, b) in enumerate(steps.items())]
    written = []
    cut = adjudicate.checkpointed
    monkeypatch.setattr(adjudicate, "checkpointed", lambda df: written.append(df) or cut(df))
    got = {r.source: r.target for r in adjudicate.id_map(spark.createDataFrame(log, LOG)).collect()}
    assert got == slow(steps)
    # four rounds reach 16 ids, one or two more tell that nothing but circles is left; that many sources would take ten
    assert len(steps) > 512 and len(written) <= 8
