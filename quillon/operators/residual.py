"""Residual mentions: known surfaces of a document that stand in its text where no span lies.

All surfaces of a document are looked for in one pass of an automaton (a trie with failure links), so tens of thousands of
them cost no more than reading the text. A document is one unit of work; its surfaces and spans come to it once.
"""

from __future__ import annotations

import functools
from bisect import bisect_left
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCORE = 0.82
LEAST = 2
FOUND = "doc_id bigint, entity_type string, key string, surface string, start int, end int, round int"
ARROW = pa.schema([("doc_id", pa.int64()), ("entity_type", pa.string()), ("key", pa.string()), ("surface", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("round", pa.int32())])


def places(text: str, surfaces: list[str]) -> dict[str, list[int]]:
    """Where each surface stands, from the left, not overlapping itself."""
    trie = ahocorasick.Automaton()
    for s in surfaces:
        trie.add_word(s, s)
    found: dict[str, list[int]] = {}
    if len(trie):
        trie.make_automaton()
        for last, s in trie.iter(text):
            own = found.setdefault(s, [])
            if not own or own[-1] + len(s) <= last + 1 - len(s):
                own.append(last + 1 - len(s))
    return found


class Taken:
    """Disjoint ranges of a text; what overlaps one is not free."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(end, self.ends[-1])
            elif end > start:
                self.starts.append(start)
                self.ends.append(end)

    def free(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        return i == 0 or self.ends[i - 1] <= start

    def take(self, start: int, end: int) -> None:
        i = bisect_left(self.starts, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)


def rounds(text: str, surfaces: list[tuple[str, str, str]], spans: list[tuple[int, int]], most_rounds: int | None) -> Iterator[tuple[str, str, str, int, int, int]]:
    """In each round every surface (type, key, surface), in order, takes its first free place; until none finds one. What
    isn't free stays so, and no place is looked at twice."""
    taken = Taken(spans)
    found = places(text, list({s for *_, s in surfaces}))
    waiting = [(*own, iter(found.get(own[2], ()))) for own in surfaces]
    n = 0
    while waiting and (most_rounds is None or n < most_rounds):
        n += 1
        left = []
        for kind, key, s, rest in waiting:
            for at in rest:
                if taken.free(at, at + len(s)):
                    taken.take(at, at + len(s))
                    yield kind, key, s, at, at + len(s), n
                    left.append((kind, key, s, rest))
                    break
        waiting = left


def first_free(text: str, surfaces: list[tuple[str, str, str]], spans: list[tuple[int, int]]) -> Iterator[tuple[str, str, str, int, int, int]]:
    """Of each surface the first place that no span overlaps, whatever other surfaces do."""
    taken = Taken(spans)
    found = places(text, list({s for *_, s in surfaces}))
    for kind, key, s in surfaces:
        at = next((p for p in found.get(s, ()) if taken.free(p, p + len(s))), None)
        if at is not None:
            yield kind, key, s, at, at + len(s), 1


def _each_document(docs: DataFrame, memory: DataFrame, spans: DataFrame, find: Callable[..., Iterator[tuple]]) -> DataFrame:
    rows = memory.where(F.length(F.regexp_replace("surface", r"\s+", "")) >= LEAST).select("doc_id", "entity_type", "key", "surface").distinct()
    order = F.struct("entity_type", "key", (-F.length("surface")).alias("n"), "surface")
    known = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(order)).alias("known"))
    busy = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("busy"))
    own = docs.select(F.col("doc_id").cast("long"), "text").join(known, "doc_id").join(busy, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, surfaces, ranges in zip(*[batch.column(i) for i in range(4)]):
                each = [(s["entity_type"], s["key"], s["surface"]) for s in surfaces.as_py()]
                got = find(text.as_py() or "", each, [(r["start"], r["end"]) for r in ranges.as_py() or ()])
                columns = list(zip(*[(doc.as_py(), *g) for g in got])) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW)], schema=ARROW)

    return own.select("doc_id", "text", "known", "busy").mapInArrow(run, FOUND)


def materialized(docs: DataFrame, memory: DataFrame, spans: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """Mentions of memory (doc_id, entity_type, key, surface) in docs that overlap no span and none added before: at most one
    of each surface in a round, in order of type, key, longer surface first. Round by round until nothing is added, or
    ``most_rounds``. Surfaces of one character, and null ones, are none."""
    return _each_document(docs, memory, spans, functools.partial(rounds, most_rounds=most_rounds))


def hits(docs: DataFrame, memory: DataFrame, spans: DataFrame) -> DataFrame:
    """The first free place of each surface: what a quality gate asks about."""
    return _each_document(docs, memory, spans, first_free).drop("round")
