"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A benchmark item gives windows of WINDOW consecutive words; an item of fewer words, but not none, is one window. Block
shift tables over pairs of words skip positions where no window can end, suffix buckets select the windows that may end
there, and direct comparison confirms.

Defined cases: a null or empty text has no words; an item with a null id is no item; several rows with the same item_id
are one item with the windows of all; repeated documents give one row each; with no items nothing is hit; extra columns
are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, giving_back, stored

WINDOW = 10
#: Items are searched for in blocks of about this many bytes of text, one after another: what the driver holds and
#: broadcasts is bounded by it. Longer items are cut into pieces of so many windows.
BLOCK_BYTES, PIECE_WINDOWS = 2 << 20, 1 << 14
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
HITS = "doc_id bigint, key bigint, n_words bigint, spans array<struct<first:int,end:int>>, items array<string>"


def search_words(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z: letters a-z, digits, all that is not ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def windows(text: str | None, size: int = WINDOW) -> Iterator[tuple[bytes, ...]]:
    found = search_words(text)
    if found:
        for i in range(max(1, len(found) - size + 1)):
            yield tuple(found[i : i + size])


class WuManber:
    """Windows of one length each: a shift table by the last pair of words, and buckets of windows by that pair."""

    def __init__(self, items: Iterable[tuple[str, str | None]], size: int = WINDOW) -> None:
        self.groups: dict[int, tuple[dict[bytes, int], dict[bytes, dict[bytes, set[str]]]]] = {}
        for item, text in items:
            for window in windows(text, size):
                n = len(window)
                shift, bucket = self.groups.setdefault(n, ({}, {}))
                block = min(2, n)
                for j in range(block, n + 1):
                    key = b" ".join(window[j - block : j])
                    shift[key] = min(shift.get(key, n), n - j)
                bucket.setdefault(b" ".join(window[-block:]), {}).setdefault(b" ".join(window), set()).add(item)

    def search(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The spans of words inside any occurrence of a window, disjoint and in order, and the items that occur."""
        ends: list[tuple[int, int]] = []
        items: set[str] = set()
        total = len(found)
        for n, (shift, bucket) in self.groups.items():
            skip, far = shift.get, n - min(2, n) + 1
            at = n - 1
            while at < total:
                key = found[at - 1] + b" " + found[at] if n > 1 else found[at]
                step = skip(key, far)
                if step:
                    at += step
                    continue
                hit = bucket[key].get(b" ".join(found[at - n + 1 : at + 1]))
                if hit:
                    ends.append((at - n + 1, at + 1))
                    items |= hit
                at += 1
        spans: list[tuple[int, int]] = []
        for first, end in sorted(ends):
            if spans and first <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
            else:
                spans.append((first, end))
        return spans, items


def _scan(docs: DataFrame, shared: Broadcast, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = WuManber(shared.value, size)
        for batch in batches:
            rows = []
            for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = search_words(text.as_py())
                spans, ids = search.search(found)
                rows.append({"doc_id": doc, "key": key, "n_words": len(found), "spans": [{"first": a, "end": b} for a, b in spans], "items": sorted(ids)})
            span = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
            schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()), ("spans", span), ("items", pa.list_(pa.string()))])
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return docs.mapInArrow(giving_back(run), HITS)


def _merged(spans: Column) -> Column:
    """Spans, overlapping or touching ones united."""

    def merged(own: Iterable[dict]) -> list[dict]:
        out: list[dict] = []
        for first, end in sorted((s["first"], s["end"]) for s in own):
            if out and first <= out[-1]["end"]:
                out[-1]["end"] = max(end, out[-1]["end"])
            else:
                out.append({"first": first, "end": end})
        return out

    @F.pandas_udf("array<struct<first:int,end:int>>")
    def each(lists: pd.Series) -> pd.Series:
        return lists.map(merged)

    return each(spans)


def _items(benchmark: DataFrame, block_bytes: int, size: int) -> tuple[DataFrame, int]:
    """Pieces of items (item, piece), which have all of its windows between them, and in how many blocks they are."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, str]] = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = search_words(text.as_py())
                for at in range(0, len(found) and max(1, len(found) - size + 1), PIECE_WINDOWS):
                    out.append((item, b" ".join(found[at : at + PIECE_WINDOWS + size - 1]).decode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], names=["item", "piece"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string")).where("item is not null and text is not null")
    pieces = items.mapInArrow(cut, "item string, piece string")
    total = pieces.agg(F.coalesce(F.sum(F.octet_length("piece")), F.lit(0))).first()[0]
    return pieces, max(1, -(-int(total) // block_bytes))


def _shared(pieces: DataFrame) -> Broadcast:
    return pieces.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in pieces.collect()])


def find(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs: doc_id, n_words, the spans of words hit and the items (as strings) that occur.

    The benchmark is searched for in blocks of about block_bytes, one after another, so that neither the driver nor an
    executor holds more of it at a time. Where there are several, the hits of each, which few documents have, are stored,
    and united with what the first block says of every document.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("key"), F.col("text").cast("string"))
    pieces, blocks = _items(benchmark, block_bytes, size)
    if blocks == 1:
        return _scan(docs, _shared(pieces), size).drop("key")
    scans = []
    for block in range(blocks):
        shared = _shared(pieces.where(F.pmod(F.xxhash64("item", "piece"), F.lit(blocks)) == block))
        found = _scan(docs, shared, size)
        scans.append(stored(found if block == 0 else found.where(F.size("spans") > 0), "benchmark-hits"))
        shared.destroy()
    first, *rest = scans
    more = reduce(DataFrame.unionByName, rest)
    more = more.groupBy(F.col("key").alias("__key")).agg(F.flatten(F.collect_set("spans")).alias("__spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("__items"))
    none = F.array().cast("array<string>")
    return first.join(more, first["key"] == more["__key"], "left").select(
        "doc_id", "n_words", _merged(F.concat("spans", F.coalesce("__spans", F.array().cast("array<struct<first:int,end:int>>")))).alias("spans"),
        F.array_sort(F.array_union("items", F.coalesce("__items", none))).alias("items"),
    )


def summary(hits: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 (of the ids, sorted as strings, comma-joined) and contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of the benchmark occurs. A benchmark of one block is
    searched for where the rows are, so nothing is shuffled."""
    pieces, blocks = _items(benchmark, block_bytes, WINDOW)
    if blocks > 1:
        hit = find(docs, benchmark, block_bytes=block_bytes).where(F.size("spans") > 0).select(F.col("doc_id").alias("__hit"))
        return docs.join(hit, docs["doc_id"].cast("long").eqNullSafe(hit["__hit"]), "left_anti")
    shared = _shared(pieces)

    @F.pandas_udf("boolean")
    def untouched(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        search = WuManber(shared.value)
        for texts in parts:
            yield pd.Series([not search.search(search_words(t))[0] for t in texts], dtype=bool)
        del search
        give_back()

    return docs.where(untouched(docs["text"].cast("string")))


def brute_force(text: str | None, items: list[tuple[str, str]], size: int = WINDOW) -> tuple[int, int, list[str], str]:
    """n_words, n_hit, items and their digest, by comparing every window with every position."""
    found = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    hit, ids = set(), set()
    for item, own in items:
        theirs = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), own or "")) if w]
        n = min(size, len(theirs))
        for j in range(len(theirs) - n + 1) if n else ():
            for i in range(len(found) - n + 1):
                if found[i : i + n] == theirs[j : j + n]:
                    hit.update(range(i, i + n))
                    ids.add(str(item))
    return len(found), len(hit), sorted(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
