"""Document fingerprints from closed syncmers.

A K-mer of code points is chosen if its smallest inner S-mer, by hash, is its first or last: a choice that depends on
nothing around it, so equal passages have equal anchors wherever they stand. A fingerprint holds every anchor with its
place in the text, in six characters and by place: its hash, and how far it stands behind the anchor before it (the same
K-mer again is an anchor again). Matching is positional: anchors of two fingerprints match by hash, the first of a hash with
the first, their places say by how far they moved, and a match counts if others moved as far (at least RUN together, or as
many as the smaller fingerprint has). One K serves every length: signs before the text make K-mers of its beginning, and its
first HEAD code points are an anchor, too.

Defined cases: a null or empty text has an empty fingerprint; a text of at most HEAD code points is one anchor; two empty
fingerprints have likeness 1, an empty and another one 0; documents are in ascending doc_id order, null ids first, ties by
text; a table of one document has that as its own next; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, mix, partitions

S = 6
K = 2 * S
#: Before a text stand signs that no text holds, so that its first K-mer ends HEAD + 1 code points in: short texts have anchors, too.
HEAD = 3
BEFORE = np.arange(0x110000, 0x110000 + K - 1 - HEAD, dtype=np.uint64)
#: Bits of an anchor's hash; and those that say how far it stands behind the anchor before it. Of any S + 1 K-mers in a row
#: one is an anchor, wherever the least S-mer of theirs stands, so that no gap of a text is wider than S + 1. For any other
#: gap, an entry of the gap JUMP has a place instead of a hash: that of the anchor after it.
HASH_BITS, GAP_BITS = 32, 4
JUMP = (1 << GAP_BITS) - 1
#: Characters of an anchor: 6 bits each.
ANCHOR = (HASH_BITS + GAP_BITS) // 6
DIGITS = np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_", dtype=np.uint8)
VALUES = np.zeros(256, dtype=np.uint64)
VALUES[DIGITS] = np.arange(64, dtype=np.uint64)
SHIFTS = np.arange(6 * (ANCHOR - 1), -1, -6, dtype=np.uint64)
#: So many matches that moved equally far make a run.
RUN = 2
#: Characters of fingerprints that go back to the JVM at once.
BATCH_CHARS = 8 << 20


def syncmers(text: str, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the closed syncmers, of 2 * s code points, of a text of at least as many."""
    return _syncmers(_points(text), s)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _syncmers(points: np.ndarray, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    n = len(points) - s + 1
    with np.errstate(over="ignore"):
        inner = points[:n].copy()
        for i in range(1, s):
            inner *= np.uint64(0x9E3779B97F4A7C15)
            inner += points[i : i + n]
        inner = mix(inner)
        width = s + 1
        least, size = inner, 1
        while 2 * size <= width:
            least, size = np.minimum(least[:-size], least[size:]), 2 * size
        least = np.minimum(least[: len(least) - width + size], least[width - size :])
        m = len(least)
        place = np.flatnonzero((inner[:m] == least) | (inner[width - 1 : width - 1 + m] == least))
        return mix(inner[place] * np.uint64(0xD1342543DE82EF95) + inner[place + s]), place


def _anchors(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places, in order, of the anchors of a text."""
    if not text:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    digest = hashlib.blake2b(text[:HEAD].encode("utf-8", "surrogatepass"), digest_size=8).digest()
    hashes, places = np.frombuffer(digest, dtype="<u8"), np.zeros(1, dtype=np.int64)
    if len(text) > HEAD:
        more, at = _syncmers(np.concatenate([BEFORE, _points(text)]))
        hashes, places = np.concatenate([hashes, more]), np.concatenate([places, np.maximum(at - len(BEFORE), 0)])
    return hashes >> np.uint64(64 - HASH_BITS), places.astype(np.uint64)


def _pack(hashes: np.ndarray, places: np.ndarray) -> str:
    gaps = np.diff(places.astype(np.int64), prepend=0)
    far = np.flatnonzero((gaps < 0) | (gaps >= JUMP))
    if len(far):
        gaps[far] = 0
        gaps, hashes = np.insert(gaps, far, JUMP), np.insert(hashes, far, places[far])
    packed = (gaps.astype(np.uint64) << np.uint64(HASH_BITS)) | hashes
    return DIGITS[(packed[:, None] >> SHIFTS) & np.uint64(63)].tobytes().decode("ascii")


def _unpack(print_: str) -> tuple[np.ndarray, np.ndarray]:
    digits = VALUES[np.frombuffer(print_.encode("ascii"), dtype=np.uint8)].reshape(-1, ANCHOR)
    packed = np.bitwise_or.reduce(digits << SHIFTS, axis=1)
    values, gaps = packed & np.uint64((1 << HASH_BITS) - 1), (packed >> np.uint64(HASH_BITS)).astype(np.int64)
    jumps = gaps == JUMP
    places = np.cumsum(np.where(jumps, 0, gaps))
    if jumps.any():
        last = np.maximum.accumulate(np.where(jumps, np.arange(len(gaps)), -1))
        places += np.where(last < 0, 0, values[last].astype(np.int64) - places[last])
    return values[~jumps], places[~jumps].astype(np.uint64)


def _numbered(hashes: np.ndarray) -> np.ndarray:
    """Hashes in order, each with its number among equal ones."""
    at = np.arange(len(hashes))
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = hashes[1:] != hashes[:-1]
    return (hashes << np.uint64(32)) | (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)


def fingerprint(text: str | None) -> str:
    return _pack(*_anchors(text))


def _moves(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """By how far each matching anchor moved from one to two (numbered hashes, places)."""
    _, i, j = np.intersect1d(one[0], two[0], assume_unique=True, return_indices=True)
    return two[1][j].astype(np.int64) - one[1][i].astype(np.int64)


def _alike(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> float:
    sizes = len(one[0]), len(two[0])
    if not min(sizes):
        return float(sizes[0] == sizes[1])
    _, together = np.unique(_moves(one, two), return_counts=True)
    return 2.0 * int(together[together >= min(RUN, *sizes)].sum()) / sum(sizes)


def _matchable(hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes, kind="stable")
    return _numbered(hashes[order]), places[order]


def likeness(a: str, b: str) -> float:
    """The share of anchors in common (Dice), over all anchors of both: those that moved in runs."""
    return _alike(_matchable(*_unpack(a)), _matchable(*_unpack(b)))


def shift(a: str, b: str) -> tuple[int, int] | None:
    """How far most matching anchors moved from a to b, and how many did; None if none matches."""
    moved = Counter(_moves(_matchable(*_unpack(a)), _matchable(*_unpack(b))).tolist())
    return max(moved.items(), key=lambda x: (x[1], -abs(x[0]), x[0]), default=None)


def edit(text: str, after: str) -> str:
    """text with its last quarter replaced by the first as many code points of after."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document, of its edited text, and their likeness to each other and to the next document's.

    Documents are dealt by ranges of doc_id and sorted; each range also gets the first document of the one after it
    (the last range that of the first), so that every document meets its next in one pass.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    edges = sorted(set(rows.select("doc_id").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n))) if n > 1 else []
    bounds = np.array(edges, dtype=np.int64)

    @F.pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        # a null id is the first of all
        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(bounds, ids.fillna(0).to_numpy(dtype=np.int64), side="right")), dtype=np.int32)

    dealt = rows.withColumn("part", part("doc_id"))
    # one id for each range; a null id is the first of all
    firsts = sorted((tuple(r) for r in dealt.groupBy("part").agg(F.when(F.max(F.col("doc_id").isNull()), None).otherwise(F.min("doc_id"))).collect()))
    to = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    heads = spark.createDataFrame(to, "__first bigint, __part int")
    lent = rows.join(F.broadcast(heads), rows["doc_id"].eqNullSafe(heads["__first"])).groupBy("__part", "__first").agg(F.min("text").alias("text"))
    own = dealt.select("part", F.lit(False).alias("lent"), "doc_id", "text")
    union = own.unionByName(lent.select(F.col("__part").alias("part"), F.lit(True).alias("lent"), F.col("__first").alias("doc_id"), "text"))
    # a range is a partition: by a hash of its number, several would meet in one and others stay empty
    placed = union.repartitionById(n, "part").sortWithinPartitions("part", "lent", "doc_id", "text")

    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def arrow(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(types), types, strict=True)], names=[c.split()[0] for c in OUT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            out: list[tuple] = []
            chars = 0
            for range_, is_lent, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                text = text.as_py()
                hashes, places = _anchors(text)
                own = _matchable(hashes, places)
                if held and held[0] == range_:
                    _, before, old, old_print, old_own = held
                    edited = edit(old, text)
                    new_hashes, new_places = _anchors(edited)
                    new = _pack(new_hashes, new_places)
                    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((before, len(old), digest, old_print, new, _alike(old_own, _matchable(new_hashes, new_places)), _alike(old_own, own)))
                    chars += len(old_print) + len(new)
                    if chars >= BATCH_CHARS:
                        yield arrow(out)
                        out, chars = [], 0
                held = None if is_lent else (range_, doc, text, _pack(hashes, places), own)
            yield arrow(out)

    return placed.mapInArrow(giving_back(run), OUT)
