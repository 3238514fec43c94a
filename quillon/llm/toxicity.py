"""Toxicity: every significant toxic passage of a text, found in one scan, and a calibrated score of the whole text.

A word's weight is the log-odds of toxic among the labelled documents that hold it, under a Dirichlet prior at the shares
of the labels, less one posterior standard deviation; words whose log-odds aren't significant weigh nothing, and every
word costs DRIFT. The maximal scoring segments of that sequence (all of them, in linear time) are the passages. What a
passage's score means follows from extreme values: among clean texts of n words, passages of score s and more are expected
K * n * exp(-LAMBDA * s) times, where LAMBDA is the positive root of the weights' moment generating function over clean
words and K the maximum-likelihood estimate over clean documents. A passage is significant if it is expected less than
ALPHA times; a document's evidence is the sum of what its significant passages have beyond that, and monotone regression
over the labelled documents turns it into a probability.

Counts are summed over all labelled documents outside the held-out fold, a document counting a word once; no row or word is
sampled. What goes to the executors is bounded: a word of the model is at least LEAST_SHARE of the (word, document) pairs
of a class, so there are at most 2 / LEAST_SHARE of them.

Defined cases: a null text is empty, and an empty text has a score as any other; a null label is none; with no label at all
every score is 0.5; a null doc_id is no held-out row and has no label; rows or labels that repeat an id count each; ties
don't arise, as nothing is ranked; extra columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import giving_back, meet, released, stored
from .decontamination import search_words

FOLDS, HELD_OUT = 3, 1
#: Weight of the prior in documents, cost of every word, and how many standard deviations off zero log-odds must be.
PRIOR, DRIFT, SURE = 1.0, 1.0, 2.0
LEAST_DOCS, LEAST_SHARE = 3, 2.0**-18
#: A passage that clean texts of the same length would have this often is not significant.
ALPHA = 0.05
#: Width of the bins of log(1 + evidence) over which scores are calibrated.
BIN = 0.05
#: Words whose counts a task holds before it passes them on.
HELD_WORDS = 200_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SEGMENTS = "array<struct<first:int,end:int,score:double>>"


def maximal_segments(at: Sequence[int], weights: Sequence[float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score), in order, of a sequence whose members score weights at the places
    at (ascending) and 0 elsewhere, less drift each. Linear: each segment remembers the last one that begins lower, so
    those between are passed once."""
    lows: list[float] = []
    highs: list[float] = []
    firsts: list[int] = []
    ends: list[int] = []
    lower: list[int] = []
    gained = 0.0
    for i, weight in zip(at, weights):
        low = gained - drift * i
        gained += weight
        if weight <= drift:
            continue
        high, first = low + weight - drift, i
        j = len(lows) - 1
        while True:
            while j >= 0 and lows[j] >= low:
                j = lower[j]
            if j < 0 or highs[j] >= high:
                break
            low, first, before = lows[j], firsts[j], lower[j]
            for parts in (lows, highs, firsts, ends, lower):
                del parts[j:]
            j = before
        lows.append(low)
        highs.append(high)
        firsts.append(first)
        ends.append(i + 1)
        lower.append(j)
    return [(a, b, high - low) for a, b, low, high in zip(firsts, ends, lows, highs)]


@dataclass
class Model:
    """Words and their weights, the two constants of the extreme values, and the probability of each bin of evidence."""

    weights: dict[bytes, float]
    rate: float
    scale: float = 1.0
    levels: tuple[float, ...] = (0.5,)

    def segments(self, found: list[bytes]) -> list[tuple[int, int, float]]:
        known = self.weights
        at = [i for i, w in enumerate(found) if w in known]
        return maximal_segments(at, [known[found[i]] for i in at]) if at else []

    def surprise(self, score: float, n_words: int) -> float:
        """-log of how often clean texts of n_words have such a passage."""
        return self.rate * score - math.log(self.scale * n_words)


def _labels(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("doc_id").cast("long").alias("__doc"), F.col("toxic").cast("int").alias("label")).where("label in (0, 1) and __doc is not null")


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def word_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """word, toxic and clean documents that hold it, and its occurrences in clean ones; the empty word stands for all."""
    open_ = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(~_held_out(F.col("doc_id")))
    rows = meet(open_, _labels(labels), F.col("doc_id") == F.col("__doc")).select("label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, list[int]] = {}

        def flush() -> pa.RecordBatch:
            columns = [pa.array(list(counts), pa.binary()), *(pa.array([c[i] for c in counts.values()], pa.int64()) for i in range(3))]
            counts.clear()
            return pa.RecordBatch.from_arrays(columns, names=["word", "toxic", "clean", "occurrences"])

        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = search_words(text.as_py())
                for w in {b"", *found}:
                    counts.setdefault(w, [0, 0, 0])[1 - label] += 1
                if label == 0:
                    counts[b""][2] += len(found)
                    for w in found:
                        counts[w][2] += 1
                if len(counts) > HELD_WORDS:
                    yield flush()
        yield flush()

    parts = rows.mapInArrow(giving_back(count), "word binary, toxic bigint, clean bigint, occurrences bigint")
    return parts.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "occurrences")])


def moment_root(weights: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of the moment generating function of scores weights - DRIFT, and -DRIFT for the rest of the shares.
    Where nothing clean ever scores above 0 there is none, and a score counts as it is."""
    scores, rest = weights - DRIFT, 1.0 - shares.sum()
    if not (shares[scores > 0] > 0).any():
        return 1.0
    grown = lambda x: float((shares * np.exp(np.minimum(x * scores, 700.0))).sum() + rest * np.exp(-x * DRIFT))
    low, high = 0.0, 1.0
    while grown(high) < 1.0:
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if grown(middle) < 1.0 else (low, middle)
    return max(low, 1e-3)


def weigh(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn the words' weights. Only words of the model, whose number is bounded, come to the driver."""
    counts = stored(word_counts(docs, labels), "word-counts")
    of_all = counts.where(F.length("word") == 0).agg(F.sum("toxic"), F.sum("clean"), F.sum("occurrences")).first()
    toxic, clean, occurrences = (int(x or 0) for x in of_all)
    if not toxic or not clean:
        released(counts)
        return Model({}, 1.0)
    words = counts.where(F.length("word") > 0)
    pairs = words.agg(F.sum("toxic"), F.sum("clean")).first()
    share = toxic / (toxic + clean)
    one, zero = F.col("toxic") + PRIOR * share, F.col("clean") + PRIOR * (1 - share)
    odds, deviation = F.log(one / zero) - math.log(share / (1 - share)), F.sqrt(1 / one + 1 / zero)
    often = (F.col("toxic") >= LEAST_SHARE * (pairs[0] or 0)) | (F.col("clean") >= LEAST_SHARE * (pairs[1] or 0))
    kept = words.where(often & (F.col("toxic") + F.col("clean") >= LEAST_DOCS) & (F.abs(odds) > SURE * deviation))
    rows = kept.select("word", (F.signum(odds) * (F.abs(odds) - deviation)).alias("weight"), "occurrences").collect()
    released(counts)
    weights = np.array([r.weight for r in rows], dtype=float)
    shares = np.array([r.occurrences for r in rows], dtype=float) / max(occurrences, 1)
    return Model({bytes(r.word): r.weight for r in rows}, moment_root(weights, shares))


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_words and its maximal scoring segments, as places of words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long"), _held_out(F.col("doc_id").cast("long")).alias("held_out"), F.col("text").cast("string"))
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, segments = [], []
            for text in batch.column(2):
                found = search_words(text.as_py())
                sizes.append(len(found))
                segments.append([{"first": a, "end": b, "score": s} for a, b, s in shared.value.segments(found)])
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(segments, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_words", "segments"])

    return rows.mapInArrow(giving_back(run), f"doc_id bigint, held_out boolean, n_words bigint, segments {SEGMENTS}")


def evidence(model: Model) -> Column:
    """What the significant passages of a scanned row have beyond significance, summed."""
    beyond = lambda s: F.greatest(model.rate * s["score"] - F.log(model.scale * F.col("n_words")) + math.log(ALPHA), F.lit(0.0))
    return F.aggregate("segments", F.lit(0.0), lambda total, s: total + beyond(s))


def _bin(model: Model) -> Column:
    return F.floor(F.log1p(evidence(model)) / BIN).cast("int")


def monotone(toxic: np.ndarray, total: np.ndarray) -> list[float]:
    """The share of toxic in each bin, never falling (neighbours that fall are pooled), and smoothed by the share of all.
    Bins that nothing is in lie between their neighbours."""
    share = (toxic.sum() + 1.0) / (total.sum() + 2.0)
    blocks: list[list[float]] = []
    used = np.flatnonzero(total)
    for i in used:
        blocks.append([toxic[i], total[i], 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last)]
    # smoothing moves small blocks most, so what falls again is lifted to what stands before
    levels = np.repeat([(a + share) / (n + 1.0) for a, n, _ in blocks], [int(k) for *_, k in blocks])
    return np.interp(np.arange(len(total)), used, np.maximum.accumulate(levels)).tolist() if len(used) else [share]


def calibrate(scanned: DataFrame, labels: DataFrame, model: Model) -> Model:
    """The model with its constant K and its probabilities; a few sums and a histogram come to the driver."""
    known = stored(meet(scanned.where(~F.col("held_out")), _labels(labels), F.col("doc_id") == F.col("__doc")).select("label", "n_words", "segments"), "scanned")
    top = F.coalesce(F.array_max(F.transform("segments", lambda s: s["score"])), F.lit(0.0))
    sums = known.where("label = 0 and n_words > 0").agg(F.sum((top > 0).cast("long")), F.sum(F.col("n_words") * F.exp(-model.rate * top))).first()
    model = Model(model.weights, model.rate, ((sums[0] or 0) + 1.0) / ((sums[1] or 0.0) + 1.0))
    rows = known.groupBy(_bin(model).alias("bin")).agg(F.sum("label").alias("toxic"), F.count("*").alias("total")).collect()
    toxic, total = (np.zeros(1 + max((r.bin for r in rows), default=0)) for _ in range(2))
    for r in rows:
        toxic[r.bin], total[r.bin] = r.toxic, r.total
    released(known)
    return Model(model.weights, model.rate, model.scale, tuple(monotone(toxic, total)))


def classify(docs: DataFrame, labels: DataFrame, at_least: float = 0.7) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted and n_passages (significant ones)."""
    model = weigh(docs, labels)
    scanned = stored(scan(docs, model), "segments")
    model = calibrate(scanned, labels, model)
    levels = F.array(*[F.lit(x) for x in model.levels])
    score = F.element_at(levels, F.least(_bin(model) + 1, F.lit(len(model.levels))))
    significant = F.filter("segments", lambda s: model.rate * s["score"] - F.log(model.scale * F.col("n_words")) > -math.log(ALPHA))
    scored = scanned.select("doc_id", "held_out", score.alias("score"), F.size(significant).alias("n_passages"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= at_least).cast("int").alias("predicted"), "n_passages")


def passages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every significant passage: doc_id, start and end in code points, its text, score, and how often clean texts of that
    length would have it (expected)."""
    model = weigh(docs, labels)
    scanned = stored(scan(docs, model), "segments")
    shared = docs.sparkSession.sparkContext.broadcast(calibrate(scanned, labels, model))
    released(scanned)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()), ("score", pa.float64()), ("expected", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            out = []
            for doc, scalar in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = scalar.as_py() or ""
                found = search_words(text)
                for a, b, s in own.segments(found):
                    surprise = own.surprise(s, len(found))
                    if surprise > -math.log(ALPHA):
                        out.append((doc, a, b, s, math.exp(-surprise), text))
            rows = []
            places: tuple[object, list[tuple[int, int]]] = (None, [])
            for doc, a, b, s, expected, text in out:
                if places[0] is not text:
                    # lower-casing A-Z changes no place: the pattern leaves them out, so they are replaced alone
                    places = (text, [m.span() for m in WORD.finditer(text.translate(LOWER))])
                start, end = places[1][a][0], places[1][b - 1][1]
                rows.append((doc, start, end, text[start:end], s, expected))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in range(6)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(giving_back(run), "doc_id bigint, start bigint, end bigint, text string, score double, expected double")


