"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics of the whole text (lengths, shares of character kinds, repetition) are transformed to stabilise their variance:
logarithms of counts, arcsines of roots of shares. Each class has a mean and a covariance, shrunk towards its diagonal; a
score is the logistic of the Mahalanobis log-density difference, from Cholesky factors that are computed once.

Counts and moments are summed over all labelled rows that may be learned from, without a cap. Defined cases: a null text is
empty, and an empty text has a score as any other; a null label is none; with no label of a class the score is the
smoothed share of label 1; rows that repeat an id count each; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, giving_back, meet, stored

FOLDS, HELD_OUT = 3, 1
#: Share of a class covariance that its diagonal replaces, and the least variance, in units of the transformed statistics.
SHRINKAGE, LEAST = 0.1, 1e-3
#: The log-density difference counts as this many times less in a score, which so stays off 0 and 1; its sign decides alone.
TEMPER = 8.0
#: Kinds of bytes: other symbols, lower case, upper case, digits, white space, sentence marks, exclamation, bytes beyond ASCII.
KINDS = np.zeros(256, dtype=np.uint8)
KINDS[97:123], KINDS[65:91], KINDS[48:58] = 1, 2, 3
KINDS[[9, 10, 11, 12, 13, 32]] = 4
KINDS[[ord(c) for c in ".,;:'\"()-?"]] = 5
KINDS[ord("!")] = 6
KINDS[128:] = 7


def statistics(text: str | None) -> np.ndarray:
    data = (text or "").encode("utf-8", "surrogatepass")
    kinds = np.bincount(KINDS[np.frombuffer(data, dtype=np.uint8)], minlength=8).astype(float)
    words = data.lower().split()
    n, n_chars = len(words), len(data)
    distinct = len(set(words))
    again = sum(map(eq, words, words[1:]))
    lines = data.count(b"\n") + 1
    # a few made-up characters and words of usual kind keep the shares of short texts apart from 0 and 1
    share = lambda x, of, usual, weight: np.arcsin(np.sqrt((x + usual * weight) / (of + weight)))
    letters = kinds[1] + kinds[2] + kinds[7]
    return np.array([
        np.log(n + 20.0), np.log((n_chars - kinds[4] + 100.0) / (n + 20.0)), np.log((n + 40.0) / (lines + 1.0)),
        share(kinds[0], n_chars, 0.0002, 100), share(kinds[2], letters, 0.018, 100), share(kinds[3], n_chars, 0.0002, 100),
        share(kinds[5], n_chars, 0.023, 100), share(kinds[6], n_chars, 0.0002, 100), share(kinds[7], n_chars, 0.02, 100),
        share(again, n, 0.006, 20), share(distinct, n, 0.77, 20), share(kinds[4], n_chars, 0.16, 100),
    ])


N = len(statistics(""))


@dataclass
class Model:
    """Of each class (0, 1): log prior, mean, inverse Cholesky factor and log determinant; or a constant score."""

    parts: list[tuple[float, np.ndarray, np.ndarray, float]] | None
    constant: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.full(len(x), self.constant)
        zero, one = (prior - 0.5 * (((x - mean) @ factor.T) ** 2).sum(axis=1) - 0.5 * log_det for prior, mean, factor, log_det in self.parts)
        return 1.0 / (1.0 + np.exp(-np.clip((one - zero) / TEMPER, -500, 500)))


def featured(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and the statistics of each row of docs."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), F.col("text").cast("string"))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], schema=schema)

    return rows.mapInArrow(giving_back(run), "doc_id bigint, held_out boolean, x array<double>")


def train(features: DataFrame, labels: DataFrame) -> Model:
    """Learn from the labels of rows that aren't held out. Moments meet on the driver: one number each, whatever the input.

    Statistics go to their labels through a shuffle, even to few labels: in one stage with the sums they would take a second
    Python worker for each core, and workers stay in memory beside all that follows.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("__doc"), F.col("quality").cast("int").alias("label")).where("label in (0, 1)")
    known = meet(features.where(~F.col("held_out")), own, F.col("doc_id") == F.col("__doc")).select("label", "x")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + N + N * N))
        for batch in batches:
            label = batch.column(0).to_numpy()
            x = np.array(batch.column(1).to_pylist()).reshape(-1, N)
            for c in (0, 1):
                of = x[label == c]
                total[c] += np.concatenate([[len(of)], of.sum(axis=0), (of.T @ of).ravel()])
        at = np.arange(total.shape[1], dtype=np.int32)
        for c in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c, dtype=np.int32)), pa.array(at), pa.array(total[c])], names=["label", "at", "value"])

    moments = np.zeros((2, 1 + N + N * N))
    for label, at, value in known.mapInArrow(sums, "label int, at int, value double").groupBy("label", "at").agg(F.sum("value")).collect():
        moments[label, at] = value
    n = moments[:, 0]
    if n.min() < 2:
        return Model(None, (n[1] + 1.0) / (n.sum() + 2.0))
    parts = []
    for c in (0, 1):
        mean = moments[c, 1 : 1 + N] / n[c]
        cov = (moments[c, 1 + N :].reshape(N, N) - n[c] * np.outer(mean, mean)) / (n[c] - 1)
        cov = (1 - SHRINKAGE) * cov + SHRINKAGE * np.diag(np.diag(cov)) + LEAST * np.eye(N)
        factor = np.linalg.cholesky(cov)
        parts.append((float(np.log(n[c] / n.sum())), mean, np.linalg.inv(factor), 2.0 * float(np.log(np.diag(factor)).sum())))
    return Model(parts)


def score_of(model: Model, x: Column) -> Column:
    @F.pandas_udf("double")
    def score(values: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(values.to_numpy()).reshape(-1, N)) if len(values) else [], dtype=float)

    return score(x)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, score and predicted."""
    features = stored(featured(docs), "quality")
    scored = features.select("doc_id", "held_out", score_of(train(features, labels), F.col("x")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that the classifier doesn't reject. It learns from the same rows as classify."""
    # statistics of all rows are read again for the learning alone: they are small, so no text is shuffled to its label
    model = train(featured(docs), labels)

    @F.pandas_udf("boolean")
    def good(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            x = np.array([statistics(t) for t in texts]).reshape(-1, N)
            yield pd.Series(model.score(x) >= 0.5, dtype=bool)
        give_back()

    return docs.where(good(docs["text"].cast("string")))
