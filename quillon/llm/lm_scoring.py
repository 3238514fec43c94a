"""Stupid-backoff language model scores, computed relationally.

Documents are dealt into batches by hash, of about BATCH_BYTES of text at most. A batch sends the counts of its n-grams, of every order up to ``order``, to
fragments of the hash space; a fragment adds up each n-gram's counts over all batches and answers every batch with the
totals of what it asked for; the batch joins them to its documents' n-grams in order and sums per document. The counts
that score a document leave the document itself out.

A word (ASCII white space splits, A-Z are lower-cased) after a context scores ln of c(context, word) / c(context) with
the longest context, of fewer than ``order`` words, after which it occurs elsewhere, and ln BACKOFF for each word that the
context was shortened by. With no context it scores ln c(word) / N, N being the words of all other documents; a word that
occurs nowhere else counts as UNSEEN.

An n-gram's key has 48 bits of its hash besides those that name its fragment. In a fragment of a few million n-grams about one
in a hundred million shares its key with another.

Defined cases: a null or empty text, or one without words, has score and mean 0; if there are no other words, N is 1; rows
that repeat are documents of their own; an empty table has no rows; extra columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RangeHash, give_back, partitions, words

ORDER = 3
#: Text of a batch, which one process holds with its n-grams.
BATCH_BYTES = 16 << 20
KEY_BITS = 48
BACKOFF = 0.4
UNSEEN = 0.5

_hash: list[RangeHash] = []


def ngrams(text: str | None, k: int) -> np.ndarray:
    """The hashes of a text's n-grams of order k, in places."""
    found = words(text)
    if not _hash:
        _hash.append(RangeHash())
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    data = np.frombuffer(b" ".join(found), dtype=np.uint8)
    n = len(found)
    # a word has no space, so n-grams of different orders are different byte ranges
    return _hash[0](data, starts[: max(0, n - k + 1)], ends[min(n, k - 1) :])


def _asked(texts: pa.ChunkedArray, order: int) -> tuple[list[int], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Of a batch: the number of words of each document, and for each order all distinct n-grams in order, the place of each
    occurrence, and counts. Orders are gathered one after another, so that little more than the places is held at a time."""
    lengths, each = [], []
    for k in range(1, order + 1):
        flat = []
        for text in texts:
            found = ngrams(text.as_py(), k)
            flat.append(found)
            if k == 1:
                lengths.append(len(found))
        keys, inverse, counts = np.unique(np.concatenate(flat), return_inverse=True, return_counts=True)
        each.append((keys, inverse.astype(np.int32), counts))
    return lengths, each


def _score(place: list[np.ndarray], totals: list[np.ndarray], words_total: int) -> tuple[float, int, int]:
    """Log score of a document, words that backed off, and words that occur nowhere else. place: of its n-grams, by order."""
    n = len(place[0])
    elsewhere = []
    for at, total in zip(place, totals, strict=True):
        _, inverse, counts = np.unique(at, return_inverse=True, return_counts=True)
        elsewhere.append(total[at] - counts[inverse])
    log = np.zeros(n)
    left = np.ones(n, dtype=bool)
    backed = np.zeros(n, dtype=np.int64)
    for k in range(len(place), 1, -1):
        here = np.flatnonzero(left[k - 1 :]) + k - 1
        seen = elsewhere[k - 1][here - k + 1]
        hit = seen > 0
        done = here[hit]
        # the context ends one word before and has an order less
        log[done] = np.log(seen[hit] / elsewhere[k - 2][done - k + 1]) + backed[done] * np.log(BACKOFF)
        left[done] = False
        backed[here[~hit]] += 1
    rest = np.flatnonzero(left)
    alone = elsewhere[0][rest]
    log[rest] = np.log(np.where(alone > 0, alone, UNSEEN) / max(1, words_total - n)) + backed[rest] * np.log(BACKOFF)
    return float(log.sum()), int((backed > 0).sum()), int((elsewhere[0] == 0).sum())


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_backed_off, n_unseen, log_score (natural, summed) and mean_log_score."""
    parts = partitions(docs.sparkSession)
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    batches = max(parts, -(-int(total) // BATCH_BYTES))
    batch = F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).select(batch.alias("batch"), "doc_id", "text")

    # where each fragment's hashes begin
    starts = [-(-(f << 64) // parts) for f in range(parts)]

    def cuts(keys: np.ndarray) -> np.ndarray:
        return np.append(np.searchsorted(keys, np.array(starts, dtype=np.uint64)), len(keys))

    def ask(table: pa.Table) -> pa.Table:
        lengths, each = _asked(table.column("text"), order)
        out: list[list] = [[], [], []]
        for k, (keys, _, counts) in enumerate(each):
            ends = cuts(keys)
            for f in range(parts):
                part = slice(ends[f], ends[f + 1])
                with np.errstate(over="ignore"):
                    sent = _sent(_scaled(keys[part] - np.uint64(starts[f]), parts))
                for column, value in zip(out, (k, sent, _packed(counts[part])), strict=True):
                    column.append(value)
        n = parts * order
        give_back()
        return pa.table({
            "fragment": pa.array(list(range(parts)) * order, pa.int32()), "batch": pa.array([table.column("batch")[0].as_py()] * n, pa.int32()),
            "order": pa.array(out[0], pa.int32()), "n_words": pa.array([sum(lengths)] * n, pa.int64()), "keys": pa.array(out[1], pa.binary()), "counts": pa.array(out[2], pa.binary()),
        })

    def add_up(table: pa.Table) -> pa.Table:
        out = []
        for k in range(order):
            own = table.filter(pc.equal(table.column("order"), k))
            keys = [_received(x.as_buffer()) for x in own.column("keys")]
            counts = np.concatenate([_unpacked(x.as_buffer()) for x in own.column("counts")])
            _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            totals = np.bincount(inverse, weights=counts).astype(np.int64)[inverse]
            ends = np.cumsum([0, *map(len, keys)])
            # every batch has a row in every fragment, so all its words are known here
            everything = int(np.sum(own.column("n_words").to_numpy()))
            out.append(pa.table({
                "batch": own.column("batch"), "fragment": own.column("fragment"), "order": own.column("order"),
                "n_words": pa.array([everything] * len(keys), pa.int64()),
                "totals": pa.array([_packed(totals[ends[i] : ends[i + 1]]) for i in range(len(keys))], pa.binary()),
            }))
        give_back()
        return pa.concat_tables(out)

    def sum_up(texts: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by([("order", "ascending"), ("fragment", "ascending")])
        each = [_unpacked(x.as_buffer()) for x in answers.column("totals")]
        totals = [np.concatenate(each[k * parts : (k + 1) * parts]) for k in range(order)]
        everything = answers.column("n_words")[0].as_py()
        del each, answers
        lengths, asked = _asked(texts.column("text"), order)
        places = [inverse for _, inverse, _ in asked]
        out, at = [], [0] * order
        for n in lengths:
            place = []
            for k in range(order):
                m = max(0, n - k)
                place.append(places[k][at[k] : at[k] + m])
                at[k] += m
            out.append((n, *(_score(place, totals, everything) if n else (0.0, 0, 0))))
        n, log, backed, unseen = zip(*out, strict=True)
        mean = [x / k if k else 0.0 for x, k in zip(log, n, strict=True)]
        give_back()
        return pa.table({"doc_id": texts.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_backed_off": pa.array(backed, pa.int64()), "n_unseen": pa.array(unseen, pa.int64()), "log_score": pa.array(log), "mean_log_score": pa.array(mean)})

    asked = rows.groupBy("batch").applyInArrow(ask, "fragment int, batch int, order int, n_words bigint, keys binary, counts binary")
    answers = asked.groupBy("fragment").applyInArrow(add_up, "batch int, fragment int, order int, n_words bigint, totals binary")
    return rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(sum_up, "doc_id bigint, n_words bigint, n_backed_off bigint, n_unseen bigint, log_score double, mean_log_score double")


def _scaled(offsets: np.ndarray, parts: int) -> np.ndarray:
    """Offsets in a fragment of 2**64 / parts hashes, with as many low bits dropped as leave KEY_BITS."""
    return offsets >> np.uint64(max(0, ((1 << 64) // parts).bit_length() - KEY_BITS))


def _sent(keys: np.ndarray) -> bytes:
    """Sorted keys: their first bits as a bit vector, in which each key is a one and each value of those bits a zero, and
    the rest as whole bytes. There are 16 first bits where keys are many, else 8."""
    n, first = len(keys), 16 if len(keys) >= 1 << 13 else 8
    ones = np.zeros(n + (1 << first), dtype=bool)
    ones[(keys >> np.uint64(KEY_BITS - first)).astype(np.int64) + np.arange(n)] = True
    rest = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : (KEY_BITS - first) // 8]
    return bytes([first]) + n.to_bytes(7, "little") + np.packbits(ones).tobytes() + rest.tobytes()


def _received(data: pa.Buffer) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    first, n = int(raw[0]), int.from_bytes(raw[1:8].tobytes(), "little")
    width, size = (KEY_BITS - first) // 8, (n + (1 << first) + 7) // 8
    ones = np.flatnonzero(np.unpackbits(raw[8 : 8 + size], count=n + (1 << first)))
    whole = np.zeros((n, 8), dtype=np.uint8)
    whole[:, :width] = raw[8 + size :].reshape(-1, width)
    return whole.view("<u8").ravel() | ((ones - np.arange(n)).astype(np.uint64) << np.uint64(8 * width))


def _packed(totals: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs, after that number."""
    top = int(totals.max()) if len(totals) else 0
    small = np.minimum(totals, 255).astype(np.uint8)
    big = np.flatnonzero(totals >= 255)
    wide = 4 if top < 1 << 32 else 8
    return bytes([wide]) + len(totals).to_bytes(8, "little") + small.tobytes() + totals[big].astype(f"<u{wide}").tobytes()


def _unpacked(data: pa.Buffer) -> np.ndarray:
    raw = bytes(data)
    wide, n = raw[0], int.from_bytes(raw[1:9], "little")
    totals = np.frombuffer(raw, dtype=np.uint8, count=n, offset=9).astype(np.int64)
    totals[totals == 255] = np.frombuffer(raw, dtype=f"<u{wide}", offset=9 + n)
    return totals
