"""Token ids in a Simple-8b file format.

Words of 64 bits: a 4-bit selector, then as many ids of the selector's width as fit in 60 bits. Selector 15 is an escape:
the next word is one id in full. The ids of a stretch of documents make a block, a row of a Parquet table with the
block's place, its documents, their numbers of ids, and its words; blocks so decode independently of each other, and
within a block all words of a selector at once.

Defined cases: a null or empty text has no ids but the end id; documents are in ascending doc_id order, null ids first,
ties by text; rows that repeat an id are documents of their own; an empty table gives an empty file; extra columns are not
looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RangeHash, giving_back, new_path, partitions

#: Ids in a word and bits of an id, by selector; the escape has the last selector.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = tuple(60 // n for n in COUNTS)
ESCAPE = 15
END_ID = 2
#: A block is closed at this many ids, after the document that reaches it.
BLOCK_IDS = 1 << 16
#: Pieces of text whose ids a worker remembers.
CACHE = 1_000_000
#: Texts that a worker encodes at once: arrays of all their bytes and pieces are made, many times the texts themselves.
AT_ONCE = 125
TOKENIZER = "word_bpe_49k.json"


#: Bits of small ids.
BITS = np.array([max(1, i.bit_length()) for i in range(1 << 16)], dtype=np.uint8)


def encode(ids: np.ndarray) -> np.ndarray:
    """uint64 ids as Simple-8b words. Each place is given the selector that packs most; a walk then keeps the words' starts."""
    ids = np.asarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    top = int(ids.max())
    if top < len(BITS):
        bits = BITS[ids]
    else:
        bits = np.ones(n, dtype=np.uint8)
        for shift in (32, 16, 8, 4, 2, 1):
            bits += np.where((ids >> (bits.astype(np.uint64) + np.uint64(shift - 1))) > 0, np.uint8(shift), np.uint8(0))
    # the most bits in a window of each count, from windows of half its size; once no window fits, no longer one does
    chosen = np.full(n, ESCAPE, dtype=np.int64)
    doubled, size = bits, 1
    for selector in range(len(COUNTS) - 1, -1, -1):
        count, width = COUNTS[selector], WIDTHS[selector]
        if n < count:
            break
        while 2 * size <= count:
            doubled = np.maximum(doubled[: len(doubled) - size], doubled[size:])
            size *= 2
        fits = np.maximum(doubled[: n - count + 1], doubled[count - size : n - size + 1]) <= width
        if not fits.any():
            break
        chosen[: n - count + 1][fits] = selector
    steps = np.array([*COUNTS, 1, 1], dtype=np.int64)[chosen].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += steps[at]
    start = np.array(starts)
    selector = chosen[start]
    escaped = selector == ESCAPE
    place = np.arange(len(start)) + np.concatenate([[0], np.cumsum(escaped)[:-1]])
    words = np.zeros(len(start) + int(escaped.sum()), dtype=np.uint64)
    for s in np.unique(selector):
        own = selector == s
        if s == ESCAPE:
            words[place[own]] = np.uint64(ESCAPE << 60)
            words[place[own] + 1] = ids[start[own]]
            continue
        count, width = COUNTS[s], WIDTHS[s]
        taken = ids[start[own][:, None] + np.arange(count)]
        words[place[own]] = np.uint64(int(s) << 60) | np.bitwise_or.reduce(taken << (np.arange(count, dtype=np.uint64) * np.uint64(width)), axis=1)
    return words


def decode(words: np.ndarray) -> np.ndarray:
    """The ids of Simple-8b words."""
    words = np.asarray(words, dtype=np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    # what follows an escape is data, whatever its selector bits say
    for at in np.flatnonzero(selector == ESCAPE).tolist():
        if selector[at] == ESCAPE:
            selector[at + 1] = -1
    heads = np.flatnonzero(selector >= 0)
    own = selector[heads]
    counts = np.array([*COUNTS, 1, 1], dtype=np.int64)[own]
    start = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(int(start[-1]), dtype=np.uint64)
    for s in np.unique(own):
        which = np.flatnonzero(own == s)
        if s == ESCAPE:
            out[start[which]] = words[heads[which] + 1]
            continue
        count, width = COUNTS[s], WIDTHS[s]
        shifts = np.arange(count, dtype=np.uint64) * np.uint64(width)
        out[start[which][:, None] + np.arange(count)] = (words[heads[which]][:, None] >> shifts) & np.uint64((1 << width) - 1)
    return out


#: A mark after a letter and before a space or line end: the pre-tokenizer splits there in any case.
MARK = re.compile(r"(?<=[a-z\xdf-\xf6\xf8-\xff])([,.])(?=[ \n])")


def _simplified(text: str) -> str:
    """A text with the same ids and fewer different pieces: lower case, and marks apart from words. Only texts of
    Latin-1 are changed, whose lower case is the normaliser's, and none that could hold a special token."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text if "<|" in text else MARK.sub(r" \1", text.lower())


class Encoder:
    """Ids of whole texts. The tokenizer's pre-tokenizer drops white space and splits at it, so pieces between spaces and
    line ends are encoded once and remembered, as long as a worker lives or CACHE pieces are reached.

    A piece is known by a 64-bit hash and its length; for each the ids stand in one array. That is about 30 bytes a piece.
    """

    def __init__(self, name: str = TOKENIZER) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        vocabulary = self.tokenizer.get_vocab()
        #: whether an id closes a word
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.hash = RangeHash()
        self._forget()

    def _forget(self) -> None:
        #: keys in order, and the entry of each; entries have the piece's length and the place and number of its ids
        self.keys = np.zeros(0, dtype=np.uint64)
        self.entry = np.zeros(0, dtype=np.int32)
        self.sizes = np.zeros(1 << 16, dtype=np.int32)
        self.first = np.zeros(1 << 16, dtype=np.int64)
        self.counts = np.zeros(1 << 16, dtype=np.int32)
        self.flat = np.zeros(1 << 20, dtype=np.uint32)
        self.used = 0

    def _encoded(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after another, and how many each has."""
        # pieces of letters alone are one word each, whose last id closes it: many can be encoded as one text
        plain = [i for i, p in enumerate(new) if p.isalpha() and len(p) < 64]
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join([new[i] for i in plain])], add_special_tokens=False)[0].ids, dtype=np.uint32)
        ends = np.flatnonzero(self.closes[ids]) + 1
        each: list[np.ndarray | list[int]] = [[]] * len(new)
        if len(ends) == len(plain) and (not plain or ends[-1] == len(ids)):
            for i, own in zip(plain, np.split(ids, ends[:-1]), strict=True) if plain else ():
                each[i] = own
            taken = set(plain)
            rest = [i for i in range(len(new)) if i not in taken]
        else:
            rest = list(range(len(new)))
        for i, own in zip(rest, self.tokenizer.encode_batch_fast([new[i] for i in rest], add_special_tokens=False), strict=True):
            each[i] = own.ids
        counts = np.fromiter(map(len, each), dtype=np.int32, count=len(each))
        return np.fromiter(chain.from_iterable(x.tolist() if isinstance(x, np.ndarray) else x for x in each), dtype=np.uint32, count=int(counts.sum())), counts

    def _learn(self, keys: np.ndarray, sizes: np.ndarray, new: list[str]) -> None:
        ids, counts = self._encoded(new)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat) + len(ids), dtype=np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        n, more = len(self.keys), len(keys)
        while n + more > len(self.sizes):
            for name in ("sizes", "first", "counts"):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros_like(getattr(self, name))]))
        self.sizes[n : n + more] = sizes
        self.first[n : n + more] = self.used + np.cumsum(counts) - counts
        self.counts[n : n + more] = counts
        self.used += len(ids)
        # merged into order: the new ones' places among the old, then the old around them
        place = np.searchsorted(self.keys, keys) + np.arange(more)
        old = np.ones(n + more, dtype=bool)
        old[place] = False
        for name, new_ in (("keys", keys), ("entry", np.arange(n, n + more, dtype=np.int32))):
            merged = np.empty(n + more, dtype=new_.dtype)
            merged[place], merged[old] = new_, getattr(self, name)
            setattr(self, name, merged)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.keys) > CACHE:
            self._forget()
        raw = [_simplified(t).encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
        ends = np.flatnonzero((data == 32) | (data == 10))
        starts = np.concatenate([[0], ends[:-1] + 1])
        some = ends > starts
        starts, ends = starts[some], ends[some]
        keys, place, inverse = np.unique(self.hash(data, starts, ends), return_index=True, return_inverse=True)
        sizes = (ends - starts)[place].astype(np.int32)
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        known = (self.keys[at] == keys) & (self.sizes[self.entry[at]] == sizes) if len(self.keys) else np.zeros(len(keys), dtype=bool)
        missing = np.flatnonzero(~known)
        if len(missing):
            whole = data.tobytes()
            self._learn(keys[missing], sizes[missing], [whole[starts[i] : ends[i]].decode("utf-8", "surrogatepass") for i in place[missing]])
            # the last of a key's pieces that came is the first of them, so one of another length is learned again
            at = np.searchsorted(self.keys, keys)
        entry = self.entry[at]
        first, counts = self.first[entry][inverse], self.counts[entry][inverse].astype(np.int64)
        stop = np.cumsum(counts)
        ids = self.flat[np.repeat(first - stop + counts, counts) + np.arange(int(stop[-1]) if len(stop) else 0)]
        # pieces of each text, by where it ends
        limits = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in raw]))
        return np.split(ids, np.concatenate([[0], stop])[limits][:-1])


@lru_cache(maxsize=1)
def encoder(name: str = TOKENIZER) -> Encoder:
    """The worker's encoder."""
    return Encoder(name)


BLOCKS = "part int, block int, start bigint, n_ids bigint, docs binary, has_doc binary, counts binary, words binary"


def _blocks(part: int, rows: Iterator[tuple[int | None, np.ndarray]]) -> Iterator[dict]:
    """Blocks of documents' ids, in order. start counts the ids of the part before the block."""
    docs: list[int | None] = []
    ids: list[np.ndarray] = []
    held = start = block = 0

    def close() -> dict:
        whole = np.concatenate(ids)
        return {
            "part": part, "block": block, "start": start, "n_ids": len(whole),
            "docs": np.array([d or 0 for d in docs], dtype="<i8").tobytes(), "has_doc": bytes(d is not None for d in docs),
            "counts": np.array([len(x) for x in ids], dtype="<u4").tobytes(), "words": encode(whole).astype("<u8").tobytes(),
        }

    for doc, own in rows:
        docs.append(doc)
        ids.append(own)
        held += len(own)
        if held >= BLOCK_IDS:
            yield close()
            start, block, held = start + held, block + 1, 0
            docs, ids = [], []
    if docs:
        yield close()


def write(docs: DataFrame, path: str, tokenizer: Callable[[], Callable[[list[str]], list[np.ndarray]]] = encoder, end_id: int = END_ID) -> None:
    """Write the ids of each text, and end_id, to path, in ascending order of doc_id."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    placed = rows.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), *((c, pa.binary()) for c in ("docs", "has_doc", "counts", "words"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        to_ids = tokenizer()

        def each() -> Iterator[tuple[int | None, np.ndarray]]:
            for batch in batches:
                for at in range(0, batch.num_rows, AT_ONCE):
                    part = batch.slice(at, AT_ONCE)
                    for doc, ids in zip(part.column(0).to_pylist(), to_ids(part.column(1).to_pylist()), strict=True):
                        yield doc, np.append(ids, np.uint32(end_id))

        for row in _blocks(TaskContext.get().partitionId(), each()):
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    placed.mapInArrow(giving_back(run), BLOCKS).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """From the files alone: doc_id, start (ids of all documents before it), n_tokens and ids_crc32."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    # one number for each part: how many ids stand before it
    total, before = 0, []
    for part, n in sorted(tuple(r) for r in blocks.groupBy("part").agg(F.sum("n_ids")).collect()):
        before.append((part, total))
        total += n
    offsets = spark.createDataFrame(before, "part int, before bigint")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode(np.frombuffer(row["words"], dtype="<u8")).astype("<u4")
                counts = np.frombuffer(row["counts"], dtype="<u4").astype(np.int64)
                ends = np.cumsum(counts)
                data = memoryview(ids.tobytes())
                crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                docs = pa.array(np.frombuffer(row["docs"], dtype="<i8"), mask=np.frombuffer(row["has_doc"], dtype=np.uint8) == 0)
                yield pa.RecordBatch.from_arrays([docs, pa.array(row["before"] + row["start"] + ends - counts), pa.array(counts), pa.array(crc, pa.int64())], schema=schema)

    joined = blocks.join(F.broadcast(offsets), "part").select("before", "start", "docs", "has_doc", "counts", "words")
    return joined.mapInArrow(giving_back(run), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, **options: object) -> DataFrame:
    path = new_path(docs.sparkSession, "tokens")
    write(docs, path, **options)
    return read(docs.sparkSession, path)
