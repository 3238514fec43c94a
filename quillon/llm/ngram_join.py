"""N-gram Jaccard join by vertical partitioning.

A document is the set of its SIZE-word shingles, as 64-bit hashes. The global order of n-grams (estimated frequency, then
hash) is cut into fragments. A set's first fragment, its prefix, is where two similar sets must meet: candidates come from
there. Overlaps are then counted fragment by fragment, each apart from the others, and summed per pair.

Equal sets are one class, of which one representative takes part. Large groups of near copies would give all their pairs;
since only links between groups matter to components, members are first linked to a few hubs of equal min-hashes, and the
prefix join then looks for pairs of different components only. Every link found is verified by the whole sets, and no
n-gram, pair or partner is dropped: what is linked by some path has the same component as if all pairs were compared.

Defined cases: a null or empty text, or one without words, has an empty set and no links; fewer than SIZE words are one
shingle; rows that repeat an id are documents of their own; a null doc_id has no component; an empty table has no rows;
extra columns are not looked at.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import RangeHash, giving_back, meet, mix, partitions, released, stored, words
from .graph import components

SIZE = 5
#: Least Jaccard similarity, in per cent.
LEAST = 75
#: Counters of the frequency sketch, by hash; they only order n-grams, so their errors cost time, not links.
SKETCH_BITS = 21
CHUNK_BITS = 12
#: Min-hashes of a set, and how many of them are looked up for hubs.
MINHASHES, LOOKED_UP = 16, 6
#: Of a member's and a hub's min-hashes so many must agree before both are compared.
AGREE = 10
#: Hubs that a set is compared with in a round, and rounds at most; a round without new links is the last.
HUBS, HUB_ROUNDS = 3, 2
#: Buckets that show which n-grams a set has none of.
SET_BITS = 2048
FRAGMENTS = 4
#: A Bloom filter has at most 2**BLOOM_BITS bits (2 MB): what is broadcast is bounded by it.
BLOOM_BITS = 24

#: Keys of at least HOT_KEY sets are hot; of a set's earlier hot keys so many are remembered.
HOT_KEY, EARLIER = 32, 32
#: N-grams that a task gathers before it deals them out.
DEALT = 1 << 19

_hash: list[RangeHash] = []


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    found = words(text)
    if not found:
        return np.zeros(0, dtype=np.uint64)
    if not _hash:
        _hash.append(RangeHash())
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = min(size, len(found))
    return np.unique(_hash[0](b" ".join(found), starts[: len(found) - n + 1], ends[n - 1 :]))


# --- counts by bucket, and filters built of them ---


def _bucket_counts(hashes: DataFrame, make: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int) -> np.ndarray:
    """How many of the hashes that make yields for each batch fall into each of 2**bits buckets.

    A task sums its own counters; sums of tasks meet in chunks, first within 256 tasks, then all. The driver gets the counters alone.
    """
    chunk = 1 << min(bits, CHUNK_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(1 << bits, dtype=np.uint32)
        held: list[np.ndarray] = []
        size = 0

        def add() -> None:
            nonlocal size
            if held:
                total[:] += np.bincount((np.concatenate(held) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint32)
            held.clear()
            size = 0

        for batch in batches:
            for part in make(batch):
                held.append(part)
                size += len(part)
                if size > 1 << 19:
                    add()
        add()
        if not total.any():
            return
        group = TaskContext.get().partitionId() >> 8
        for at in range(0, 1 << bits, chunk):
            yield pa.RecordBatch.from_arrays([pa.array([at // chunk], pa.int32()), pa.array([group], pa.int32()), pa.array([total[at : at + chunk].tobytes()])], names=["chunk", "group", "counts"])

    def add_up(table: pa.Table) -> pa.Table:
        total = np.zeros(chunk, dtype=np.uint64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_buffer(), dtype=np.uint32)
        most = np.minimum(total, np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return pa.table({"chunk": table.column("chunk")[:1].cast(pa.int32()), "counts": pa.array([most.tobytes()])})

    sums = hashes.mapInArrow(giving_back(count), "chunk int, group int, counts binary").groupBy("chunk", "group").applyInArrow(add_up, "chunk int, counts binary")
    found = np.zeros(1 << bits, dtype=np.uint32)
    for at, counts in sums.groupBy("chunk").applyInArrow(add_up, "chunk int, counts binary").collect():
        found[at * chunk : (at + 1) * chunk] = np.frombuffer(counts, dtype=np.uint32)
    return found


class Bloom:
    """A filter of bigints, broadcast until it is dropped. It lets all of its keys pass, and few others while they fit its bits."""

    def __init__(self, spark: SparkSession, packed: np.ndarray, bits: int) -> None:
        self.packed, self.bits = spark.sparkContext.broadcast(packed), bits

    def __call__(self, values: np.ndarray) -> np.ndarray:
        place = (mix(values.view(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.packed.value[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1

    def drop(self) -> None:
        """Free it everywhere; what was made with it must be stored."""
        self.packed.destroy()


def _bloom(keys: DataFrame, spark: SparkSession) -> Bloom:
    """A filter of the bigints of keys (one column)."""
    bits = min(BLOOM_BITS, max(16, (16 * max(1, keys.count())).bit_length()))
    chunk = 1 << min(bits - 3, CHUNK_BITS)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen = np.zeros(1 << bits, dtype=bool)
        for batch in batches:
            seen[(mix(batch.column(0).to_numpy().view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)] = True
        packed = np.packbits(seen)
        group = TaskContext.get().partitionId() >> 8
        for at in range(0, len(packed), chunk):
            if (own := packed[at : at + chunk]).any():
                yield pa.RecordBatch.from_arrays([pa.array([at // chunk], pa.int32()), pa.array([group], pa.int32()), pa.array([own.tobytes()])], names=["chunk", "group", "bits"])

    def unite(table: pa.Table) -> pa.Table:
        all_ = np.zeros(chunk, dtype=np.uint8)
        for x in table.column("bits"):
            all_ |= np.frombuffer(x.as_buffer(), dtype=np.uint8)
        return pa.table({"chunk": table.column("chunk")[:1].cast(pa.int32()), "bits": pa.array([all_.tobytes()])})

    united = keys.mapInArrow(giving_back(mark), "chunk int, group int, bits binary").groupBy("chunk", "group").applyInArrow(unite, "chunk int, bits binary")
    found = np.zeros(1 << bits - 3, dtype=np.uint8)
    for at, own in united.groupBy("chunk").applyInArrow(unite, "chunk int, bits binary").collect():
        found[at * chunk : (at + 1) * chunk] = np.frombuffer(own, dtype=np.uint8)
    return Bloom(spark, found, bits)


def _passes(test: Callable[[np.ndarray], np.ndarray], column: Column) -> Column:
    @F.pandas_udf("boolean")
    def passes(values: pd.Series) -> pd.Series:
        known = values.notna().to_numpy()
        out = np.zeros(len(values), dtype=bool)
        out[known] = test(values[known].to_numpy(dtype=np.int64))
        return pd.Series(out)

    return passes(column)


def _known_and(test: Callable[[np.ndarray], np.ndarray], values: pa.Array) -> np.ndarray:
    known = values.is_valid().to_numpy(zero_copy_only=False)
    return known & test(values.fill_null(0).to_numpy())


# --- sets, classes, prefixes ---


def prefix_length(n: int, least: int = LEAST) -> int:
    """So many of a set's first n-grams meet those of any similar set."""
    return n - -(-least * n // 100) + 1


def index_length(n: int, least: int = LEAST) -> int:
    """So many of a set's first n-grams meet the prefix of any similar set that is no smaller."""
    return n - -(-2 * least * n // (100 + least)) + 1


def _occupied(own: np.ndarray) -> bytes:
    """Which of SET_BITS buckets a set's n-grams fall into. A bucket that one set occupies and another doesn't holds at
    least one n-gram of the first alone, so such buckets bound the overlap from above, whatever the collisions."""
    seen = np.zeros(SET_BITS, dtype=bool)
    seen[(own >> np.uint64(64 - SET_BITS.bit_length() + 1)).astype(np.int64)] = True
    return np.packbits(seen).tobytes()


FEATURES = "doc_id bigint, n int, v bigint, w bigint, minhash binary, prefix binary, last int, bits binary"


def features(docs: DataFrame, size: int = SIZE, least: int = LEAST) -> DataFrame:
    """Per row of docs (doc_id, text): n, the set's 128-bit hash (v, w), min-hashes, the prefix in global order
    and the frequency level of its last n-gram, and the occupied of SET_BITS buckets; a stored table."""
    texts = docs.select("text")
    counts = _bucket_counts(texts, lambda batch: (shingles(t.as_py(), size) for t in batch.column(0)), SKETCH_BITS)
    levels_of = np.empty(len(counts), dtype=np.uint8)
    for at in range(0, len(counts), 1 << 16):  # in pieces: the driver's memory is small
        levels_of[at : at + (1 << 16)] = np.round(8 * np.log2(1.0 + counts[at : at + (1 << 16)]))
    level = docs.sparkSession.sparkContext.broadcast(levels_of)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("v", pa.int64()), ("w", pa.int64()), ("minhash", pa.binary()), ("prefix", pa.binary()), ("last", pa.int32()), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = level.value
        odd = mix(np.arange(1, MINHASHES + 1, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column(1):
                own = shingles(text.as_py(), size)
                n = len(own)
                if not n:
                    rows.append((0, 0, 0, b"", b"", 0, b""))
                    continue
                digest = xxhash.xxh3_128_digest(own.tobytes())
                v, w = (int.from_bytes(digest[i : i + 8], "little", signed=True) for i in (0, 8))
                with np.errstate(over="ignore"):
                    least_of = ((own[None, :] * odd[:, None]) >> np.uint64(32)).min(axis=1).astype("<u4")
                k = prefix_length(n, least)
                order = levels[(own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                if k < n:
                    # the k smallest levels first; own is sorted by hash, so a stable sort keeps the global order
                    edge = np.partition(order, k - 1)[k - 1]
                    near = np.flatnonzero(order <= edge)
                    first = own[near[np.argsort(order[near], kind="stable")[:k]]]
                else:
                    first = own[np.argsort(order, kind="stable")]
                rows.append((n, v, w, least_of.tobytes(), first.astype("<u8").tobytes(), int(levels[int(first[-1]) >> (64 - SKETCH_BITS)]), _occupied(own)))
            n, v, w, minhash, prefix, last, bits = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(v, pa.int64()), pa.array(w, pa.int64()), pa.array(minhash, pa.binary()), pa.array(prefix, pa.binary()), pa.array(last, pa.int32()), pa.array(bits, pa.binary())], schema=schema)

    out = stored(docs.mapInArrow(giving_back(run), FEATURES), "sets")
    level.destroy()
    return out


# --- verification ---


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, size: int = SIZE, least: int = LEAST) -> DataFrame:
    """Of pairs (a, b of reps' v) those whose whole sets are similar, as a stored table. reps: v, rep (its doc_id).

    The sets of all documents in pairs are cut into fragments by hash; overlaps are counted in each fragment and summed.
    """
    spark = docs.sparkSession
    used = pairs.select(F.col("a").alias("v")).unionByName(pairs.select(F.col("b").alias("v"))).distinct()
    used = stored(meet(reps.select("v", "rep"), used, "v", "left_semi"), "used", narrow=True)
    wanted = _bloom(used.select("rep"), spark)
    shift = np.uint64(64 - (FRAGMENTS.bit_length() - 1))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(_known_and(wanted, batch.column(0))))
            out: list[tuple] = []
            for text in batch.column(1):
                own = shingles(text.as_py(), size)
                if len(own):
                    v = int.from_bytes(xxhash.xxh3_128_digest(own.tobytes())[:8], "little", signed=True)
                    ends = np.searchsorted(own >> shift, np.arange(FRAGMENTS + 1, dtype=np.uint64))
                    out.extend((v, f, len(own), own[ends[f] : ends[f + 1]].tobytes()) for f in range(FRAGMENTS))
            v, f, n, part = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(f, pa.int32()), pa.array(n, pa.int32()), pa.array(part, pa.binary())], names=["v", "fragment", "n", "part"])

    # rows that the filter lets pass by chance meet no pair, unless their set is that of a representative: once is enough
    parts = docs.select("doc_id", "text").mapInArrow(giving_back(cut), "v bigint, fragment int, n int, part binary").repartition("v")
    parts = parts.groupBy("v", "fragment").agg(F.first("n").alias("n"), F.first("part").alias("part"))
    parts = stored(meet(parts, used.select("v"), "v", "left_semi"), "fragments")
    wanted.drop()
    each = pairs.select("a", "b", F.explode(F.array(*[F.lit(f) for f in range(FRAGMENTS)])).alias("fragment"))
    one = parts.select(F.col("v").alias("a"), "fragment", F.col("n").alias("na"), F.col("part").alias("pa"))
    two = parts.select(F.col("v").alias("b"), "fragment", F.col("n").alias("nb"), F.col("part").alias("pb"))
    met = meet(meet(each, one, ["a", "fragment"]), two, ["b", "fragment"]).select("a", "b", "na", "nb", "pa", "pb")

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common = [
                len(np.intersect1d(np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64), assume_unique=True))
                for x, y in zip(batch.column(4), batch.column(5), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(common, pa.int32())], names=["a", "b", "na", "nb", "common"])

    counted = met.mapInArrow(giving_back(overlap), "a bigint, b bigint, na int, nb int, common int")
    sums = counted.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
    links = stored(sums.where(F.col("common") * (100 + least) >= F.lit(least).cast("long") * (F.col("na") + F.col("nb"))).select("a", "b"), "links", narrow=True)
    released(used, parts)
    return links


def _looked_up(reps: DataFrame) -> DataFrame:
    """i, h, v, central: the min-hashes of each set that are looked up, and how common they are together. The set that a
    group of near copies goes back to has the min-hashes most of them have, so it is the most central. A stored table."""
    looked = F.array(*[F.struct(F.lit(i).alias("i"), F.substring("minhash", 4 * i + 1, 4).alias("h")) for i in range(LOOKED_UP)])
    keyed = reps.select("v", F.inline(looked))
    # stored, so that nothing but the join stands above both shuffles, and a min-hash of very many sets can be split
    common = stored(keyed.groupBy("i", "h").agg(F.count("*").alias("members")).where("members > 1"), "common", narrow=True)
    met = stored(meet(keyed, common, ["i", "h"]), "met-minhashes", narrow=True)
    central = met.groupBy("v").agg(F.sum("members").alias("central"))
    out = stored(meet(met.drop("members"), central, "v"), "minhashes", narrow=True)
    released(common, met)
    return out


def _hub_pairs(looked: DataFrame, reps: DataFrame, comps: DataFrame | None, round_: int, least: int) -> DataFrame:
    """Pairs of a set and a hub of another component that share a min-hash; linear in the sets, however large their groups.

    A min-hash's hub is of the component that most of its sets are of: the most central, in further rounds any. A set keeps
    the hubs that most min-hashes agree with, up to three. A stored table.
    """
    if comps is None:
        labelled = looked.withColumn("comp", F.col("v"))
    else:
        labelled = stored(meet(looked, comps, "v", "left").withColumn("comp", F.coalesce("comp", "v")), "labelled", narrow=True)
    order = F.struct("central", "v") if round_ == 0 else F.struct(F.xxhash64("v", F.lit(round_)), "v")
    sizes = labelled.groupBy("i", "h", "comp").agg(F.count("*").alias("c"), F.max_by("v", order).alias("hub"), F.max("central").alias("central"))
    hubs = sizes.groupBy("i", "h").agg(F.max_by(F.struct(F.col("comp").alias("main"), "hub"), F.struct("c", "central", "comp")).alias("x")).select("i", "h", "x.*")
    hubs = stored(hubs, "hubs", narrow=True)  # a min-hash of very many sets can be split in the join, as no aggregate stands above it
    met = meet(labelled, hubs, ["i", "h"]).where("comp <> main").select("v", "hub").distinct()
    own = reps.select("v", "n", "minhash")
    hub = reps.select(F.col("v").alias("hub"), F.col("n").alias("hub_n"), F.col("minhash").alias("hub_minhash"))
    agree = sum(((F.substring("minhash", 4 * i + 1, 4) == F.substring("hub_minhash", 4 * i + 1, 4)).cast("int") for i in range(MINHASHES)), F.lit(0))
    likely = meet(meet(met, own, "v"), hub, "hub").where(F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * least)
    likely = likely.select("v", "hub", agree.alias("agree")).where(F.col("agree") >= AGREE)
    first = F.slice(F.sort_array(F.collect_set(F.struct("agree", "hub")), False), 1, HUBS)
    best = likely.groupBy("v").agg(first.alias("best"))
    pairs = best.select("v", F.explode("best.hub").alias("hub")).select(F.least("v", "hub").alias("a"), F.greatest("v", "hub").alias("b")).distinct()
    pairs = stored(pairs, "hub-pairs", narrow=True)
    released(hubs, *([labelled] if comps is not None else []))
    return pairs


def _keys(tokens: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The fragment of the key space that each n-gram falls into, and its 32-bit key there."""
    return ((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32), tokens & np.uint64(0xFFFFFFFF)


def _alone(special: Callable[[np.ndarray], np.ndarray], v: pa.Array, comp: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which rows count, and their components. A row without a component stands for itself, unless its set is special:
    then another row stands for it."""
    own = v.to_numpy()
    known = comp.is_valid().to_numpy(zero_copy_only=False)
    return np.flatnonzero(known | ~special(own)), np.where(known, comp.fill_null(0).to_numpy(), own)


def _mixed(sets: DataFrame, parts: int, special: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Keys of prefix n-grams that stand in sets of different components. sets: v, comp, prefix.

    A task sends each fragment a key's smallest and largest component only, whatever the number of sets that hold it.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: list[np.ndarray] = []
        held: list[int] = []
        size = 0

        def send() -> pa.RecordBatch:
            tokens = np.concatenate(lists)
            comps = np.repeat(np.array(held, dtype=np.int64), [len(x) for x in lists])
            fragment, key = _keys(tokens, parts)
            whole = (fragment << np.uint64(32)) | key
            order = np.lexsort((comps, whole))
            whole, comps = whole[order], comps[order]
            start = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1]]))
            last = np.append(start[1:], len(whole)) - 1
            differ = comps[start] != comps[last]
            keys = np.concatenate([whole[start], whole[last[differ]]])
            comps = np.concatenate([comps[start], comps[last[differ]]])
            order = np.argsort(keys, kind="stable")
            keys, comps = keys[order], comps[order]
            low = (keys & np.uint64(0xFFFFFFFF)).astype("<u4")
            ends = np.searchsorted(keys >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
            full = np.flatnonzero(ends[1:] > ends[:-1])
            lists.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([
                pa.array(full, pa.int32()), pa.array([low[ends[f] : ends[f + 1]].tobytes() for f in full], pa.binary()),
                pa.array([comps[ends[f] : ends[f + 1]].tobytes() for f in full], pa.binary()),
            ], names=["fragment", "keys", "comps"])

        for batch in batches:
            rows, comp = _alone(special, batch.column(0), batch.column(1))
            for i in rows.tolist():
                lists.append(np.frombuffer(bytes(batch.column(2)[i].as_buffer()), dtype="<u8"))
                held.append(int(comp[i]))
                size += len(lists[-1])
                if size >= DEALT:
                    yield send()
                    size = 0
        if lists:
            yield send()

    def differing(table: pa.Table) -> pa.Table:
        fragment = table.column("fragment")[0].as_py()
        keys = np.concatenate([np.frombuffer(x.as_buffer(), dtype="<u4") for x in table.column("keys")])
        comps = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.int64) for x in table.column("comps")])
        order = np.argsort(keys, kind="stable")
        keys, comps = keys[order], comps[order]
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        mixed = np.minimum.reduceat(comps, start) != np.maximum.reduceat(comps, start)
        return pa.table({"key": pa.array((fragment << 32) + keys[start[mixed]].astype(np.int64), pa.int64())})

    return sets.select("v", "comp", "prefix").mapInArrow(giving_back(deal), "fragment int, keys binary, comps binary").groupBy("fragment").applyInArrow(differing, "key bigint")


def _postings(sets: DataFrame, parts: int, mixed: Callable[[np.ndarray], np.ndarray], hot: Callable[[np.ndarray], np.ndarray] | None, special: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """key, v, comp, n, pos and most: prefix n-grams that are mixed, and how many such stand in front in the same set.

    With hot, of hot keys only, and also before, the first EARLIER hot keys in front, and free, how many others stand
    there that a pair may share without meeting in before (all, if not every hot key in front is in before), and the
    set's buckets as bigints b0, b1 ...
    """

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, comp = _alone(special, batch.column(0), batch.column(1))
            batch, comp = batch.take(pa.array(rows)), comp[rows]
            lists = [np.frombuffer(x.as_buffer(), dtype="<u8") for x in batch.column(3)]
            sizes = np.array([len(x) for x in lists], dtype=np.int64)
            tokens = np.concatenate(lists) if lists else np.zeros(0, dtype=np.uint64)
            fragment, key = _keys(tokens, parts)
            keys = ((fragment << np.uint64(32)) | key).astype(np.int64)
            pos = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            take = np.flatnonzero(mixed(keys))
            row = np.repeat(np.arange(len(lists)), sizes)[take]
            most = np.arange(len(take)) - np.searchsorted(row, row)
            more, buckets = [], []
            if hot is not None:
                own = np.flatnonzero(hot(keys[take]))
                take, row, most = take[own], row[own], most[own]
                first = np.searchsorted(row, row)
                n_hot = np.arange(len(take)) - first
                held = keys[take].tolist()
                before = [held[f : min(i, f + EARLIER)] for i, f in enumerate(first.tolist())]
                more = [pa.array(before, pa.list_(pa.int64())), pa.array(np.where(n_hot <= EARLIER, most - n_hot, most).astype(np.int32)), pa.array(n_hot <= EARLIER)]
                bits = np.frombuffer(b"".join(x.as_py() for x in batch.column(4)), dtype="<i8").reshape(-1, SET_BITS // 64)
                buckets = [pa.array(bits[row, i]) for i in range(SET_BITS // 64)]
            yield pa.RecordBatch.from_arrays([
                pa.array(keys[take]), pa.array(batch.column(0).to_numpy()[row]), pa.array(comp[row]),
                pa.array(batch.column(2).to_numpy()[row]), pa.array(pos[take].astype(np.int32)), pa.array(most.astype(np.int32)), *more, *buckets,
            ], names=[*("key", "v", "comp", "n", "pos", "most", "before", "free", "full")[: 6 + len(more)], *(f"b{i}" for i in range(len(buckets)))])

    schema = "key bigint, v bigint, comp bigint, n int, pos int, most int"
    if hot is not None:
        schema += ", before array<bigint>, free int, full boolean" + "".join(f", b{i} bigint" for i in range(SET_BITS // 64))
    return sets.select("v", "comp", "n", "prefix", "bits").mapInArrow(giving_back(post), schema)


def _met(marked: DataFrame, least: int) -> DataFrame:
    """Pairs of different components that meet in a key of postings (and its main component), the smaller set's within its
    index, and may be similar."""
    # within the component that a key's most sets are of, nothing is left to link: only others meet all
    columns = [c for c in marked.columns if c != "key"]
    index = F.col("pos") < F.col("n") - F.ceil(F.lit(2 * least) * F.col("n") / (100 + least)) + 1
    a = marked.where(index).select("key", *[F.col(c).alias(f"a_{c}") for c in columns])
    b = marked.select("key", *[F.col(c).alias(f"b_{c}") for c in columns])
    # what both may have in front of the key, the key, and what may follow
    front = F.least("a_most", "b_most")
    if "before" in columns:
        front = F.when(F.col("a_full") & F.col("b_full"), F.least("a_free", "b_free")).otherwise(front)
    bound = front + 1 + F.least(F.col("a_n") - F.col("a_pos") - 1, F.col("b_n") - F.col("b_pos") - 1)
    may = (
        (F.col("a_comp") != F.col("b_comp"))
        & ((F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_v") < F.col("b_v"))))
        & (F.col("b_n") * least <= F.col("a_n") * 100)
        & (bound.cast("long") * (100 + least) >= F.lit(least).cast("long") * (F.col("a_n") + F.col("b_n")))
    )
    if "before" in columns:
        # n-grams of one set alone, by buckets that the other leaves empty; and a pair that has met before needs not meet again
        alone = lambda x, y: sum((F.bit_count(F.col(f"{x}_b{i}").bitwiseAND(F.bitwise_not(F.col(f"{y}_b{i}")))) for i in range(SET_BITS // 64)), F.lit(0))
        common = F.least(F.col("a_n") - alone("a", "b"), F.col("b_n") - alone("b", "a"))
        may = may & (common.cast("long") * (100 + least) >= F.lit(least).cast("long") * (F.col("a_n") + F.col("b_n")))
        may = may & ~F.arrays_overlap("a_before", "b_before")
    minor_a = meet(a.where("a_comp <> a_main"), b, "key").where(may)
    minor_b = meet(a.where("a_comp = a_main"), b.where("b_comp <> b_main"), "key").where(may)
    return minor_a.select("a_v", "b_v").unionByName(minor_b.select("a_v", "b_v")).select(F.least("a_v", "b_v").alias("a"), F.greatest("a_v", "b_v").alias("b"))


def _prefix_pairs(sets: DataFrame, special: Callable[[np.ndarray], np.ndarray], least: int) -> DataFrame:
    """Pairs of sets (v, comp, n, prefix, bits) of different components that meet in their prefixes and may be similar.

    Keys that very many sets hold are joined apart, with each set's earlier such keys, so that a pair meets in the first
    of them alone and not in each that it shares. A stored table.
    """
    spark = sets.sparkSession
    parts = partitions(spark)
    mixed = stored(_mixed(sets, parts, special), "mixed", narrow=True)
    is_mixed = _bloom(mixed, spark)
    postings = stored(_postings(sets, parts, is_mixed, None, special), "postings")
    counts = postings.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key")
    main = counts.agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("comps"), F.sum("c").alias("holders")).where("comps > 1")
    main = stored(main, "keys", narrow=True)
    # what counts as hot is the filter's word, the same for every set
    hot_keys = stored(main.where(F.col("holders") >= HOT_KEY).select("key"), "hot-keys", narrow=True)
    hot = _bloom(hot_keys, spark)
    mains = main.select("key", "main")
    cold = stored(meet(postings.where(~_passes(hot, F.col("key"))), mains, "key"), "cold", narrow=True)
    warm = stored(meet(_postings(sets, parts, is_mixed, hot, special), mains, "key"), "warm")
    pairs = stored(_met(cold, least).unionByName(_met(warm, least)).distinct(), "prefix-pairs", narrow=True)
    is_mixed.drop()
    hot.drop()
    released(mixed, postings, main, hot_keys, cold, warm)
    return pairs


def _promising(pairs: DataFrame, found: DataFrame, least: int) -> DataFrame:
    """Of pairs those whose overlap in the first fragment, the prefixes, leaves room for similarity.

    Beyond the prefix that ends first in the global order, the rest of its set bounds what may still be common. A stored table.
    """
    used = stored(pairs.select(F.col("a").alias("v")).unionByName(pairs.select(F.col("b").alias("v"))).distinct(), "met", narrow=True)
    wanted = _bloom(used, found.sparkSession)
    own = found.where(_passes(wanted, F.col("v"))).groupBy("v").agg(*(F.first(c).alias(c) for c in ("n", "last", "prefix", "bits")))
    own = stored(meet(own, used, "v", "left_semi"), "prefixes")
    wanted.drop()
    one = own.select(F.col("v").alias("a"), F.col("n").alias("na"), F.col("last").alias("la"), F.col("prefix").alias("pa"), F.col("bits").alias("ba"))
    two = own.select(F.col("v").alias("b"), F.col("n").alias("nb"), F.col("last").alias("lb"), F.col("prefix").alias("pb"), F.col("bits").alias("bb"))
    met = meet(meet(pairs, one, "a"), two, "b").select("a", "b", "na", "nb", "la", "lb", "pa", "pb", "ba", "bb")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, la, lb, x, y, p, q in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), *(batch.column(i) for i in range(6, 10)), strict=True):
                p, q = (np.frombuffer(z.as_buffer(), dtype="<u8") for z in (p, q))
                common = min(na - int(np.bitwise_count(p & ~q).sum()), nb - int(np.bitwise_count(q & ~p).sum()))
                x, y = np.frombuffer(x.as_buffer(), dtype="<u8"), np.frombuffer(y.as_buffer(), dtype="<u8")
                rest = na - len(x) if (la, int(x[-1])) <= (lb, int(y[-1])) else nb - len(y)
                keep.append(min(common, len(np.intersect1d(x, y, assume_unique=True)) + rest) * (100 + least) >= least * (na + nb))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    out = stored(met.mapInArrow(giving_back(bounded), "a bigint, b bigint"), "promising-pairs", narrow=True)
    released(used, own)
    return out


def join(docs: DataFrame, size: int = SIZE, least: int = LEAST) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included) and the
    class of its set (v, w: equal sets share it)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = features(docs, size, least)
    known = found.where("n > 0 and doc_id is not null")
    classes = stored(known.groupBy("v", "w", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), "classes", narrow=True)
    keyed = classes.select("rep", F.col("v").alias("__v"), F.col("w").alias("__w"))
    is_rep = (found["doc_id"] == keyed["rep"]) & (found["v"] == keyed["__v"]) & (found["w"] == keyed["__w"])
    narrow = stored(meet(found, keyed, is_rep).select("rep", "v", "n", "minhash").dropDuplicates(["v"]), "signatures")
    looked = _looked_up(narrow)
    links: list[DataFrame] = []
    comps = None
    every = lambda: functools.reduce(DataFrame.unionByName, links)
    for round_ in range(HUB_ROUNDS):
        pairs = _hub_pairs(looked, narrow, comps, round_, least)
        links.append(verified(pairs, docs, narrow, size, least))
        released(pairs)
        if comps is not None and links[-1].isEmpty():
            break
        comps = components(every())
    released(looked)
    # prefixes stay where they are, but for those of linked sets and of sets that several rows have
    special = stored(classes.where("rows > 1").select("v").unionByName(comps.select("v")), "special", narrow=True)
    is_special = _bloom(special, docs.sparkSession)
    alone = known.select("v", F.lit(None).cast("long").alias("comp"), "n", "prefix", "bits")
    others = known.where(_passes(is_special, F.col("v"))).groupBy("v").agg(*(F.first(c).alias(c) for c in ("n", "prefix", "bits")))
    others = stored(meet(others, comps, "v", "left").select("v", F.coalesce("comp", "v").alias("comp"), "n", "prefix", "bits"), "linked-sets")
    pairs = _prefix_pairs(alone.unionByName(others), is_special, least)
    is_special.drop()
    promising = _promising(pairs, known, least)
    links.append(verified(promising, docs, narrow, size, least))
    comps = components(every())
    released(special, others, pairs, promising, narrow, *links)
    # a component's smallest document, over the classes of its sets; a class that stands alone and has one row needs no name
    linked = stored(meet(classes.select("v", "w", "rep"), comps, "v"), "linked-classes", narrow=True)
    least_of = stored(linked.groupBy("comp").agg(F.min("rep").alias("component")), "components", narrow=True)
    named = meet(linked, least_of, "comp").select("v", "w", "component")
    several = meet(classes.where("rows > 1"), comps, "v", "left_anti").select("v", "w", F.col("rep").alias("component"))
    named = named.unionByName(several).select(F.col("v").alias("__v"), F.col("w").alias("__w"), "component")
    rows = found.select("doc_id", "n", "v", "w")
    out = meet(rows, named, (rows["v"] == named["__v"]) & (rows["w"] == named["__w"]) & (rows["n"] > 0), "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"), "v", "w")


def deduplicate(docs: DataFrame, size: int = SIZE, least: int = LEAST) -> DataFrame:
    """The rows of docs, with all their columns, of which one of each component stays: that with the smallest doc_id.
    Rows without words, or without an id, all stay; rows that repeat an id are one document, which goes if any of them is a
    copy of another's, and of which the row with the smallest text stays."""
    linked = stored(join(docs, size, least).where("n_shingles > 0 and doc_id is not null").select("doc_id", "component_id"), "joined", narrow=True)
    drop = linked.where("doc_id <> component_id").select(F.col("doc_id").alias("__doc")).distinct()
    kept = meet(docs, drop, docs["doc_id"].cast("long") == drop["__doc"], "left_anti")
    twice = stored(linked.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__twice")), "repeated", narrow=True)
    if twice.isEmpty():
        return kept
    # rare: ids that stand for several rows
    once = meet(kept, twice, kept["doc_id"].cast("long") == twice["__twice"], "left_anti")
    again = meet(kept, twice, kept["doc_id"].cast("long") == twice["__twice"], "left_semi")
    first = again.withColumn("__n", F.row_number().over(Window.partitionBy(again["doc_id"]).orderBy(again["text"]))).where("__n = 1").drop("__n")
    return once.unionByName(first)
