"""Hard-negative mining over one-dimensional distance keys.

Vectors are quantised to integers. Augmented by sqrt(M - |v|^2), with M the largest squared norm, the nearest vectors to
an anchor (augmented by 0) are those of the highest inner product: their squared distance is M + |a|^2 - 2 * score. Each
vector is stored with its nearest pivot and its distance to it, sorted by both. A row within r of an anchor has a key
within r of the anchor's own distance to that pivot, so a search scans key intervals that expand: first a narrow one, then,
of what was not scanned, as far as the last of the best found so far is away, which certifies them. Negatives lie in an
annulus, as no score above the positive's counts: its inner edge bounds the scan as well.

Keys fall into at most PIVOTS * BINS cells; runs of neighbouring cells make blocks of about BLOCK rows, and a cell of more
is split by hash, however many rows share a distance. Anchors go in groups of about GROUP from neighbouring cells. Only
blocks and groups that intervals join meet, each pair in a task of its own; each keeps its best k of every anchor. Pivots
are fitted to a sample of at most SAMPLE rows; every row is indexed, and nothing that is found depends on the pivots.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take no part; of rows that
share an id the least (label, vector) stands for all; shorter vectors are as if filled up with zeros, and an empty one is all zeros; ties go
to the smaller id; repeated vectors under different ids are different rows; an anchor without positives, or a positive
without negatives, gives no row; an empty table gives an empty result; extra columns are not looked at. Components
must keep inner products within 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import giving_back, meet, released, stored

SCALE = 256
PIVOTS, BINS, SAMPLE = 16, 512, 2048
BLOCK, GROUP = 2048, 512
#: Share of a positive's score down to which negatives are first searched for.
FIRST_LEVEL = 0.95
FOUND = "anchor_id bigint, positive_id bigint, vec_id bigint, score bigint"


def quantised(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and v, the components floor(scale * x) of rows that take part, one for each vec_id."""
    fine = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine)
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    least = F.min(F.struct(F.col("label").cast("long").alias("label"), whole.alias("v"))).alias("row")
    return rows.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(least).select("vec_id", "row.label", "row.v")


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Lists of integers as the rows of a matrix, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all rows of b."""
    most = lambda x: float(np.abs(x).max(initial=0))
    if most(a) * most(b) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def fitted_pivots(sample: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Distinct integer pivots: rows that are far apart, moved to the means of what is nearest to them."""
    if not len(sample):
        return sample
    chosen = [int(np.argmin((sample - sample.mean(axis=0)) ** 2 @ np.ones(sample.shape[1])))]
    far = np.full(len(sample), np.inf)
    for _ in range(pivots - 1):
        far = np.minimum(far, ((sample - sample[chosen[-1]]).astype(float) ** 2).sum(axis=1))
        if not far.max():
            break
        chosen.append(int(far.argmax()))
    centres = sample[chosen].astype(float)
    for _ in range(5):
        near = np.argmax(sample @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)
        for p in range(len(centres)):
            if (near == p).any():
                centres[p] = sample[near == p].mean(axis=0)
    return np.unique(np.rint(centres).astype(np.int64), axis=0)


@dataclass
class Keys:
    """Pivots, the largest squared norm, the width of a cell, and the blocks: pivot, least and greatest key, and parts."""

    pivots: np.ndarray
    most: int
    width: float
    blocks: np.ndarray | None = None

    def of_rows(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each augmented row, and the distance to it."""
        squared = self.most + (self.pivots**2).sum(axis=1) - 2 * products(v, self.pivots)
        near = squared.argmin(axis=1)
        return near, np.sqrt(squared[np.arange(len(v)), near].astype(float))

    def touched(self, v: np.ndarray, radius: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """Of each anchor and block, whether it may hold rows at a distance from inner to radius."""
        squared = (v**2).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1) - 2 * products(v, self.pivots)
        at = np.sqrt(squared.astype(float))[:, self.blocks["pivot"]]
        slack = 1e-6 * (1 + np.sqrt(float(self.most)))
        low, high = self.blocks["low"], self.blocks["high"]
        radius, inner = radius[:, None] + slack, inner[:, None] - slack
        return (at - radius <= high) & (low <= at + radius) & (at + high >= inner) & (radius > slack)


BLOCKS = np.dtype([("pivot", np.int64), ("first", np.int64), ("last", np.int64), ("low", float), ("high", float), ("parts", np.int64), ("group", np.int64), ("groups", np.int64)])


def blocks_of(cells: list) -> np.ndarray:
    """Blocks of about BLOCK rows from counted cells (pivot, bin, n, anchors, low, high): runs of neighbours of one pivot,
    and groups of about GROUP anchors from consecutive blocks; what is too large for one is split into parts."""
    out: list[list] = []
    sizes: list[list[int]] = []
    for c in sorted(cells, key=lambda c: (c.pivot, c.bin)):
        if out and out[-1][0] == c.pivot and sizes[-1][0] + c.n <= BLOCK:
            out[-1][2], out[-1][4] = c.bin, max(out[-1][4], c.high)
            sizes[-1] = [sizes[-1][0] + c.n, sizes[-1][1] + c.anchors]
        else:
            out.append([c.pivot, c.bin, c.bin, c.low, c.high])
            sizes.append([c.n, c.anchors])
    rows, group, held = [], 0, 0
    for row, (n, anchors) in zip(out, sizes):
        groups = max(1, -(-anchors // GROUP))
        if held and held + anchors > GROUP:
            group, held = group + 1, 0
        rows.append((*row, -(-n // BLOCK), group, groups))
        held += anchors
        if groups > 1:
            group, held = group + groups, 0
    return np.array(rows, dtype=BLOCKS)


def indexed(rows: DataFrame, is_anchor: Column) -> tuple[DataFrame, Keys] | None:
    """rows with pivot, key, block, part and group, stored sorted by (pivot, key), and the keys; None without rows."""
    spark = rows.sparkSession
    rows = stored(rows.withColumn("anchor", is_anchor), "vectors")
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda n, x: n + x * x)
    of_all = rows.agg(F.max(norm), F.max(F.size("v"))).first()
    if of_all[0] is None:
        return None
    most, width = int(of_all[0]), max(1, int(of_all[1]))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    pivots = fitted_pivots(matrix(sample.column(0), width))
    furthest = np.sqrt(most) + np.sqrt(float((pivots**2).sum(axis=1).max()))
    keys = Keys(pivots, most, max(furthest / BINS, 1e-9))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, far = keys.of_rows(matrix(batch.column(2), width))
            cells = np.minimum(far // keys.width, BINS).astype(np.int32)
            columns = [*batch.columns, pa.array(near.astype(np.int32)), pa.array(far), pa.array(cells)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "v", "anchor", "pivot", "key", "bin"])

    keyed = rows.mapInArrow(giving_back(key), "vec_id bigint, label bigint, v array<bigint>, anchor boolean, pivot int, key double, bin int")
    keyed = stored(keyed.repartitionByRange("pivot", "key", "vec_id").sortWithinPartitions("pivot", "key", "vec_id"), "distance-keys")
    released(rows)
    counts = keyed.groupBy("pivot", "bin").agg(F.count("*").alias("n"), F.sum(F.col("anchor").cast("long")).alias("anchors"), F.min("key").alias("low"), F.max("key").alias("high"))
    cells = counts.collect()
    keys.blocks = blocks_of(cells)
    # at most PIVOTS * BINS short rows
    of_cells = [(int(b["pivot"]), int(c), i, int(b["parts"]), int(b["group"]), int(b["groups"])) for i, b in enumerate(keys.blocks) for c in range(b["first"], b["last"] + 1)]
    names = spark.createDataFrame(of_cells, "pivot int, bin int, block int, parts long, group long, groups long")
    split = lambda of: F.pmod(F.xxhash64("vec_id"), F.col(of))
    placed = keyed.join(F.broadcast(names), ["pivot", "bin"])
    return placed.select("vec_id", "label", "v", "anchor", "pivot", "key", "block", split("parts").alias("part"), (F.col("group") + split("groups")).alias("group")), keys


def _width(column: pa.ChunkedArray) -> int:
    sizes = column.combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    return int(sizes.max(initial=1))


def _best(scores: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest allowed scores, ties by place."""
    at = np.flatnonzero(allowed)
    if len(at) > k:
        least = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= least]
    return at[np.argsort(-scores[at], kind="stable")][:k]


def _searched(anchors: DataFrame, rows: DataFrame, keys: Keys, k: int, low: int | None, high: int) -> DataFrame:
    """What the blocks that come into reach hold best for each anchor: the k of its label, or, with low and high, the k of
    other labels for each of its caps (the positives) in hundredths of their scores.

    anchors: vec_id, label, v, group, scanned and radius (how far was and is to be looked), inner, and caps."""

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            number = lambda n: batch.column(at[n]).to_numpy(zero_copy_only=False).astype(float)  # noqa: B023, E731
            v = matrix(batch.column(at["v"]), keys.pivots.shape[1])
            new = keys.touched(v, number("radius"), number("inner")) & ~keys.touched(v, number("scanned"), number("inner"))
            who, block = np.nonzero(new)
            parts = keys.blocks["parts"][block]
            part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            who, block = np.repeat(who, parts), np.repeat(block, parts)
            for i in range(0, len(who), 4096):
                to = slice(i, i + 4096)
                yield pa.RecordBatch.from_arrays(
                    [*batch.take(pa.array(who[to])).columns, pa.array(block[to].astype(np.int32)), pa.array(part[to])],
                    names=[*batch.schema.names, "block", "part"],
                )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema.fields)
    visits = stored(anchors.mapInArrow(reach, f"{fields}, block int, part bigint"), "visits")
    # a block goes to each group of anchors that reaches it
    wanted = visits.select(F.col("block").alias("to_block"), F.col("part").alias("to_part"), F.col("group").alias("to_group")).distinct()
    sent = meet(rows.select("block", "part", "vec_id", "label", "v"), wanted, (F.col("block") == F.col("to_block")) & (F.col("part") == F.col("to_part")))
    sent = sent.select("to_block", "to_part", "to_group", "vec_id", "label", "v")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int | None, int, int]] = []
        if left.num_rows and right.num_rows:
            right = right.sort_by("vec_id")
            width = max(_width(left["v"]), _width(right["v"]))
            scores = products(matrix(left["v"], width), matrix(right["v"], width))
            ids, theirs = right["vec_id"].to_numpy(), right["label"].to_numpy()
            for i, (anchor, label, caps) in enumerate(zip(left["vec_id"].to_pylist(), left["label"].to_pylist(), left["caps"].to_pylist())):
                if low is None:
                    out += [(anchor, None, int(ids[j]), int(scores[i, j])) for j in _best(scores[i], (theirs == label) & (ids != anchor), k)]
                    continue
                other = theirs != label
                for cap in caps:
                    top = cap["score"]
                    fit = other & (100 * scores[i] <= high * top) & (100 * scores[i] >= low * top)
                    out += [(anchor, cap["vec_id"], int(ids[j]), int(scores[i, j])) for j in _best(scores[i], fit, k)]
        columns = list(zip(*out)) or [()] * 4
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("anchor_id", "positive_id", "vec_id", "score"), columns)})

    return visits.groupBy("block", "part", "group").cogroup(sent.groupBy("to_block", "to_part", "to_group")).applyInArrow(compare, FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _away(keys: Keys, score: Column) -> Column:
    """The distance at which rows of a score lie from the anchor, null for none; those that are higher are nearer."""
    return F.when(score.isNotNull(), F.sqrt(F.greatest(keys.most + F.col("norm") - 2 * score, F.lit(0)).cast("double")))


def mine(embeddings: DataFrame, is_anchor: Column, k: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its k best
    rows of its label, the k best rows of other labels whose score is low to high hundredths of the positive's."""
    spark = embeddings.sparkSession
    index = indexed(quantised(embeddings), is_anchor)
    if index is None:
        empty = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
        return spark.createDataFrame([], empty)
    rows, keys = index
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda n, x: n + x * x)
    anchors = rows.where("anchor").select("vec_id", "label", "v", "group", norm.alias("norm"))
    no_caps = F.array().cast("array<struct<vec_id:bigint,score:bigint>>").alias("caps")
    number = lambda x: F.lit(float(x))

    # positives: near keys first, then as far as the last of them
    near = anchors.select("*", number(-1).alias("scanned"), number(keys.width).alias("radius"), number(0).alias("inner"), no_caps)
    found = stored(_first(_searched(near, rows, keys, k, None, high), k).drop("rank"), "near-positives")
    last = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    far = meet(anchors, last, "vec_id", "left").withColumn("radius", F.coalesce(_away(keys, F.col("least")), number("inf"))).drop("least")
    far = far.withColumn("scanned", number(keys.width)).withColumn("inner", number(0)).where("radius > scanned").select("*", no_caps)
    more = _searched(far, rows, keys, k, None, high)
    positives = stored(_first(found.unionByName(more), k).drop("rank"), "positives")

    # negatives: from the best positive outwards, then as far as the last of those found, or as the least score that counts
    caps = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("vec_id", "score")).alias("caps"))
    wanted = meet(anchors, caps, "vec_id")
    edge = lambda of: F.array_max(F.transform("caps", lambda c: of * c["score"]))
    wanted = wanted.withColumn("inner", _away(keys, F.floor(edge(F.lit(1)) * high / 100))).withColumn("level", F.ceil(-edge(F.lit(-1)) * FIRST_LEVEL).cast("long"))
    wanted = stored(wanted.withColumn("radius", F.greatest(_away(keys, F.col("level")), F.col("inner"))), "wanted")
    start = wanted.withColumn("scanned", number(-1)).drop("level")
    found = stored(_first(_searched(start, rows, keys, k, low, high), k).drop("rank"), "near-negatives")
    counted = found.groupBy(F.col("anchor_id").alias("vec_id"), "positive_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    each = wanted.select("vec_id", "level", F.explode("caps").alias("cap")).select("vec_id", "level", F.col("cap.vec_id").alias("positive_id"), F.col("cap.score").alias("top"))
    open_ = meet(each, counted, ["vec_id", "positive_id"], "left").withColumn("least", F.greatest(F.coalesce("least", F.ceil(F.col("top") * low / 100)), F.ceil(F.col("top") * low / 100)).cast("long"))
    open_ = open_.where(F.col("least") < F.col("level")).groupBy("vec_id").agg(F.min("least").alias("least"), F.collect_list(F.struct(F.col("positive_id").alias("vec_id"), F.col("top").alias("score"))).alias("caps"))
    again = meet(wanted.drop("caps").withColumnRenamed("radius", "scanned"), open_, "vec_id")
    again = again.withColumn("radius", _away(keys, F.col("least"))).where("radius > scanned").drop("level", "least")
    more = _searched(again.select(*start.columns), rows, keys, k, low, high)
    negatives = _first(found.unionByName(more), k).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
    tops = positives.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    joined = meet(negatives, tops, ["anchor_id", "positive_id"])
    return joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def by_label(embeddings: DataFrame, relabelled: Column) -> DataFrame:
    """embeddings with another label; other columns are left out, whatever their names."""
    return embeddings.select("vec_id", relabelled.alias("label"), "embedding")
