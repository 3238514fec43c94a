"""Prefix trie of conversations by preorder intervals.

A node is a distinct sequence of first turns. Turns are named by 120 bits of their SHA-256, a prefix by the exclusive or of
hashes of its turns with their places, which running windows give. Distinct conversations are ranked lexicographically by
the names of their turns: runs of CHUNK turns are ranked as arrays, then neighbouring runs as pairs of ranks, with half as many rows
each time, so a row stays short however long a conversation is. A node is entered at the first rank that holds it; the
order of (first rank, depth) is the preorder, and the nodes below one are those up to the end of its last rank. Leaves and
savings of subtrees are then differences of prefix sums, which are summed within ranges and offset by the ranges before
(one number a range on the driver). Copies of a conversation are one row with a count before anything is ranked.

The numerically ordered list of a node's own conversations is hashed as it streams by, sorted, so a node that a third of all
conversations end at takes no memory; a digest is sequential, so it takes one task.

Defined cases: rows with a null conv_id are none; null turns come first, rows of one turn in order of role and text; null
roles and texts are empty; repeated rows are turns of their own; an empty table has no node, not even a root; extra columns
are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import meet, partitions, released, stored
from .mixing import n_words

CHUNK = 64
SHARED, HEADS = 20, 4
KEY = ("a", "b", "depth")


def numbered(df: DataFrame, order: list[Column], name: str, *kept: Column | str) -> DataFrame:
    """kept columns of df, stored in order, with at, the place of each row from 0, and part, the range it stands in."""
    spark = df.sparkSession
    sorted_ = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    rows = stored(sorted_.select(*kept, F.monotonically_increasing_id().alias("at")), name)
    part = F.shiftright("at", 33).cast("int")
    offsets, before = [], 0
    for p, n in sorted((r[0], r[1]) for r in rows.groupBy(part).count().collect()):
        offsets.append((p, before))
        before += n
    ranges = spark.createDataFrame(offsets, "part int, before long")
    placed = rows.withColumn("part", part).join(F.broadcast(ranges), "part")
    return placed.withColumn("at", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("before")


def summed(rows: DataFrame, **values: Column) -> DataFrame:
    """numbered rows with the sums of values over all rows up to each, itself included."""
    spark = rows.sparkSession
    totals = {}
    for r in rows.groupBy("part").agg(*[F.sum(v).alias(n) for n, v in values.items()]).collect():
        totals[r.part] = [r[n] for n in values]
    offsets, before = [], [0] * len(values)
    for p in sorted(totals):
        offsets.append((p, *before))
        before = [x + y for x, y in zip(before, totals[p])]
    ranges = spark.createDataFrame(offsets, "part int" + "".join(f", __{n} long" for n in values))
    within = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.select("*", *[F.sum(v).over(within).alias(n) for n, v in values.items()]).join(F.broadcast(ranges), "part")
    return run.withColumns({n: F.col(n) + F.col(f"__{n}") for n in values}).drop(*[f"__{n}" for n in values])


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at, the name of each turn (a, b) and its words, in order; texts move once."""
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    name = lambda at: F.conv(F.substring(said, at, 15), 16, 10).cast("long")
    clean = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), F.col("turn"), clean("role"), clean("text"))
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    return numbered(rows, order, "turns", "conv_id", name(1).alias("a"), name(16).alias("b"), n_words(F.col("text")).alias("words"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conv_ids; and conv_id, i, a, b, words of the turns of each, the first few of which come from the conversation at the head of its
    SHARED ids."""
    said = turns(conversations)
    own = said.groupBy("conv_id").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    heads = own.where(F.col("conv_id") % SHARED == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(HEADS))
    info = own.select("conv_id", "first", taken.alias("h"), (F.col("conv_id") - F.col("conv_id") % SHARED).alias("base"))
    info = stored(meet(info, heads, "base", "left").withColumn("kept", F.least("h", F.coalesce("n_base", F.lit(0)))), "conversations", narrow=True)
    placed = meet(said, info, "conv_id").withColumn("at", F.col("at") - F.col("first"))
    rest = placed.where("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("kept")).alias("i"), "a", "b", "words")
    begun = placed.where((F.col("conv_id") % SHARED == 0) & (F.col("at") < HEADS - 1)).select(F.col("conv_id").alias("base"), F.col("at").alias("i"), "a", "b", "words")
    begun = meet(begun, info.select("conv_id", "base", "h"), "base").where("i < h").select("conv_id", "i", "a", "b", "words")
    both = rest.unionByName(begun)
    # the place is part of what a turn adds to a prefix
    mixed = both.select("conv_id", "i", F.xxhash64("i", "a", "b").alias("a"), F.xxhash64("b", "a", "i", F.lit(7)).alias("b"), "words")
    return info.select("conv_id"), stored(mixed, "rebuilt")


def _joined_back(rows: DataFrame, names: DataFrame, *on: str) -> DataFrame:
    return meet(rows, names.select(*on, F.col("at").alias("name")), list(on))


def ranks(paths: DataFrame) -> DataFrame:
    """rep and pos, the lexicographic rank from 1 of the turns of each; all are different."""
    chunk = F.transform(F.array_sort(F.collect_list(F.struct("i", "a", "b"))), lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b")))
    run = paths.groupBy("rep", F.floor(F.col("i") / CHUNK).cast("long").alias("c")).agg(chunk.alias("turns"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.count("*").alias("n"))
    run = stored(run, "runs")
    distinct = run.groupBy("a", "b", "n").agg(F.first("turns").alias("turns"))
    level = stored(_joined_back(run, numbered(distinct, [F.col("turns").asc()], "ranked", "a", "b", "n"), "a", "b", "n").select("rep", "c", "name"), "names", narrow=True)
    released(run)
    while level.where("c > 0").limit(1).count():
        half = lambda odd: F.max(F.when(F.col("c") % 2 == odd, F.col("name")))
        pairs = stored(level.groupBy("rep", F.floor(F.col("c") / 2).alias("c")).agg(half(0).alias("l"), F.coalesce(half(1), F.lit(-1)).alias("r")), "pairs", narrow=True)
        known = numbered(pairs.select("l", "r").distinct(), [F.col("l").asc(), F.col("r").asc()], "ranked", "l", "r")
        next_ = stored(_joined_back(pairs, known, "l", "r").select("rep", "c", "name"), "names", narrow=True)
        released(level, pairs)
        level = next_
    return level.select("rep", (F.col("name") + 1).alias("pos"))


def digests(members: DataFrame) -> DataFrame:
    """The key of each node at which conversations end, and the digest of their ids, in order."""
    spark = members.sparkSession
    rows = members.repartition(partitions(spark), *KEY).sortWithinPartitions(*KEY, "conv_id").select(*KEY, "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, done = None, None, []

        def out() -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * 4
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=[*KEY, "digest"])

        for batch in batches:
            for *own, conv in zip(*[c.to_pylist() for c in batch.columns]):
                if own != key:
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = own, hashlib.sha256(str(conv).encode())
                else:
                    digest.update(b",%d" % conv)
            if len(done) > 1000:
                yield out()
        if key is not None:
            done.append((*key, digest.hexdigest()))
        yield out()

    return rows.mapInArrow(run, "a bigint, b bigint, depth bigint, digest string")


def encode(conversations: DataFrame) -> DataFrame:
    """Per node: its columns, its place in preorder, and end, the place after the last node below it."""
    ids, rows = rebuilt(conversations)
    whole = rows.groupBy("conv_id").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.count("*").alias("depth"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    whole = stored(meet(ids, whole, "conv_id", "left").select("conv_id", *map(none, KEY)), "members", narrow=True)
    classes = stored(whole.groupBy(*KEY).agg(F.min("conv_id").alias("rep"), F.count("*").alias("copies")), "classes", narrow=True)

    said = meet(rows, classes.select("rep", "copies"), F.col("conv_id") == F.col("rep")).select("rep", "copies", "i", "a", "b", "words")
    paths = stored(said, "paths")
    running = Window.partitionBy("rep").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    prefix = meet(paths, stored(ranks(paths), "ranks", narrow=True), "rep").select("rep", "copies", "pos", (F.col("i") + 1).alias("depth"), "words", F.col("a").alias("own_a"), F.col("b").alias("own_b"), F.bit_xor("a").over(running).alias("a"), F.bit_xor("b").over(running).alias("b"))
    above = [F.col("a").bitwiseXOR(F.max("own_a")).alias("above_a"), F.col("b").bitwiseXOR(F.max("own_b")).alias("above_b")]
    found = [F.min("rep").alias("conv_id"), F.sum("copies").alias("n_convs"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.max("words").alias("words")]
    nodes = prefix.groupBy(*KEY).agg(*found, *above)
    zero = lambda n: F.lit(0).cast("long").alias(n)
    root = classes.agg(F.min("rep").alias("conv_id"), F.sum("copies").alias("n_convs"), F.count_if(F.col("depth") > 0).alias("last")).where("n_convs > 0")
    absent = F.lit(None).cast("long")
    root = root.select(*map(zero, KEY), "conv_id", "n_convs", zero("first"), "last", zero("words"), absent.alias("above_a"), absent.alias("above_b"))
    nodes = stored(nodes.unionByName(root), "nodes")

    children = nodes.where("depth > 0").groupBy(F.col("above_a").alias("a"), F.col("above_b").alias("b"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("a").alias("above_a"), F.col("b").alias("above_b"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    full = meet(meet(nodes, children, list(KEY), "left"), digests(whole), list(KEY), "left")
    full = meet(full, parents, ["above_a", "above_b", "depth"], "left").withColumn("n_children", none("n_children"))
    kept = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "first", "last", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256")]
    placed = numbered(full, [F.col("first").asc(), F.col("depth").asc()], "preorder", *kept)
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    sums = stored(summed(placed, leaves=leaf, savings=F.col("saved")), "sums")
    ends = sums.groupBy(F.col("first").alias("last")).agg(F.max("leaves").alias("leaves_to"), F.max("savings").alias("savings_to"), (F.max("at") + 1).alias("end"))
    return meet(sums, ends, "last").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaves_to") - F.col("leaves") + leaf).alias("n_leaves"),
        (F.col("savings_to") - F.col("savings") + F.col("saved")).alias("saved_tokens"), "ends_sha256", F.col("at").alias("preorder"), "end",
    )
