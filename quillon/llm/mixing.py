"""Mixing sources to target weights, with a multivariate-hypergeometric splitting tree over output shards.

Each source's documents are dealt by hash into blocks. A source takes so many whole passes over its blocks, then blocks
in permuted order as far as its target reaches, and of the block at that edge those documents, the longest first, that bring it nearest. The
exact numbers of block draws are the source's quota; a binary tree over the output shards splits the quotas of all
sources at once, each split a draw without replacement (a multivariate hypergeometric), so that every shard has its exact
size and a random composition. Shards take disjoint runs of each source's permuted draws and shuffle them locally.

Only built-in functions are used. Defined cases: a null text has size 0; a null source is a source of its own, the last;
documents of size 0 are in the mix but add no words; rows that repeat an id count each; an empty table gives an empty
mix; extra columns are not looked at. Sources are taken to be few (their plan is one row each, whatever they hold).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_DOCS = 512
SHARDS = 8
SEED = 17
#: How many of the longest documents of an edge block may be passed over for a better fit.
SKIPPED = 24
#: The documents (doc_id, key) whose sizes come nearest to edge: the longest that fit first, or those before one that goes beyond
#: and that one; the best of the choices that leave out the longest one by one.
FITTING = f"""transform(array(array_sort(collect_list(struct(-size as o, xxhash64(key, 1) as h, doc_id, key, size)))), all ->
    array_min(transform(sequence(0, least(size(all) - 1, {SKIPPED})), i ->
        aggregate(slice(all, i + 1, size(all)),
            named_struct('left', max(edge), 'out', cast(array() as array<struct<doc_id:bigint,key:bigint>>), 'best', named_struct('far', cast('inf' as double), 'out', cast(array() as array<struct<doc_id:bigint,key:bigint>>))),
            (s, d) -> if(d.size <= s.left, named_struct('left', s.left - d.size, 'out', concat(s.out, array(struct(d.doc_id, d.key))), 'best', s.best),
                if(d.size - s.left < s.best.far, named_struct('left', s.left, 'out', s.out, 'best', named_struct('far', d.size - s.left, 'out', concat(s.out, array(struct(d.doc_id, d.key))))), s)),
            s -> if(s.best.far < s.left, s.best, named_struct('far', s.left, 'out', s.out))))).out)[0]"""


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = MOST) -> DataFrame:
    """sizes (source, source_size, n_docs) with rank, weight and target.

    Sources are ranked by code point, null last, and weigh weights in turn. They share ``share`` of all sizes by weight,
    each at most ``most`` times its own: with the sources in order of the level at which they fill up, a source is full
    if the level that the others would reach is above its own, and the rest meet at one level.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    ranked = ranked.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * most).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    full = (F.sum("source_size").over(everything) * share).cast("double")
    before = F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap")
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = ranked.withColumn("level", (full - before) / left)
    capped = F.col("cap") / F.col("weight") < F.col("level")
    shared = F.max(F.when(~capped, F.col("level"))).over(everything)
    target = F.when(capped, F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * shared))
    return level.withColumn("target", target).select("source", "source_size", "n_docs", "rank", "weight", "target")


def split_tree(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """rank, bounds: for each source of quotas (rank from 0, q), where its draws end in each shard, from first to last."""
    node = quotas.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "q"))), lambda x: x["q"]).alias("quotas"))
    node = node.select(F.lit(0).alias("first"), F.lit(shards).alias("n"), "quotas")
    # drawn one by one: the next draw goes left with the chance of the places left there
    left = f"""aggregate(sequence(0, size(quotas) - 1),
        named_struct('l', places, 'n', total, 'out', cast(array() as array<bigint>)),
        (s, i) -> transform(array(aggregate(if(quotas[i] > 0, sequence(1L, quotas[i]), cast(array() as array<bigint>)),
            named_struct('l', s.l, 'n', s.n, 'k', 0L),
            (t, j) -> if(pmod(xxhash64({seed}, first, n, i, j), 1073741824L) / 1073741824D * t.n < t.l,
                named_struct('l', t.l - 1L, 'n', t.n - 1L, 'k', t.k + 1L), named_struct('l', t.l, 'n', t.n - 1L, 'k', t.k)))),
            t -> named_struct('l', t.l, 'n', t.n, 'out', concat(s.out, array(t.k))))[0],
        s -> s.out)"""
    while_splitting = max(1, shards).bit_length() - (shards & (shards - 1) == 0)
    for _ in range(while_splitting):
        node = node.withColumn("total", F.expr("aggregate(quotas, 0L, (a, x) -> a + x)"))
        node = node.withColumn("half", F.expr("n div 2").cast("int")).withColumn("places", F.expr("cast(total * half div n as bigint)"))
        node = node.withColumn("left", F.expr(f"if(half > 0 and size(quotas) > 0, {left}, quotas)"))
        children = F.expr("""if(half > 0 and size(quotas) > 0,
            array(named_struct('first', first, 'n', half, 'quotas', left),
                  named_struct('first', first + half, 'n', n - half, 'quotas', zip_with(quotas, left, (q, l) -> q - l))),
            array(named_struct('first', first, 'n', n, 'quotas', quotas)))""")
        node = node.select(F.inline(children))
    leaf = node.select("first", F.posexplode("quotas").alias("rank", "q"))
    ends = leaf.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("first", "q"))).alias("each"))
    return ends.select("rank", F.expr("transform(each, (x, i) -> aggregate(slice(each, 1, i + 1), 0L, (a, y) -> a + y.q))").alias("bounds"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = MOST, shards: int = SHARDS, block_docs: int = BLOCK_DOCS, seed: int = SEED) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, key (of the row) and shards, the shard of each copy taken."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), n_words(F.col("text").cast("string")).alias("size"))
    rows = stored(rows.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "source", "size")), "mix-sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("long")
    plan = (
        targets(sizes, weights, share, most)
        .withColumn("passes", passes)
        .withColumn("rest", F.when(F.col("passes") < most, F.col("target") - F.col("passes") * F.col("source_size")).otherwise(0.0))
        # blocks grow with the square root of a source, and so does their number: neither a block nor a list of blocks is large
        .withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / F.greatest(F.lit(float(block_docs)), F.sqrt("n_docs")))).cast("long"))
    )
    plan = stored(plan.withColumnRenamed("source", "__source"), "mix-plan")
    placed = rows.join(plan, rows["source"].eqNullSafe(plan["__source"])).withColumn("block", F.pmod("key", F.col("n_blocks")))
    # a block's place in the source's permutation, and what the pass that stays incomplete takes of it
    order = Window.partitionBy("rank").orderBy(F.xxhash64(F.lit(seed), "rank", "block"), "block")
    upto = F.sum("block_size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    blocks = (
        placed.groupBy("rank", "block").agg(F.sum("size").alias("block_size"))
        .withColumn("place", F.row_number().over(order).cast("long") - 1).withColumn("upto", upto)
        .join(plan.select("rank", "passes", "rest", "n_blocks"), "rank")
        .withColumn("whole", (F.col("upto") <= F.col("rest")) & (F.col("rest") > 0))
        .withColumn("edge", F.when(~F.col("whole") & (F.col("upto") - F.col("block_size") < F.col("rest")), F.col("rest") - F.col("upto") + F.col("block_size")))
    )
    blocks = stored(blocks.select("rank", "block", "place", "whole", "edge"), "mix-blocks")
    drawn = blocks.groupBy("rank").agg(F.sum((F.col("whole") | F.col("edge").isNotNull()).cast("long")).alias("partial"))
    quotas = plan.join(drawn, "rank").select("rank", (F.col("passes") * F.col("n_blocks") + F.col("partial")).alias("q"))
    bounds = split_tree(quotas, shards, seed)
    located = placed.join(blocks, ["rank", "block"])
    # of an edge block (about block_docs rows) the documents that bring the source nearest to its target
    fits = located.where("edge is not null").groupBy("rank", "block", "doc_id", "key").agg(F.sum("size").alias("size"), F.max("edge").alias("edge"))
    edge = fits.where("size > 0").groupBy("rank", "block").agg(F.expr(FITTING).alias("out")).select(F.inline("out"))
    edge = edge.select(F.col("doc_id").alias("__doc"), F.col("key").alias("__key"))
    copies = F.col("passes") + (F.col("whole") | (F.col("edge").isNotNull() & F.col("__key").isNotNull())).cast("long")
    bound = located.join(bounds, "rank").join(edge, (F.col("key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__doc")), "left")
    shard = F.expr("transform(if(copies > 0, sequence(0L, copies - 1L), cast(array() as array<bigint>)), c -> size(filter(bounds, b -> b <= c * n_blocks + place)))")
    return bound.withColumn("copies", copies).withColumn("shards", shard).select("doc_id", "source", "size", "source_size", "target", "key", "shards")


def totals(mixed: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken, the words that the mix takes of the document."""
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"))


def draw(docs: DataFrame, shards: int | None = None, **options: int) -> DataFrame:
    """The rows of docs, with all their columns, each as often as the mix takes it: a shard's rows, of the composition that
    the tree gave it, stand together and are shuffled there. Shards are as many as the shuffle partitions unless given."""
    shards = shards or partitions(docs.sparkSession)
    copies = mix(docs, shards=shards, **options).select("doc_id", "source", "size", "key", "shards").dropDuplicates(["key", "doc_id"])  # rows that agree in id, source and size are taken alike
    # the row as one column, so that its names meet no others
    rows = docs.select(
        F.col("doc_id").cast("long").alias("r_id"), F.col("source").cast("string").alias("r_source"), n_words(F.col("text").cast("string")).alias("r_size"), F.struct(*docs.columns).alias("row")
    )
    same = F.col("r_id").eqNullSafe(F.col("doc_id")) & F.col("r_source").eqNullSafe(F.col("source")) & (F.col("r_size") == F.col("size"))
    repeated = rows.join(copies.where(F.size("shards") > 0), same).select("row", "key", F.posexplode("shards").alias("copy", "shard"))
    # a shard's rows by hash: its local shuffle
    dealt = repeated.repartition(shards, "shard").withColumn("place", F.xxhash64("key", "copy", "shard"))
    return dealt.sortWithinPartitions("shard", "place").select("row.*")
