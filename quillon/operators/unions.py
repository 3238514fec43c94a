"""Unions of mentions into subjects under a conflict guard, as if links were taken one after another.

A link is refused if the stable keys of both sides are known and have none in common; a union holds the keys of all its
members, so what is refused depends on the order of links. The order is replayed in parallel: where no refusal is
possible, a whole component is united at once; elsewhere every subject takes, in each round, the run of its next links
whose other ends have nothing earlier to do, up to the first one that brings it new keys. Nothing is cut: blocks are not
paired up but linked to their first member, and names within names are found by their substrings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import checkpointed

#: Shortest name that may stand for a longer one that holds it.
LEAST_SHORT = 4
#: Links of a component that one task replays.
IN_TASK = 10_000


def token_links(entities: DataFrame) -> DataFrame:
    """entities (doc_id, node, pos, tokens) as links from the first of each token to the others: left, right, ord, which orders
    them by the later one's place. A token of very many is one row before it is joined."""
    each = entities.select("doc_id", "node", "pos", F.explode(F.array_distinct("tokens")).alias("token")).where("token is not null")
    owner = each.groupBy("doc_id", "token").agg(F.min(F.struct("pos", "node")).alias("owner"))
    linked = each.join(owner, ["doc_id", "token"]).where(F.col("node") != F.col("owner.node"))
    return linked.select("doc_id", F.col("owner.node").alias("left"), F.col("node").alias("right"), F.struct(F.lit(0).alias("phase"), F.col("pos").alias("at"), F.col("token").alias("by"), F.col("node").alias("id")).alias("ord"))


def contained_links(entities: DataFrame) -> DataFrame:
    """Links between a name and each longer one of its document and family that holds it, unless their roles differ or
    their canonical keys do: entities (doc_id, node, pos, family, text, canonical, role). Looked up by the substrings of the longer ones, of lengths that
    occur: no pair is made that doesn't hold."""
    own = entities.where(F.length("text") >= LEAST_SHORT)
    lengths = own.groupBy("doc_id", "family").agg(F.collect_set(F.length("text")).alias("sizes"))
    cuts = "flatten(transform(filter(sizes, n -> n < length(text)), n -> transform(sequence(1, length(text) - n + 1), i -> substr(text, i, n))))"
    longer = own.join(lengths, ["doc_id", "family"]).select("doc_id", "family", *[F.col(c).alias(f"l_{c}") for c in ("node", "pos", "canonical", "role")], F.explode(F.array_distinct(F.expr(cuts))).alias("text"))
    both = own.join(longer, ["doc_id", "family", "text"])
    differ = lambda c: F.coalesce(F.col(c) != F.col(f"l_{c}"), F.lit(False))
    found = both.where(~differ("canonical") & ~differ("role"))
    first = F.col("l_pos") <= F.col("pos")
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    at = F.struct(F.lit(1).alias("phase"), F.greatest("pos", "l_pos").alias("at"), pick("l_node", "node").alias("by"), pick("node", "l_node").alias("id"))
    return found.select(pick("l_node", "node").alias("left"), pick("node", "l_node").alias("right"), at.alias("ord"))


def share_identity(left: Column, right: Column) -> Column:
    """Whether two mentions (structs of family, text, canonical, role) are one by themselves: canonical keys decide if both
    have one; else families must agree, and texts, or one text hold the other of LEAST_SHORT and more with no different role."""
    a, b = left["text"], right["text"]
    short = F.least(F.length(a), F.length(b))
    within = (short >= LEAST_SHORT) & (F.contains(a, b) | F.contains(b, a)) & ~F.coalesce(left["role"] != right["role"], F.lit(False))
    known = left["canonical"].isNotNull() & right["canonical"].isNotNull()
    return F.when(known, left["canonical"] == right["canonical"]).otherwise((left["family"] == right["family"]) & (a != "") & (b != "") & ((a == b) | within))


def connected(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that links (left, right) reach. Each round every node joins its smallest neighbour, and links
    move to what their ends joined, until none is left."""
    ends = lambda e: e.select("left", "right").unionByName(e.select(F.col("right").alias("left"), F.col("left").alias("right"))).where("left <> right")
    now, labels = checkpointed(ends(edges).distinct()), None
    while not now.isEmpty():
        joined = now.groupBy("left").agg(F.min("right").alias("r")).select(F.col("left").alias("node"), F.least("left", "r").alias("root"))
        joined = checkpointed(joined)
        to = lambda side: joined.select(F.col("node").alias(side), F.col("root").alias(f"{side}_to"))  # noqa: B023, E731
        moved = now.join(to("left"), "left").join(to("right"), "right").select(F.col("left_to").alias("left"), F.col("right_to").alias("right"))
        if labels is None:
            labels = joined
        else:
            known = joined.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = checkpointed(labels.join(known, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        now = checkpointed(moved.where("left <> right").distinct())
    return labels if labels is not None else now.select(F.col("left").alias("node"), F.col("right").alias("root"))


def _round(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """What can be decided now: hub, node, accepted, at and the keys of a hub afterwards."""
    incident = edges.select(F.col("left").alias("hub"), F.col("right").alias("node"), "ord").unionByName(edges.select(F.col("right").alias("hub"), F.col("left").alias("node"), "ord"))
    first = incident.groupBy("hub").agg(F.min("ord").alias("first"))
    seen = incident.join(first.select(F.col("hub").alias("node"), F.col("first").alias("node_first")), "node").join(first, "hub")
    # links of a hub, in order, as long as each is the other end's first
    run = Window.partitionBy("hub").orderBy("ord", "node")
    ready = seen.withColumn("late", F.sum((F.col("ord") != F.col("node_first")).cast("int")).over(run.rowsBetween(Window.unboundedPreceding, 0))).where("late = 0")
    ready = checkpointed(ready.select("hub", "node", "ord", (F.col("ord") == F.col("first")).alias("mutual")))
    sizes = ready.groupBy("hub").agg(F.count("*").alias("n"))
    # of two ends that are each other's first, the one with the longer run is the hub
    paired = ready.where("mutual").select("hub", "node").join(sizes.select(F.col("hub"), F.col("n")), "hub").join(sizes.select(F.col("hub").alias("node"), F.col("n").alias("m")), "node")
    loses = paired.where((F.col("m") > F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("node") < F.col("hub")))).select("hub")
    taken = ready.join(loses, "hub", "left_anti")
    own = keys.select(F.col("node").alias("hub"), F.col("keys").alias("hub_keys"))
    known = taken.join(own, "hub").join(keys, "node")
    fits = (F.size("hub_keys") == 0) | (F.size("keys") == 0) | F.arrays_overlap("hub_keys", "keys")
    brings = fits & (F.size(F.array_except("keys", "hub_keys")) > 0)
    before = F.coalesce(F.sum(brings.cast("int")).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return known.withColumn("accepted", fits).withColumn("before", before).where("before = 0").select("hub", "node", "ord", "accepted", "keys")


def _replay(links: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
    """The unions of one component, link after link."""
    order = sorted(zip(links["ord"].map(lambda o: (o["phase"], o["at"], o["by"], o["id"])), links["left"], links["right"]))
    roots = _united(zip(members["node"], members["keys"]), (x[1:] for x in order))
    return pd.DataFrame({"node": list(roots), "root": list(roots.values())})


def _united(members: Iterable[tuple], links: Iterable[tuple]) -> dict:
    """The smallest node of the union of each of members (node, keys), after links (left, right) in order."""
    held = {n: set(k) for n, k in members}
    above = {n: n for n in held}

    def top(n: str) -> str:
        while above[n] != n:
            above[n] = above[above[n]]
            n = above[n]
        return n

    for left, right in links:
        a, b = sorted((top(left), top(right)))
        if a != b and not (held[a] and held[b] and held[a].isdisjoint(held[b])):
            above[b] = a
            held[a] |= held[b]
    return {n: top(n) for n in above}


def in_groups(rows: DataFrame, by: str, order: tuple[str, ...], columns: tuple[str, ...], each: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """each of the rows (by and columns) of every group, in order: groups stream through tasks one after another, sorted."""
    out = StructType.fromDDL(schema)
    fields = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], f.type) for i, f in enumerate(fields)], schema=fields)

        group, found = [], []
        for part in batches:
            for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if group and group[0][0] != row[0]:
                    found += each(group)
                    group = []
                    if len(found) >= 10_000:
                        yield batch(found)
                        found = []
                group.append(row)
        if group:
            found += each(group)
        if found:
            yield batch(found)

    return rows.repartition(by).sortWithinPartitions(by, *order).select(by, *columns).mapInArrow(run, out)


def _guarded_within(entities: DataFrame, links: DataFrame, within: str) -> DataFrame:
    """guarded, where no link leaves its group: groups of up to IN_TASK links are replayed as they stream by, others in rounds."""
    nodes = checkpointed(entities.select(within, "node", F.coalesce("keys", F.array().cast("array<string>")).alias("keys")))
    edges = checkpointed(links.where("left <> right").select(within, "left", "right", "ord"))
    large = checkpointed(edges.groupBy(within).agg(F.count("*").alias("n")).where(F.col("n") > IN_TASK).select(within))
    none = lambda column, df: F.lit(None).cast(dict(df.dtypes)[column]).alias(column)
    rows = nodes.select(within, F.lit(0).alias("kind"), F.col("node").alias("left"), none("right", edges), none("ord", edges), "keys")
    rows, rest = rows.unionByName(edges.select(within, F.lit(1).alias("kind"), "left", "right", "ord", none("keys", nodes))), None
    if not large.isEmpty():
        # written down: a join that adaptive execution changes would not keep the groups that a later repartition relies on
        rows, rest = checkpointed(rows.join(large, within, "left_anti")), guarded(nodes.join(large, within, "left_semi"), edges.join(large, within, "left_semi"))

    def each(group: list[tuple]) -> list[tuple]:
        own = {x[2]: x[4] for x in group if x[1] == 0}
        roots = _united(own.items(), ((x[2], x[3]) for x in group if x[1] == 1))
        return [(n, keys, roots[n]) for n, keys in own.items()]

    replayed = in_groups(rows, within, ("kind", "ord", "left", "right"), ("kind", "left", "right", "keys"), each, "node string, keys array<string>, subject string")
    return replayed if rest is None else replayed.unionByName(rest)


def guarded(entities: DataFrame, links: DataFrame, within: str | None = None) -> DataFrame:
    """entities (node, keys) with subject, the smallest node of their union, after links (left, right, ord) in order of ord.
    ``within`` names a column of both whose groups no link leaves."""
    if within is not None:
        return _guarded_within(entities, links, within)
    nodes = checkpointed(entities.select("node", F.coalesce("keys", F.array().cast("array<string>")).alias("keys")))
    # a link that was refused may come again and be taken, once its ends have more keys
    edges = checkpointed(links.where("left <> right").select("left", "right", "ord").distinct())
    free = connected(edges)
    held = nodes.join(free, "node").where(F.size("keys") > 0)
    n_keyed = held.groupBy("root").agg(F.count("*").alias("n"))
    most = held.select("root", F.explode(F.array_distinct("keys")).alias("key")).groupBy("root", "key").agg(F.count("*").alias("c")).groupBy("root").agg(F.max("c").alias("c"))
    contested = checkpointed(n_keyed.join(most, "root").where("c < n").select("root"))
    sure = free.join(contested, "root", "left_anti")
    open_nodes = free.join(contested, "root", "left_semi").select("node")
    edges = checkpointed(edges.join(open_nodes.select(F.col("node").alias("left")), "left", "left_semi"))
    # components of few links are replayed one to a task, whose memory that bounds; larger ones in rounds
    rooted = edges.join(free.select(F.col("node").alias("left"), "root"), "left")
    small = checkpointed(rooted.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") <= IN_TASK).select("root"))
    few = checkpointed(rooted.join(small, "root", "left_semi")).groupBy("root")
    members = nodes.join(free, "node").join(small, "root", "left_semi").select("node", "keys", F.col("root").alias("of")).groupBy("of")
    replayed = few.cogroup(members).applyInPandas(_replay, "node string, root string")
    edges = checkpointed(rooted.join(small, "root", "left_anti").select("left", "right", "ord"))
    open_nodes = checkpointed(free.join(contested, "root", "left_semi").join(small, "root", "left_anti").select("node"))
    keys, merged = checkpointed(nodes.join(open_nodes, "node")), []
    while not edges.isEmpty():
        done = checkpointed(_round(edges, keys))
        joins = done.where("accepted").select("node", F.col("hub").alias("to"))
        merged.append(checkpointed(joins))
        grown = done.where("accepted").groupBy(F.col("hub").alias("node")).agg(F.array_distinct(F.flatten(F.collect_set("keys"))).alias("new"))
        keys = keys.join(joins, "node", "left_anti").join(grown, "node", "left")
        keys = checkpointed(keys.select("node", F.array_union("keys", F.coalesce("new", F.array().cast("array<string>"))).alias("keys")))
        left = edges.join(done.select("ord"), "ord", "left_anti")
        for side in ("left", "right"):
            left = left.join(merged[-1].select(F.col("node").alias(side), "to"), side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
        # of several links between two subjects each is taken when it is due, so all stay
        edges = checkpointed(left.where("left <> right").select("left", "right", "ord"))
    labels = open_nodes.select("node", F.col("node").alias("at"))
    for joins in merged:
        labels = checkpointed(labels.join(joins.select(F.col("node").alias("at"), "to"), "at", "left").select("node", F.coalesce("to", "at").alias("at")))
    least = labels.groupBy("at").agg(F.min("node").alias("root"))
    every = sure.unionByName(replayed).unionByName(labels.join(least, "at").select("node", "root"))
    return nodes.join(every, "node", "left").select("node", "keys", F.coalesce("root", "node").alias("subject"))
