"""Connected components by contraction: every round, each vertex joins its smallest neighbour and edges move to the parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import meet, released, stored


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b bigint) to v, comp: every vertex of an edge, and the smallest vertex that links reach; a stored table.

    Rounds are few, as all vertices that are not their neighbourhood's smallest vanish in each; nothing is collected but
    whether edges are left. Smallest neighbours are pre-aggregated, so a vertex of very many links is no hot spot. A
    vertex's parents of all rounds are followed once, at the end.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    left = stored(both, "edges", narrow=True)
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        parents = stored(left.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("parent")), "parents", narrow=True)
        rounds.append(parents)
        ends = meet(left, parents.select(F.col("v").alias("a"), F.col("parent").alias("pa")), "a")
        ends = meet(ends, parents.select(F.col("v").alias("b"), F.col("parent").alias("pb")), "b")
        next_ = stored(ends.where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "edges", narrow=True)
        released(left)
        left = next_
    if not rounds:
        return left.select(F.col("a").alias("v"), F.col("b").alias("comp"))
    labels = rounds[0].select("v", F.col("parent").alias("comp"))
    for parents in rounds[1:]:
        labels = meet(labels, parents.select(F.col("v").alias("comp"), "parent"), "comp", "left").select("v", F.coalesce("parent", "comp").alias("comp"))
    labels = stored(labels, "labels", narrow=True)
    released(left, *rounds)
    return labels
