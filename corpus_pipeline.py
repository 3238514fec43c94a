"""From raw documents to token files: classify, deduplicate, decontaminate, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.

Defined cases, which each stage takes over from its operator: a null text is an empty one, and the classifier scores it like
any other; rows without words have no near copies and no benchmark window and stay; rows with a null id stay in every stage,
ties between copies are decided by the smallest id; rows that share an id are one document to the join, which goes if any of
them is a copy of another's, and of which one row stays; a null source
is a source of its own; without labels nothing is rejected, without a benchmark nothing is contaminated; an empty table
gives an empty result; further columns, whatever their names, are carried along.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontamination, mixing, ngram_join, quality, tokens
from quillon.llm.common import collect_garbage, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def apart(stage: Stage) -> Stage:
    """stage, begun with executors that hold no garbage of the stages before it: they share one limit of memory."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        collect_garbage(spark)
        return stage(spark, docs, sf_dir)

    return run


@apart
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject: score of 0.5 and more, which is what all have without labels."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


@apart
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id. Rows without words or without an id all stay."""
    return ngram_join.deduplicate(docs)


@apart
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs; rows without words stay."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


@apart
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those of sources without any words have no target and aren't taken."""
    return mixing.draw(docs)


@apart
def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows, in ascending doc_id order, and what stands in them for each; an empty text is the end id alone."""
    return tokens.round_trip(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
    ("token-ID output", encode_tokens),
]
#: The classifier, the permutations of the mix and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
