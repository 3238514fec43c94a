"""Query of token-id output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import tokens
from .common import table


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(table(spark, sf_dir, "documents"))


QUERIES = {"op6_token_ids": op6_token_ids}
ORACLES: dict[str, str] = {}
