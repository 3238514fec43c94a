"""Query of toxicity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import toxicity
from .common import table


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op12_toxicity": op12_toxicity}
ORACLES: dict[str, str] = {}
