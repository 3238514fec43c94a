"""Query of document fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints
from .common import table


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_neighbours(table(spark, sf_dir, "documents"))


QUERIES = {"op9_fingerprints": op9_fingerprints}
ORACLES: dict[str, str] = {}
