"""Query of mixing to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import mixing
from .common import table


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.totals(mixing.mix(table(spark, sf_dir, "documents")))


QUERIES = {"op5_mixing": op5_mixing}
ORACLES: dict[str, str] = {}
