"""Every query of the library by name, with its oracle where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import feature_queries, label_queries, more_queries, outcome_queries, store_queries  # noqa: F401  (they fill the catalogue)
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions, faults, delivery and duration by station: one pass of sessions and labels."""
    return QUERIES["r14_fleet"](spark, sf_dir)
