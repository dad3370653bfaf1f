"""Confidence of matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confident(matches: DataFrame, margin: float = 0.10, ncc: float = 0.12) -> DataFrame:
    """Matches with enough margin and ncc; a null in either isn't confident."""
    return matches.withColumn("confident", F.coalesce((F.col("margin") >= margin) & (F.col("ncc") >= ncc), F.lit(False)))
