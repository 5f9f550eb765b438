"""Queries of the analytics engine by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import analytics, browsing, recording, reviewing

#: Importing a module of queries registers them.
MODULES = (analytics, browsing, recording, reviewing)
QUERIES = dict(analytics.QUERIES)
ORACLE_SQL = dict(analytics.ORACLE_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed work units, studies and modality split for each profile and day."""
    return analytics.daily_stats(spark, sf_dir)
