"""Registered queries over the test tables and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.operators import dedup
from tessella.plans import action_queries, dedup_queries, file_queries, ledger_queries, rule_queries, scan_queries, stream_queries
from tessella.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]
_MODULES = (scan_queries, dedup_queries, ledger_queries, rule_queries, action_queries, file_queries, stream_queries)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Duplicate groups with their keepers."""
    return dedup.groups(dedup_queries.members0(spark, folder))
