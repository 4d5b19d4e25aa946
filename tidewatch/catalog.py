"""Every registered query of the analytics part, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.plans import decisions, evidence_queries, metric_queries, privacy_queries, quality_queries, reference_queries, registry_queries, stream_queries, study_queries, url_queries

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (decisions, url_queries, privacy_queries, quality_queries, evidence_queries, metric_queries, registry_queries, stream_queries, reference_queries, study_queries):
    QUERIES |= _module.register.queries
    ORACLE_SQL |= _module.register.sql


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.page_decisions(spark, sf_dir)
