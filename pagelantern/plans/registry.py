"""Named queries over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagelantern.plans import history_queries, joined_queries, page_queries, report_queries, site_queries, stored_queries, stream_queries

QUERIES: dict = {**page_queries.QUERIES, **site_queries.QUERIES, **history_queries.QUERIES, **joined_queries.QUERIES, **report_queries.QUERIES, **stream_queries.QUERIES, **stored_queries.QUERIES}
SQL: dict[str, str] = {**page_queries.SQL, **site_queries.SQL, **history_queries.SQL, **joined_queries.SQL, **report_queries.SQL, **stream_queries.SQL, **stored_queries.SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of all page rules."""
    return page_queries.findings(spark, sf_dir)
