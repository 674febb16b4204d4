"""The queries of the exposure operators by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glint.plans import crawl_queries, estate_queries, policy_queries, scan_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**scan_queries.QUERIES, **estate_queries.QUERIES, **crawl_queries.QUERIES, **policy_queries.QUERIES}
ORACLES: dict[str, str] = {**scan_queries.ORACLES, **estate_queries.ORACLES, **crawl_queries.ORACLES, **policy_queries.ORACLES}
