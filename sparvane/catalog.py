"""Registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import postures, rasters, relational, retrieval, statistics, storage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = relational.QUERIES | statistics.QUERIES | retrieval.QUERIES | rasters.QUERIES | postures.QUERIES | storage.QUERIES
SQL: dict[str, str] = relational.SQL | statistics.SQL | retrieval.SQL | rasters.SQL | postures.SQL | storage.SQL
