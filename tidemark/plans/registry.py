"""All queries of the package, and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import layers, notices, served, zones

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in (notices, layers, zones, served):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
