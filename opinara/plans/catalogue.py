"""All queries by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from opinara.plans import analytics, basics, estimates, extras, learned, references

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**basics.QUERIES, **analytics.QUERIES, **extras.QUERIES, **references.QUERIES, **learned.QUERIES, **estimates.QUERIES}
ORACLES: dict[str, str] = {**basics.ORACLES, **analytics.ORACLES, **extras.ORACLES, **references.ORACLES, **learned.ORACLES, **estimates.ORACLES}
