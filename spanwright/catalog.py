"""All queries of the library with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanwright.plans import candidates, comparison, documents, edits, evaluation, evasion, experiments, linking, measurement, personal, reporting, snapshots

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = measurement.QUERIES  # each module adds its own
ORACLE_SQL: dict[str, str] = measurement.ORACLE_SQL
