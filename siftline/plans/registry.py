"""Queries by name, and their SQL texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alarms, audits, content, detection, events, reports, runs, summaries, transfer

_ALL = detection.QUERIES | alarms.QUERIES | content.QUERIES | runs.QUERIES | events.QUERIES | reports.QUERIES | transfer.QUERIES | audits.QUERIES | summaries.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
