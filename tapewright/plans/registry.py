"""All registered queries of the library and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audits, books, claims, events, facts, more, prose, stored, summaries, texts

_PARTS = [events, books, summaries, texts, more, claims, stored, facts, audits, prose]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
