"""Queries over the reference tables, by name, and the SQL that must give the same rows."""

from __future__ import annotations

import importlib
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir), with its SQL twin where there is one."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def loaded():
    """This module, after all modules that register queries have been imported."""
    for name in ("queries", "report_queries", "upkeep_queries", "episode_queries", "version_queries", "recall_queries", "run_queries", "text_queries", "lifecycle_queries", "postings_queries", "source_queries", "tree_queries", "turn_queries", "cache_queries", "corpus_queries", "reader_queries"):
        importlib.import_module(f"recallspark.plans.{name}")
    return sys.modules[__name__]
