"""Named queries: one Spark plan per operator, each with its DuckDB oracle.

``QUERIES[name](spark, sf_dir) -> DataFrame`` builds the plan lazily from the
driver tables. ``ORACLE[name]`` is the same answer in DuckDB SQL (absent for
model and stateful operators, which get row-count checks and unit tests).
Column names are aliased identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from suitewise.plans import (  # noqa: F401
        q_history, q_selection, q_changes, q_code, q_model, q_functions, q_tables,
        q_sequences, q_streams)
