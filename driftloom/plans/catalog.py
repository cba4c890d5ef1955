"""Every registered query with its SQL twin.

The modules beside this one hold ``QUERIES``: name -> (function of session and folder,
SQL that DuckDB runs on the same tables, or None where SQL can't express it).
"""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftloom import plans


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    found: dict = {}
    for module in sorted(m.name for m in pkgutil.iter_modules(plans.__path__) if m.name.startswith("q_")):
        found |= importlib.import_module(f"driftloom.plans.{module}").QUERIES
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
