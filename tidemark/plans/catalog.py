"""The registry of all queries and of their SQL, gathered from the plan modules."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import tidemark.plans as plans

Query = Callable[[SparkSession, str], DataFrame]


def _modules() -> list:
    names = sorted(m.name for m in pkgutil.iter_modules(plans.__path__) if m.name != "catalog")
    return [importlib.import_module(f"tidemark.plans.{n}") for n in names]


def queries() -> dict[str, Query]:
    return {name: f for m in _modules() for name, f in getattr(m, "QUERIES", {}).items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in _modules() for name, s in getattr(m, "SQL", {}).items()}
