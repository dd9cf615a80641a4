"""Every query of the engine by name, with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "bm25_batch"
_MODULES = ("usage", "search", "routing", "stores", "conversations", "quality", "pages", "catalog", "workspace", "parts", "relational")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict = {}
    for name in _MODULES:
        found |= import_module(f".{name}", __package__).QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict = {}
    for name in _MODULES:
        found |= import_module(f".{name}", __package__).SQL
    return found
