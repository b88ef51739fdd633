"""Named queries on the given tables, each with the SQL that says the same (where SQL can)."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]

_GROUPS = ("legs", "rates", "daily", "quality", "metrics", "serving", "layout", "modelling")


def all_queries() -> dict[str, tuple[Run, str | None]]:
    found: dict[str, tuple[Run, str | None]] = {}
    for group in _GROUPS:
        found.update(import_module(f"punctuality.registry.{group}").QUERIES)
    return found
