"""All core queries by name, with the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules that define QUERIES (name -> callable) and SQL (name -> text).
MODULES: tuple[str, ...] = ("usage", "shelf", "texts", "matching", "documents", "streams", "edits", "rules")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        out |= import_module(f"lexmill.plans.{name}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out |= import_module(f"lexmill.plans.{name}").SQL
    return out
