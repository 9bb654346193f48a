"""All registered queries of the engine's own operators, with their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "w06_runs"

#: Modules of ``tidemark.plans``; each has QUERIES: name -> (function, SQL or None).
FAMILIES: list[str] = ["timeline", "text", "relational", "sampling", "synthesis", "windows", "lookups", "sources"]


def _all() -> dict[str, tuple[Query, str | None]]:
    found: dict[str, tuple[Query, str | None]] = {}
    for family in FAMILIES:
        own = importlib.import_module(f"tidemark.plans.{family}").QUERIES
        assert not own.keys() & found.keys(), "a query name is registered twice"
        found |= own
    return found


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _all().items() if sql}
