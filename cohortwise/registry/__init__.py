"""Runnable queries over the sample tables, each with the same question in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from cohortwise.sources.projection import with_tables
from cohortwise.sources.tables import Tables


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    sql: str | None = None

    def oracle(self) -> str | None:
        return with_tables(self.sql, "duckdb") if self.sql else None


def all_queries() -> dict[str, Query]:
    from cohortwise.registry import catalog, clinical, expression, frequency, preparation, spanlog, stats, timeline

    found: dict[str, Query] = {}
    for module in (preparation, frequency, clinical, timeline, expression, catalog, spanlog, stats):
        found.update(module.QUERIES)
    return found
