"""Every operator as a query over the given tables, with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MODULES = (
    "tables",
    "rows",
    "encoding",
    "codecs",
    "wide",
    "fidelity",
    "distributions",
    "utility",
    "generation",
    "privacy",
    "jobs",
    "facts",
)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def load() -> None:
    for module in MODULES:
        import_module(f"twinframe.catalog.{module}")
