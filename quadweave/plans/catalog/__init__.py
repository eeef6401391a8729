"""The registered queries, one per row of the operator inventory, each beside its SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = [
    "sources",
    "patterns",
    "aggregates",
    "views",
    "lifecycle",
    "times",
    "workflow",
    "checks",
    "retention",
    "scalars",
    "streams",
]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        if name in ENTRIES:
            raise ValueError(f"registered twice: {name}")
        ENTRIES[name] = Entry(run, sql)
        return run

    return add


def load() -> dict[str, Entry]:
    for module in MODULES:
        importlib.import_module(f"{__name__}.{module}")
    return ENTRIES
