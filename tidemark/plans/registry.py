"""Registry of named queries with their SQL twins and the inventory ids they cover."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    covers: tuple[str, ...]
    sql: str | None


CATALOG: dict[str, Entry] = {}


def query(covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name; ``covers`` lists inventory ids."""

    def add(fn: Query) -> Query:
        if fn.__name__ in CATALOG:
            raise ValueError(f"query {fn.__name__} registered twice")
        CATALOG[fn.__name__] = Entry(fn, tuple(covers.split()), sql)
        return fn

    return add
