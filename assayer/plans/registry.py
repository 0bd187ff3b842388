"""Named queries with their check in SQL."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Build
    sql: str | None = None


class Registry(dict[str, Query]):
    """name -> Query."""

    def add(self, name: str, build: Build, sql: str | None = None) -> None:
        if name in self:
            raise KeyError(f"query registered twice: {name}")
        self[name] = Query(build, sql)
