"""Registration of the runnable queries and their cross-check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidquarry.sources.tables import Tables, oracle_cte

Runner = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Runner] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under *name*, with optional oracle SQL."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))

        run.__doc__ = fn.__doc__
        run.module = fn.__module__.rsplit(".", 1)[-1]
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def ctes(*parts: str | tuple[str, str]) -> str:
    """``WITH`` clause from binding names and (name, body) pairs."""
    rendered = []
    for part in parts:
        name, body = (part, oracle_cte(part)) if isinstance(part, str) else part
        rendered.append(f"{name} AS ({body})")
    return "WITH " + ",\n".join(rendered) + "\n"
