"""Where queries and their oracle SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Adapters and source tables by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return adapters.frame(self.spark, self.sf_dir, name)


def given(*names: str, **more: str) -> str:
    """WITH clause over adapters, then further named SELECTs (materialised once)."""
    parts = [f"{n} AS MATERIALIZED ({adapters.oracle(n)})" for n in names] + [f"{n} AS MATERIALIZED ({sql})" for n, sql in more.items()]
    return "WITH " + ",\n".join(parts) + "\n"


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of Tables as the query of its name."""

    def keep(f):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[key] = sql
        return f

    return keep
