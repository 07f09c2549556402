"""Named queries over the fixture relations, each with its independent SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.fixtures import ORACLE_HEAD, Fixture

QUERIES: dict[str, tuple[Callable[[Fixture], DataFrame], str | None]] = {}


def query(name: str, sql: str | None):
    """Register a query; ``sql`` follows the projection, either as more expressions or as the final SELECT."""

    def add(run: Callable[[Fixture], DataFrame]) -> Callable[[Fixture], DataFrame]:
        text = None
        if sql is not None:
            tail = sql.strip()
            text = ORACLE_HEAD + ("\n" if tail.upper().startswith("SELECT") else ",\n") + tail
        QUERIES[name] = (run, text)
        return run

    return add


def as_callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(run: Callable[[Fixture], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def call(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = run(Fixture(spark, sf_dir))
            return out.drop("model")

        return call

    return {name: bound(run) for name, (run, _) in QUERIES.items()}


def as_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql is not None}
