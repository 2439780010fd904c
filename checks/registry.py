"""Register a query together with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks import oracles
from checks.standins import Standins
from opsloom.session import prepare_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *, relation: str | None = None, sql: str | None = None):
    """Decorate ``fn(tables) -> DataFrame``; the oracle is a named relation or SQL over named relations."""

    def register(fn: Callable[[Standins], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Standins(prepare_tables(spark), sf_dir))

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if relation is not None:
            ORACLES[name] = oracles.oracle(relation)
        elif sql is not None:
            ORACLES[name] = oracles.with_sources(sql)
        return fn

    return register
