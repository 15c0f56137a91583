"""All registered queries of the engine, by operator id."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from talkweave.session import ship

Query = Callable[[SparkSession, str], DataFrame]


class Entry(NamedTuple):
    run: Query
    sql: str | None


_ENTRIES: dict[str, Entry] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query (spark, sf_dir) -> DataFrame under a name, with the SQL of the same rows."""

    def wrap(f: Query) -> Query:
        if name in _ENTRIES:
            raise ValueError(f"{name} is registered twice")
        _ENTRIES[name] = Entry(f, sql)
        return f

    return wrap


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries() -> dict[str, Entry]:
    """All entries; the modules that register them are imported here, since they import this one."""
    from talkweave.plans import files, generated, identity, intervallic, recordings, relational, sequences, shared, speech, textual, timed  # noqa: F401

    return _ENTRIES


def queries() -> dict[str, Query]:
    return {k: e.run for k, e in entries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: e.sql for k, e in entries().items() if e.sql}


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries()["L5_code_mixing"].run(spark, sf_dir)

