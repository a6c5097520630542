"""Registering queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from skribo.operators import ranking
from skribo.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


#: Search indexes of this process: what they are of, and the index.
_INDEXES: dict[tuple, ranking.Index] = {}


def index_of(name: str, tables: list[DataFrame], make: Callable[[], tuple[DataFrame, str, dict[str, Column]]]) -> ranking.Index:
    """The index that make's documents, key and fields give, built where there is none yet: one of the same name over the same files of these tables, by path, size and time, is used again."""
    spark = tables[0].sparkSession
    stamps = [r for t in tables for r in t.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct().collect()]
    of = (spark.sparkContext.applicationId, name, tuple(sorted(map(str, stamps))))
    if of not in _INDEXES:
        _INDEXES[of] = ranking.build(*make(), files.scratch(spark))
    return _INDEXES[of]


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add
