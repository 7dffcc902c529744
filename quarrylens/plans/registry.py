"""Registered queries with their SQL, and helpers that derive the same columns in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place() -> Column:
    """Where a row stands in the files of its table, which is the order in which other engines read it."""
    return F.struct("_metadata.file_path", "_metadata.row_index")


def quoted(x) -> str:
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else "NULL" if x is None else str(x)


def pick(n: Column, values) -> Column:
    """One of ``values`` by a number, which wraps around."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def pick_sql(n: str, values) -> str:
    return f"([{', '.join(quoted(v) for v in values)}])[CAST({n} % {len(values)} AS INT) + 1]"
