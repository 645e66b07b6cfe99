"""Register of catalogue queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventrate.functions.numeric import round_k


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOGUE: dict[str, Query] = {}


def query(sql: str | None = None):
    """Register a function ``(spark, folder) -> DataFrame`` under its own name."""

    def keep(run):
        CATALOGUE[run.__name__] = Query(run, sql)
        return run

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def flag(condition: Column) -> Column:
    return condition.cast("int")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: round_k(F.col(c), digits) for c in columns})


def sql_round(expression: str, digits: int) -> str:
    """The rounding rule of ``round_k`` in SQL."""
    scale = f"{10 ** digits}::DOUBLE"
    return f"(sign({expression})::DOUBLE * floor(abs({expression}) * {scale} + 0.5::DOUBLE) / {scale})"


def sql_rate(events: str, total: str, digits: int = 3) -> str:
    """The rate of ``rate_units`` in SQL, as a double."""
    k = 10**digits
    return f"((({2 * k} * {events} + {total}) // (2 * {total}))::DOUBLE / {k}::DOUBLE)"


def sql_unpivot(source: str, columns: list[str], carried: str) -> str:
    """Long form (var_name, col_num, level, carried columns) of a row source."""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS var_name, {i}::BIGINT AS col_num, CAST({c} AS VARCHAR) AS level, {carried} FROM {source}"
        for i, c in enumerate(columns, 1)
    )
