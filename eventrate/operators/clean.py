"""Cleaning: names, spellings, implausible values, target, column order."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Variables(NamedTuple):
    """Names by kind; ``other`` holds dates, timestamps, binary and nested columns."""

    categorical: list[str]
    numeric: list[str]
    other: list[str] = []


class TableAndReport(NamedTuple):
    data: DataFrame
    report: DataFrame


def matching_columns(df: DataFrame, pattern: str) -> list[str]:
    return [c for c in df.columns if re.search(pattern, c)]


def rename_matching(df: DataFrame, pattern: str, new: str) -> DataFrame:
    """Rename the one column whose name matches the pattern."""
    found = matching_columns(df, pattern)
    if len(found) != 1:
        raise ValueError(f"pattern {pattern!r} matches {found}")
    return df.withColumnRenamed(found[0], new)


def canonicalise(df: DataFrame, column: str, mapping: Mapping[str, str]) -> DataFrame:
    """Replace the spellings of a category by their canonical form."""
    return df.replace(dict(mapping), subset=[column])


def null_values(df: DataFrame, column: str, values: Iterable[Any]) -> DataFrame:
    return df.withColumn(column, F.when(~F.col(column).isin(list(values)), F.col(column)))


def null_where(df: DataFrame, column: str, predicate: Column) -> DataFrame:
    """NULL where the predicate holds; rows for which it is unknown stay."""
    return df.withColumn(column, F.when(F.coalesce(predicate, F.lit(False)), F.lit(None)).otherwise(F.col(column)))


def require_target(df: DataFrame, event: str) -> DataFrame:
    return df.dropna(subset=[event])


def keep_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def encode_event(df: DataFrame, column: str, positive: Any, name: str | None = None) -> DataFrame:
    """1 where the column equals ``positive``, else 0; NULL stays NULL."""
    return df.withColumn(name or column, (F.col(column) == F.lit(positive)).cast("int"))


def to_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def to_number(df: DataFrame, columns: Sequence[str], type_name: str = "double") -> DataFrame:
    """Numbers from text; text that is no number becomes NULL."""
    return df.withColumns({c: F.col(c).try_cast(type_name) for c in columns})


def add_columns(df: DataFrame, **values: Any) -> DataFrame:
    """Constant or computed columns."""
    return df.withColumns({n: v if isinstance(v, Column) else F.lit(v) for n, v in values.items()})


def drop_vars(df: DataFrame, report: DataFrame, names: Sequence[str]) -> TableAndReport:
    """Drop variables from a table and their rows from its report."""
    return TableAndReport(df.drop(*names), report.where(~F.col("var_name").isin(list(names))))


def alignment(df: DataFrame, report: DataFrame) -> DataFrame:
    """Variables of table and report with flags telling where each one occurs."""
    own = df.sparkSession.createDataFrame([(c, True) for c in df.columns], "var_name string, in_table boolean")
    listed = report.select("var_name").distinct().withColumn("in_report", F.lit(True))
    return own.join(listed, "var_name", "full").select(
        "var_name", F.coalesce("in_table", F.lit(False)).alias("in_table"),
        F.coalesce("in_report", F.lit(False)).alias("in_report"),
    )


def check_aligned(df: DataFrame, report: DataFrame) -> bool:
    return alignment(df, report).where(~F.col("in_table") | ~F.col("in_report")).isEmpty()


def split_variables(df: DataFrame, max_int_levels: int = 20, exclude: Sequence[str] = ()) -> Variables:
    """Text, booleans and coarse integers are categorical, other numbers numeric, anything else ``other``.

    A sketch first rules out integers with twice the levels or more, many times its error, so that the
    exact count only shuffles columns with few values; in that margin lies all that is not exact.
    """
    fields = [f for f in df.schema.fields if f.name not in exclude]
    text = [f.name for f in fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]
    whole = [f.name for f in fields if isinstance(f.dataType, T.IntegralType)]
    coarse: set[str] = set()
    if whole:
        rough = df.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in whole]).first()
        maybe = [c for c in whole if rough[c] < 2 * max_int_levels]
        if maybe:
            exact = df.agg(
                *[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in maybe]
            ).first()
            coarse = {c for c in maybe if (exact[c] or 0) < max_int_levels}
    numeric = [
        f.name for f in fields if isinstance(f.dataType, T.NumericType) and f.name not in coarse
    ]
    categorical = [f.name for f in fields if f.name in text or f.name in coarse]
    placed = {*categorical, *numeric}
    return Variables(categorical, numeric, [f.name for f in fields if f.name not in placed])


def order_columns(df: DataFrame, event: str, variables: Variables | None = None) -> DataFrame:
    """Target first, then categorical, then numeric, then any other columns."""
    if variables is None:
        others = [f for f in df.schema.fields if f.name != event]
        variables = Variables(
            [f.name for f in others if isinstance(f.dataType, (T.StringType, T.BooleanType))],
            [f.name for f in others if isinstance(f.dataType, T.NumericType)],
        )
    front = [event, *[c for c in variables.categorical if c != event], *[c for c in variables.numeric if c != event]]
    return df.select(*front, *[c for c in df.columns if c not in front])
