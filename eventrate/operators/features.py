"""Derived features."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventrate.functions import expressions as X


def safe_ratio(
    df: DataFrame, num: str, den: str, on_zero: float | None = None, digits: int | None = 2, name: str = "ratio"
) -> DataFrame:
    return df.withColumn(name, X.ratio(num, den, on_zero, digits))


def threshold_label(
    df: DataFrame, column: str, cuts: Sequence[float], labels: Sequence[Any], name: str | None = None
) -> DataFrame:
    return df.withColumn(name or column, X.threshold(column, cuts, labels))


def interval_cut(
    df: DataFrame, column: str, breaks: Sequence[float], labels: Sequence[Any], name: str | None = None
) -> DataFrame:
    return df.withColumn(name or column, X.interval(column, breaks, labels))


def dummies(
    df: DataFrame, column: str, levels: Mapping[str, str] | Sequence[str], drop: bool = True
) -> DataFrame:
    """One 0/1 column per chosen level (``level: new name``); the source column may be dropped."""
    if not isinstance(levels, Mapping):
        levels = {v: f"{column}_{re.sub(r'[^0-9A-Za-z]+', '_', v)}" for v in levels}
    out = df.withColumns({name: (F.col(column) == F.lit(v)).cast("int") for v, name in levels.items()})
    return out.drop(column) if drop else out


def interaction(df: DataFrame, rules: Sequence[tuple[Column, Any]], default: Any, name: str = "interaction") -> DataFrame:
    """Label rows by the first rule over several columns that holds."""
    return df.withColumn(name, X.nested_if(rules, default))


def weighted_score(df: DataFrame, predicted: str, value: str, name: str = "weighted") -> DataFrame:
    """Predicted class times value."""
    return df.withColumn(name, F.col(predicted) * F.col(value))
