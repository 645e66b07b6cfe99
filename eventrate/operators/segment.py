"""Tiers of scored rows and lists of rows to target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventrate.functions.expressions import interval
from eventrate.operators import profile, rank
from eventrate.runtime import LIMITS, Limits


def tier(
    df: DataFrame, column: str, tiers: int, key: Sequence[str] | str | None, name: str = "tier",
    labels: Sequence[str] | None = None, limits: Limits = LIMITS,
) -> DataFrame:
    """Add the quantile tier of a score, as a number or with the given labels."""
    out = rank.ntile(df, column, tiers, key, name, limits)
    if labels is None:
        return out
    return out.withColumn(name, interval(name, list(range(tiers + 1)), labels))


def tier_bounds(df: DataFrame, tier_column: str, column: str) -> DataFrame:
    """Largest and smallest score of each tier."""
    return df.groupBy(tier_column).agg(
        F.max(column).alias("max"), F.min(column).alias("min"), F.count(tier_column).alias("rows")
    ).where(F.col("rows") > 0)


def tier_crosstab(df: DataFrame, rows: str, columns: str, levels: Sequence | None = None) -> DataFrame:
    return profile.crosstab(df, rows, columns, levels)


def flagged_list(df: DataFrame, predicted: str, key: str) -> DataFrame:
    """Keys of rows predicted to have the event."""
    return df.where(F.col(predicted) == 1).select(key)


def target_list(df: DataFrame, thresholds: dict[str, float], key: str) -> DataFrame:
    """Keys of rows above every threshold."""
    for column, least in thresholds.items():
        df = df.where(F.col(column) > F.lit(least))
    return df.select(key)


def budget_target(
    df: DataFrame, value: str, key: str, tiles: int = 10, keep: int = 2,
    tie_key: Sequence[str] | str | None = None, limits: Limits = LIMITS,
) -> DataFrame:
    """Keys in the ``keep`` highest of ``tiles`` value tiles, with their rows per tile."""
    tiled = rank.ntile(df, value, tiles, tie_key or key, "tile", limits)
    return (
        tiled.where(F.col("tile") > tiles - keep).groupBy("tile", key).agg(F.count(F.lit(1)).alias("rows"))
    )


def target_share(targets: DataFrame, df: DataFrame) -> DataFrame:
    """Rows of a target list as a share of the population."""
    counts = targets.agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint").alias("d")).unionByName(
        df.agg(F.lit(0).cast("bigint").alias("n"), F.count(F.lit(1)).alias("d"))
    ).agg(F.sum("n").alias("targeted"), F.sum("d").alias("population"))
    return counts.select(
        "targeted", "population",
        F.when(F.col("population") > 0, F.col("targeted") / F.col("population")).alias("share"),
    )
