"""Joins of a table with what an operator decided about its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventrate.runtime import LIMITS, Limits, materialise


def without(
    docs: DataFrame, keys: DataFrame, limits: Limits = LIMITS, keep: Callable[[DataFrame], DataFrame] = lambda t: t,
) -> DataFrame:
    """Rows of ``docs`` that equal no row of ``keys`` in all columns of ``keys``; NULL equals NULL.

    The keys are stored and sent to every task if few, else both sides are shuffled.  ``keep`` gets the stored table.
    """
    names = keys.columns
    gone = keep(materialise(keys.select(*[F.col(c).alias(f"_gone_{c}") for c in names]).distinct(), "gone"))
    same = None
    for c in names:
        one = F.col(c).eqNullSafe(F.col(f"_gone_{c}"))
        same = one if same is None else same & one
    small = gone.count() <= limits.broadcast_rows
    return docs.join(F.broadcast(gone) if small else gone, same, "left_anti")
