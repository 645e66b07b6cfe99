"""Column expressions: nested conditions, ratios, flags, intervals and scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventrate.functions.numeric import col, round_k


def nested_if(rules: Sequence[tuple[Column, Any]], default: Any) -> Column:
    """First label whose condition holds; an unknown (NULL) condition gives NULL."""
    out: Any = F
    for condition, label in rules:
        out = out.when(condition.isNull(), F.lit(None)).when(condition, _value(label))
    return out.otherwise(_value(default))


def _value(v: Any) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def ratio(num: Column | str, den: Column | str, on_zero: float | None = None, digits: int | None = 2) -> Column:
    """``num / den``, with ``on_zero`` where ``den`` is 0; NULL if either side is NULL."""
    num, den = col(num).cast("double"), col(den).cast("double")
    value = F.when(den.isNull(), F.lit(None)).when(den != 0, num / den).otherwise(F.lit(on_zero).cast("double"))
    return value if digits is None else round_k(value, digits)


def threshold(value: Column | str, cuts: Sequence[float], labels: Sequence[Any]) -> Column:
    """Label of the first cut point that is not exceeded; the last label lies above all cuts."""
    if len(labels) != len(cuts) + 1 or list(cuts) != sorted(cuts):
        raise ValueError("need ascending cuts and one label more than cuts")
    value = col(value)
    return nested_if([(value <= F.lit(c), label) for c, label in zip(cuts, labels)], labels[-1])


def interval(value: Column | str, breaks: Sequence[float], labels: Sequence[Any]) -> Column:
    """Label of the interval ``(a, b]`` that holds the value; NULL outside all of them."""
    if len(labels) != len(breaks) - 1 or list(breaks) != sorted(breaks):
        raise ValueError("need ascending breaks and one label per interval")
    value = col(value)
    return reduce(
        lambda acc, abl: acc.when((value > F.lit(abl[0])) & (value <= F.lit(abl[1])), _value(abl[2])),
        zip(breaks, breaks[1:], labels), F,
    )


def linear(coefficients: Mapping[str, float], intercept: float = 0.0) -> Column:
    """Intercept plus the sum of coefficient times column, in the given order."""
    return reduce(
        lambda acc, cw: acc + F.lit(float(cw[1])) * F.col(cw[0]).cast("double"),
        coefficients.items(), F.lit(float(intercept)),
    )


def logistic(eta: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))
