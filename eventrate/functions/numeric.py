"""Rounding and event rates with one rule in every engine.

Rates decide which level or bin receives missing values, so their rounding has to
be reproducible: half goes away from zero, and rates are kept as whole thousandths
or hundredths while they are compared.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_k(value: Column | str, digits: int = 2) -> Column:
    """Round a double half away from zero to ``digits`` places."""
    value, scale = col(value), F.lit(float(10**digits))
    whole = F.signum(value) * F.floor(F.abs(value) * scale + F.lit(0.5)) / scale
    # Beyond this size a double has no such places left, and the scaled value no integer.
    return F.when(F.abs(value) < F.lit(2.0**52 / 10**digits), whole).otherwise(value.cast("double"))


def rate_units(events: Column | str, total: Column | str, digits: int = 3) -> Column:
    """``events / total`` in whole units of ``10**-digits``, by integer arithmetic."""
    events, total = col(events).cast("bigint"), col(total).cast("bigint")
    doubled, halves = events * F.lit(2 * 10**digits) + total, total * F.lit(2)
    whole = F.round((doubled - doubled % halves) / halves).cast("bigint")
    return F.when(total != 0, whole)


def rate_gap(
    rate: Column | str, events: Column | str, total: Column | str, other: Mapping[str, Column], digits: int | None
) -> tuple[Column, Column]:
    """How far a rate is from another one, as something to order by, and whether it is above the other.

    ``other`` has the ``rate`` of the other one, which is compared in whole units of ``digits`` places, or, with None, its
    ``events`` and ``total``: then the fractions themselves are compared, exactly for up to 10**12 rows.
    """
    if digits is not None:
        own, theirs = (F.round(col(r) * F.lit(10.0**digits)).cast("bigint") for r in (rate, other["rate"]))
        return F.struct(F.abs(theirs - own).alias("whole")), own > theirs
    wide = {n: c.cast("decimal(19,0)") for n, c in (("e", col(events)), ("n", col(total)), ("oe", other["events"]), ("on", other["total"]))}
    cross = wide["oe"] * wide["n"] - wide["e"] * wide["on"]
    # |cross| / n by long division, twelve digits at a time: fractions over 10**12 rows differ by more than 24 digits hold.
    rest, places = F.abs(cross).cast("decimal(38,0)"), []
    for _ in range(3):
        places.append(F.floor((rest - rest % wide["n"]) / wide["n"]).cast("bigint"))
        rest = ((rest % wide["n"]).cast("decimal(19,0)") * F.lit(10**12).cast("decimal(13,0)")).cast("decimal(38,0)")
    missing = cross.isNull()
    return F.when(~missing, F.struct(*[p.alias(f"p{i}") for i, p in enumerate(places)])), cross < 0


def units_to_rate(units: Column | str, digits: int = 3) -> Column:
    return col(units).cast("double") / F.lit(float(10**digits))
