"""Numeric columns: event rate by quantile bin, imputation and outliers.

Bin borders are literals found by exact selection, so labelling rows is a narrow map and
the bin table is one aggregate over (variable, bin) for all columns together.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventrate.functions.numeric import rate_gap, rate_units, round_k, units_to_rate
from eventrate.operators import rank
from eventrate.runtime import LIMITS, Limits

BIN_COLUMNS = [
    "bin", "events", "var_name", "total", "rate", "col_num", "data_type", "max", "min", "mean", "levels",
]


def _first_edges(rows: int, start: int) -> dict[int, int]:
    """Last rank of the first bin for every number of bins up to ``start``."""
    return {j: math.ceil(rows / j) for j in range(1, start + 1)}


def _is_zero(value: float) -> bool:
    return math.floor(abs(float(value)) * 100 + 0.5) == 0


def _pick_bins(cuts: Mapping[int, rank.Cut], rows: int, start: int) -> int:
    """Largest number of bins whose first bin reaches beyond zero; 1 if there is none."""
    edges = _first_edges(rows, start)
    for j in range(start, 0, -1):
        if rows and not _is_zero(cuts[edges[j]].values[0]):
            return j
    return 1


def choose_bins(df: DataFrame, columns: Sequence[str], start: int = 10, limits: Limits = LIMITS) -> dict[str, int]:
    """Adaptive number of bins per column, from the values at ``start`` ranks."""
    cuts, sizes = rank.order_statistics(
        df, columns, lambda _, n: set(_first_edges(n, start).values()), limits=limits
    )
    return {c: _pick_bins(cuts[c], sizes[c], start) for c in columns}


def _borders(
    df: DataFrame, columns: Sequence[str], bins: int, adaptive: bool, key: Sequence[str], limits: Limits
) -> tuple[dict[str, int], dict[str, list[rank.Cut]]]:
    """Number of bins and the cuts between them, per column."""

    def ranks(_: str, n: int) -> set[int]:
        first = set(_first_edges(n, bins).values()) if adaptive else set()
        return first | set(rank.tile_edges(n, bins))

    cuts, sizes = rank.order_statistics(df, columns, ranks, key, limits=limits)
    picked = {c: _pick_bins(cuts[c], sizes[c], bins) if adaptive else bins for c in columns}
    # Most columns keep the full number of bins; only the others need more ranks.
    fewer = [c for c in columns if picked[c] != bins and picked[c] > 1]
    if fewer:
        more, _ = rank.order_statistics(
            df, fewer, lambda c, n: rank.tile_edges(n, picked[c]), key, {c: sizes[c] for c in fewer}, limits
        )
        cuts.update(more)
    edges = {c: [cuts[c][r] for r in rank.tile_edges(sizes[c], picked[c])] for c in columns}
    return picked, edges


def bin_event_table(
    df: DataFrame, event: str, columns: Sequence[str], bins: int = 10, adaptive: bool = True,
    key: Sequence[str] | str | None = None, digits: int | None = 2, limits: Limits = LIMITS,
) -> DataFrame:
    """Events, rows, rate and range of each quantile bin of each column, plus a NULL bin.

    ``adaptive`` lowers the number of bins while the first one holds only zeros.  ``key`` makes
    rows distinct and splits ties; ``None`` splits them by a hash of the row.  ``digits=None`` leaves
    rate, range and mean unrounded.
    """
    columns = list(columns)
    if key is None:
        df, key, (picked, edges) = rank.split_copies(
            df.select(event, *columns), lambda t, k: _borders(t, columns, bins, adaptive, k, limits),
            lambda found: [cut for cuts in found[1].values() for cut in cuts],
        )
    else:
        key = [key] if isinstance(key, str) else list(key)
        picked, edges = _borders(df, columns, bins, adaptive, key, limits)
        for found in edges.values():
            rank.require_distinct(found, key)
    types = dict(df.dtypes)
    entries: list[Column] = []
    for c in columns:
        entries += [F.lit(c), F.col(c).cast("double"), rank.tile_label(c, key, edges[c]).cast("bigint")]
    long = df.select(
        F.col(event).cast("int").alias("_event"),
        F.stack(F.lit(len(columns)), *entries).alias("var_name", "_value", "bin"),
    )
    found = long.groupBy("var_name", "bin").agg(
        F.sum("_event").cast("bigint").alias("_events"),
        F.count(F.lit(1)).alias("total"),
        *[
            (value if digits is None else round_k(value, digits)).alias(name)
            for name, value in (("max", F.max("_value")), ("min", F.min("_value")), ("mean", F.avg("_value")))
        ],
    )
    exact = F.col("_events") / F.col("total")
    rate = exact if digits is None else units_to_rate(rate_units("_events", "total", digits), digits)
    frame = [
        (c, i, b, types[c], picked[c] + 1)
        for i, c in enumerate(columns, 1) for b in (*range(1, picked[c] + 1), None)
    ]
    wanted = df.sparkSession.createDataFrame(
        frame, "var_name string, col_num bigint, bin bigint, data_type string, levels bigint"
    )
    same = (F.col("f.var_name") == F.col("w.var_name")) & F.col("f.bin").eqNullSafe(F.col("w.bin"))
    joined = F.broadcast(wanted).alias("w").join(found.alias("f"), same, "left")
    return joined.select(
        "w.bin", F.coalesce("_events", F.lit(0).cast("bigint")).alias("events"), "w.var_name", "total",
        rate.alias("rate"),
        "col_num", "data_type", "max", "min", "mean", "levels",
    ).select(BIN_COLUMNS)


def rate_series(bin_table: DataFrame, var_name: str) -> DataFrame:
    """Event rate by bin of one variable, as plotted in a trend chart."""
    return (
        bin_table.where((F.col("var_name") == var_name) & F.col("bin").isNotNull())
        .select("bin", "rate").orderBy("bin")
    )


def null_fill_values(bin_table: DataFrame, digits: int | None = 9) -> DataFrame:
    """Value for the NULLs of each variable: the mean of the bin with the nearest rate.

    Bins whose rate is not above that of the NULLs win over bins equally far above; several
    such bins are averaged.  Variables without NULLs are left out.  Rates are compared at ``digits`` places, or, with
    None, as the fractions they are.
    """
    whole = Window.partitionBy("var_name")  # one row per bin
    theirs = {c: F.max(F.when(F.col("bin").isNull(), F.col(c))).over(whole) for c in (("events", "total") if digits is None else ("rate",))}
    beside = bin_table.withColumns({f"_null_{c}": v for c, v in theirs.items()})
    distance, above = rate_gap("rate", "events", "total", {c: F.col(f"_null_{c}") for c in theirs}, digits)
    gaps = (
        beside.where(F.col("bin").isNotNull() & distance.isNotNull() & above.isNotNull())
        .withColumns({"_gap": distance, "_above": above})
        .withColumn("_best", F.min("_gap").over(whole))
        .where(F.col("_gap") == F.col("_best"))
    )
    return gaps.groupBy("var_name").agg(
        F.coalesce(
            F.avg(F.when(~F.col("_above"), F.col("mean"))),
            F.min_by(F.when(F.col("_above"), F.col("mean")), F.when(F.col("_above"), F.col("bin"))),
        ).alias("fill")
    )


def impute_null_by_bin(df: DataFrame, bin_table: DataFrame, digits: int | None = 9) -> DataFrame:
    """Replace NULLs by the value of the bin with the nearest event rate; such columns become double."""
    fills = {r["var_name"]: r["fill"] for r in null_fill_values(bin_table, digits).collect()}
    if not fills:
        return df
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in fills.items()})


def impute_median(df: DataFrame, column: str, limits: Limits = LIMITS) -> DataFrame:
    """Replace NULLs by the exact median."""
    (median,) = rank.quantile_values(df, [column], [0.5], limits=limits)[column]
    return df.withColumn(column, F.coalesce(F.col(column).cast("double"), F.lit(median).cast("double")))


def _hinge_ranks(rows: int) -> tuple[int, int, int, int]:
    """Ranks averaged for the lower and the upper hinge of the five-number summary."""
    depth = ((rows + 3) // 2) / 2
    low, high = math.floor(depth), math.ceil(depth)
    return low, high, rows + 1 - high, rows + 1 - low


def _whisker_values(df: DataFrame, columns: Sequence[str], coef: float, limits: Limits) -> list[tuple]:
    """Column, hinges, and the most extreme values inside the fences, these in the column's own type."""
    cuts, sizes = rank.order_statistics(df, columns, lambda _, n: _hinge_ranks(n), limits=limits)
    hinges: dict[str, tuple[float, float]] = {}
    for c in columns:
        if sizes[c]:
            a, b, d, e = (float(cuts[c][r].values[0]) for r in _hinge_ranks(sizes[c]))
            hinges[c] = ((a + b) / 2, (d + e) / 2)
    inside = []
    for i, (c, (low, high)) in enumerate(hinges.items()):
        fence = coef * (high - low)
        held = F.when(F.col(c).between(F.lit(low - fence), F.lit(high + fence)), F.col(c))
        inside += [F.min(held).alias(f"lo{i}"), F.max(held).alias(f"hi{i}")]
    row = df.agg(*inside).first() if inside else None
    return [(c, low, high, row[f"lo{i}"], row[f"hi{i}"]) for i, (c, (low, high)) in enumerate(hinges.items())]


def whiskers(
    df: DataFrame, columns: Sequence[str], coef: float = 1.5, limits: Limits = LIMITS
) -> DataFrame:
    """Box-plot statistics per column: hinges, and the most extreme values inside the fences."""
    rows = [(c, *(None if v is None else float(v) for v in values))
            for c, *values in _whisker_values(df, columns, coef, limits)]
    return df.sparkSession.createDataFrame(
        rows, "var_name string, lower_hinge double, upper_hinge double, lower_whisker double, upper_whisker double"
    )


def winsorise(df: DataFrame, columns: Sequence[str], coef: float = 1.5, limits: Limits = LIMITS) -> DataFrame:
    """Pull values beyond the whiskers onto them; a column with equal whiskers is left alone."""
    types = dict(df.dtypes)
    changed = {}
    for c, _, _, low, high in _whisker_values(df, columns, coef, limits):
        if low != high:
            least, most = F.lit(low).cast(types[c]), F.lit(high).cast(types[c])
            changed[c] = F.when(F.col(c) < least, least).when(F.col(c) > most, most).otherwise(F.col(c))
    return df.withColumns(changed) if changed else df
