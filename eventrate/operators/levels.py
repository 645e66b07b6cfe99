"""Event rates of category levels: rates, NULL imputation, merging and recoding.

All categorical columns are handled together by unpivoting to (var_name, level, event)
and aggregating once, so one level that holds most rows is summed before the shuffle.
Everything after that works on the table of levels, not on rows.

Shared column names: ``var_name``, ``col_num``, ``level``, ``events``, ``total``,
``rate``, ``total_levels`` for rates, and ``level`` -> ``imputed_lvl`` for decode tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventrate.functions.numeric import rate_gap, rate_units, units_to_rate
from eventrate.operators import rank
from eventrate.runtime import LIMITS, Limits, fits_broadcast, materialise

RATE_COLUMNS = ["var_name", "col_num", "level", "events", "total", "rate", "total_levels"]
DECODE_COLUMNS = ["var_name", "col_num", "level", "imputed_lvl"]
ZERO_CODE = "0"
SALTS = 64


class Imputed(NamedTuple):
    data: DataFrame
    rates: DataFrame


class Condensed(NamedTuple):
    groups: DataFrame
    decode: DataFrame


class Clubbed(NamedTuple):
    rates: DataFrame
    decode: DataFrame


class Reduced(NamedTuple):
    data: DataFrame
    rates: DataFrame
    decode: DataFrame
    dropped: list[str]


def _position(columns: Sequence[str]) -> Column:
    """Number of a variable, from its place in the column list."""
    return reduce(
        lambda acc, ic: acc.when(F.col("var_name") == ic[1], F.lit(ic[0])), enumerate(columns, 1), F
    ).cast("bigint")


def level_counts(df: DataFrame, event: str, columns: Sequence[str], rows: str | None = None) -> DataFrame:
    """Rows and events of every level of every column; NULL counts as a level.

    With ``rows`` the table is already summed up: ``event`` holds numbers of events and
    ``rows`` numbers of rows.  Summing by a join key before a join keeps the join small.
    """
    narrow = df.select(
        F.col(event).cast("bigint").alias("_events"),
        (F.lit(1) if rows is None else F.col(rows)).cast("bigint").alias("_rows"),
        *[F.col(c).cast("string").alias(c) for c in columns],
    )
    long = narrow.unpivot(["_events", "_rows"], list(columns), "var_name", "level")
    return (
        long.groupBy("var_name", "level")
        .agg(F.sum("_events").alias("events"), F.sum("_rows").alias("total"))
        .withColumn("col_num", _position(columns))
    )


def level_event_rate(
    df: DataFrame | None, event: str, columns: Sequence[str], digits: int | None = 3,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Event rate of each level that has at least one event, NULL included.

    ``total_levels`` is the number of such levels of the variable.  ``digits=None`` leaves
    the rate unrounded.
    """
    counts = level_counts(df, event, columns) if counts is None else counts
    # Both uses below keep the same columns, so Spark aggregates once and reuses the shuffle.
    seen = counts.where((F.col("events") > 0) & (F.col("total") > 0))
    per_variable = seen.groupBy("var_name").agg(F.count(F.lit(1)).alias("total_levels"))
    rate = (
        F.col("events") / F.col("total")
        if digits is None
        else units_to_rate(rate_units("events", "total", digits), digits)
    )
    # One row per column of the table, whatever the number of rows or levels.
    return seen.join(F.broadcast(per_variable), "var_name").withColumn("rate", rate).select(RATE_COLUMNS)


def zero_event_levels(
    df: DataFrame | None, event: str, columns: Sequence[str], counts: DataFrame | None = None
) -> DataFrame:
    """Levels never seen with an event, all coded 0."""
    counts = level_counts(df, event, columns) if counts is None else counts
    return counts.where(F.col("events") == 0).withColumn("imputed_lvl", F.lit(ZERO_CODE)).select(DECODE_COLUMNS)


def null_receivers(rates: DataFrame, digits: int | None = 9) -> DataFrame:
    """For each variable with a NULL level: the level whose rate is nearest to it.

    Of two equally near levels the one with the lower rate is taken, then the first by name.  Rates are compared
    at ``digits`` places, or, with None, as the fractions they are.
    """
    sides = ("events", "total") if digits is None else ("rate",)
    nulls = rates.where(F.col("level").isNull()).select("var_name", *[F.col(c).alias(f"null_{c}") for c in sides])
    distance, above = rate_gap("rate", "events", "total", {c: F.col(f"null_{c}") for c in sides}, digits)
    near = F.struct(distance.alias("distance"), above.alias("above"), F.col("level"))
    # At most one NULL row per column of the table.
    return (
        rates.where(F.col("level").isNotNull())
        .join(F.broadcast(nulls), "var_name")
        .groupBy("var_name")
        .agg(F.min(near).alias("nearest"))
        .select("var_name", F.col("nearest.level").alias("receiver"))
    )


def impute_null_level(df: DataFrame, rates: DataFrame, digits: int | None = 9) -> Imputed:
    """Replace NULL by the level with the nearest event rate and drop the NULL level.

    The receiver keeps its own counts.  A variable in which only NULL has events has no
    receiver, and its NULLs stay.  ``digits`` as for ``null_receivers``.
    """
    receivers = {r["var_name"]: r["receiver"] for r in null_receivers(rates, digits).collect()}
    types = dict(df.dtypes)
    filled = {c: F.coalesce(F.col(c), F.lit(v).cast(types[c])) for c, v in receivers.items()}
    fewer = F.when(F.col("var_name").isin(list(receivers)), 1).otherwise(0) if receivers else F.lit(0)
    kept = rates.where(F.col("level").isNotNull()).withColumn(
        "total_levels", (F.col("total_levels") - fewer).cast("bigint")
    )
    return Imputed(df.withColumns(filled) if filled else df, kept)


def _group_of_level(rates: DataFrame, groups: int, limits: Limits) -> DataFrame:
    """Add ``tile``: the ``groups``-tile of each level within its variable, by rate and name."""
    marked = rates.withColumn("_units", F.col("rate"))
    sizes = {
        r["var_name"]: r["total_levels"]
        for r in rates.where(F.col("total_levels") > limits.task_rows)
        .select("var_name", "total_levels").distinct().collect()
    }
    small = marked.where(F.col("total_levels") <= limits.task_rows).withColumn(
        "tile", F.ntile(groups).over(Window.partitionBy("var_name").orderBy("_units", "level"))
    )
    if not sizes:
        return small.drop("_units")
    # Variables with too many levels for one task: find the tile borders instead of sorting.
    long = marked.where(F.col("var_name").isin(list(sizes))).withColumn(rank.SERIES, F.col("var_name"))
    cuts = rank.rows_at_ranks(
        long, ["_units", "level"], {v: rank.tile_edges(n, groups) for v, n in sizes.items()}, sizes, limits
    )
    label = reduce(
        lambda acc, v: acc.when(
            F.col("var_name") == v,
            rank.tile_label("_units", ["level"], [cuts[v][e] for e in rank.tile_edges(sizes[v], groups)]),
        ),
        sizes, F,
    )
    big = marked.where(F.col("var_name").isin(list(sizes))).withColumn("tile", label)
    return small.unionByName(big).drop("_units")


def condense_levels(rates: DataFrame, groups: int = 3, limits: Limits = LIMITS) -> Condensed:
    """Merge the levels of variables with more than ``groups`` levels into that many groups.

    ``rates`` must hold no NULL level.  The pooled rate stays unrounded.  Variables with fewer
    levels pass through unchanged; ``condensed`` tells them apart.
    """
    tiled = _group_of_level(rates.where(F.col("total_levels") > groups), groups, limits)
    tiled = tiled.withColumn("imputed_lvl", F.col("tile").cast("string"))
    pooled = (
        tiled.groupBy("var_name", "col_num", F.col("imputed_lvl").alias("level"))
        .agg(F.sum("events").cast("bigint").alias("events"), F.sum("total").cast("bigint").alias("total"))
        .withColumn("rate", F.col("events") / F.col("total"))
        .withColumn("total_levels", F.lit(groups).cast("bigint"))
        .withColumn("condensed", F.lit(True))
    )
    passed = rates.where(F.col("total_levels") <= groups).withColumn("condensed", F.lit(False))
    names = [*RATE_COLUMNS, "condensed"]
    return Condensed(pooled.select(names).unionByName(passed.select(names)), tiled.select(DECODE_COLUMNS))


def club_map(groups: DataFrame, squared_tolerance: float = 0.0004) -> DataFrame:
    """Which group of a variable each of its groups is merged into.

    A group joins the one before it when the squared difference of their rates is below the tolerance; a run of
    such neighbours is merged into its first.  Condensed groups stand in the order of their numbers, levels that were
    never condensed in the order of their names.
    """
    # condense_levels leaves a few groups per variable, so these windows are tiny.
    number = F.when(F.col("condensed"), F.col("level").try_cast("int"))
    in_order = Window.partitionBy("var_name").orderBy(number, "level")
    step = F.col("rate") - F.lag("rate").over(in_order)
    apart = F.when(F.coalesce(step * step < squared_tolerance, F.lit(False)), 0).otherwise(1)
    runs = groups.withColumn("_number", number).withColumn("_apart", apart)
    runs = runs.withColumn("_run", F.sum("_apart").over(in_order))
    by_run = Window.partitionBy("var_name", "_run").orderBy("_number", "level")
    return runs.withColumn("into", F.first("level").over(by_run)).select(*groups.columns, "into")


def club_levels(groups: DataFrame, decode: DataFrame, squared_tolerance: float = 0.0004) -> Clubbed:
    """Merge neighbouring groups with like rates; pool their counts and rewrite the codes.

    A variable that was never condensed keeps its level names: merged levels are decoded to
    the name of the level that receives them.
    """
    mapped = club_map(groups, squared_tolerance)
    pooled = (
        mapped.groupBy("var_name", "col_num", F.col("into").alias("level"))
        .agg(F.sum("events").cast("bigint").alias("events"), F.sum("total").cast("bigint").alias("total"))
        .withColumn("rate", F.col("events") / F.col("total"))
        .withColumn("total_levels", F.count(F.lit(1)).over(Window.partitionBy("var_name")))
        .select(RATE_COLUMNS)
    )
    # A row per group and variable.
    moves = mapped.where("condensed").select("var_name", F.col("level").alias("imputed_lvl"), "into")
    recoded = decode.join(F.broadcast(moves), ["var_name", "imputed_lvl"], "left").select(
        "var_name", "col_num", "level", F.coalesce("into", "imputed_lvl").alias("imputed_lvl")
    )
    renamed = mapped.where(~F.col("condensed") & (F.col("into") != F.col("level"))).select(
        "var_name", "col_num", "level", F.col("into").alias("imputed_lvl")
    )
    return Clubbed(pooled, recoded.unionByName(renamed))


def build_decode(decode: DataFrame, zero: DataFrame) -> DataFrame:
    """Complete decode table: merged levels and levels without any event."""
    return decode.select(DECODE_COLUMNS).unionByName(zero.select(DECODE_COLUMNS))


def apply_decode(
    df: DataFrame, decode: DataFrame, columns: Sequence[str] | None = None, limits: Limits = LIMITS,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Replace each level by its code; values without a code stay.  NULL matches NULL.

    ``counts``, the table of ``level_counts``, tells frequent levels of large lookups without reading the rows.
    """
    text = F.coalesce(F.octet_length("level"), F.lit(0)) + F.coalesce(F.octet_length("imputed_lvl"), F.lit(0))
    # One row per column of the table.
    sizes = {
        r["var_name"]: (r["n"], r["bytes"])
        for r in decode.groupBy("var_name").agg(F.count(F.lit(1)).alias("n"), F.sum(text).alias("bytes")).collect()
    }
    wanted = sizes if columns is None else set(columns) & set(sizes)
    for c in [c for c in df.columns if c in wanted]:
        lookup = decode.where(F.col("var_name") == c).select(
            F.col("level").alias("_level"), F.col("imputed_lvl").alias("_code")
        )
        own = df.withColumn(c, F.col(c).cast("string"))
        small = sizes[c][0] <= limits.broadcast_rows and sizes[c][1] <= limits.broadcast_bytes
        joined = _lookup(own, lookup, c, small, _own_counts(counts, c))
        df = joined.withColumn(c, F.coalesce("_code", c)).select(df.columns)
    # Columns whose variable has no code at all are text all the same.
    rest = [c for c in df.columns if columns is not None and c in set(columns) - set(sizes)]
    return df.withColumns({c: F.col(c).cast("string") for c in rest}) if rest else df


def _own_counts(counts: DataFrame | None, column: str) -> DataFrame | None:
    return None if counts is None else counts.where(F.col("var_name") == column).select("level", "total")


def rows_in_levels(
    df: DataFrame, column: str, levels: DataFrame, keep: bool = True, limits: Limits = LIMITS,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Rows whose ``column`` is (``keep``) or is not among the ``level`` column of ``levels``; NULL matches NULL."""
    lookup = levels.select(F.col("level").alias("_level")).distinct().withColumn("_code", F.lit(True))
    own = df.withColumn("_text", F.col(column).cast("string"))
    found = _lookup(own, lookup, "_text", fits_broadcast(lookup, limits), _own_counts(counts, column))
    return found.where(F.col("_code").isNotNull() if keep else F.col("_code").isNull()).select(df.columns)


def _lookup(df: DataFrame, lookup: DataFrame, column: str, small: bool, counts: DataFrame | None) -> DataFrame:
    """Left join of rows with (``_level``, ``_code``): broadcast if small, else with frequent levels spread out."""
    if small:
        return df.join(F.broadcast(lookup), F.col(column).eqNullSafe(F.col("_level")), "left")
    return _salted_lookup(df, lookup, column, counts)


def _salted_lookup(df: DataFrame, lookup: DataFrame, column: str, counts: DataFrame | None = None) -> DataFrame:
    """Shuffled left join on a level, with the rows of frequent levels spread over salts."""
    if counts is None:
        counts = df.groupBy(F.col(column).alias("level")).agg(F.count(F.lit(1)).alias("total"))
    share = (counts.agg(F.sum("total")).first()[0] or 0) / (4 * SALTS)
    # A level above this share of the rows: fewer than 4 * SALTS of them can exist.
    hot = [r["level"] for r in counts.where(F.col("total") > share).select("level").collect()]
    is_hot = reduce(lambda a, b: a | b, [F.col("_level").eqNullSafe(F.lit(v)) for v in hot], F.lit(False))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    hot_row = reduce(lambda a, b: a | b, [F.col(column).eqNullSafe(F.lit(v)) for v in hot], F.lit(False))
    # The task number tells copies of one row apart; any salt finds the code, as hot levels have all.
    spread = F.pmod(F.xxhash64(F.spark_partition_id(), *df.columns), F.lit(SALTS))
    salt = F.when(hot_row, spread).otherwise(F.lit(0)).cast("int")
    return df.withColumn("_row_salt", salt).join(
        lookup.withColumn("_salt", F.explode(copies)),
        F.col(column).eqNullSafe(F.col("_level")) & (F.col("_row_salt") == F.col("_salt")),
        "left",
    )


def reduce_levels(
    df: DataFrame, event: str, columns: Sequence[str], groups: int = 3,
    squared_tolerance: float = 0.0004, limits: Limits = LIMITS,
) -> Reduced:
    """Rates, NULL imputation, condensing, clubbing and recoding of all given columns.

    The rows are scanned once for the level counts, which are stored; the other tables are
    derived from them.  Columns left with a single code are dropped.
    """
    counts = materialise(level_counts(df, event, columns), "levels")
    zero = zero_event_levels(df, event, columns, counts)
    imputed = impute_null_level(df, level_event_rate(df, event, columns, counts=counts))
    condensed = condense_levels(imputed.rates, groups, limits)
    clubbed = club_levels(condensed.groups, condensed.decode, squared_tolerance)
    decode = materialise(build_decode(clubbed.decode, zero), "decode")
    # Codes that remain per variable, read off the level tables rather than the rows.
    codes = clubbed.rates.select("var_name", "level").unionByName(
        zero.select("var_name", F.col("imputed_lvl").alias("level"))
    )
    left = {r["var_name"]: r["n"] for r in codes.groupBy("var_name").agg(F.count_distinct("level").alias("n")).collect()}
    dropped = [c for c in columns if left.get(c, 0) <= 1]
    data = apply_decode(imputed.data.drop(*dropped), decode, [c for c in columns if c not in dropped], limits, counts)
    return Reduced(data, clubbed.rates, decode, dropped)
