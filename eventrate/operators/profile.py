"""Profiling: quality report, summaries, frequencies and column screening."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventrate.functions.numeric import rate_units, units_to_rate
from eventrate.operators import rank
from eventrate.runtime import LIMITS, Limits, materialise

PAIRS_AT_ONCE = 66  # correlations that one aggregate gives; more are found by matrix products
QUANTILES = {"p5": 0.05, "p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95}


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def null_counts(df: DataFrame) -> DataFrame:
    """Missing values per column."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "var_name", "missing")


def _compact(column: str, type_name: str) -> Column:
    """Stand-in for a value when only equality matters: texts become a digest of 16 bytes."""
    return F.unhex(F.md5(F.col(column).cast("binary"))) if type_name == "string" else F.col(column)


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, int]:
    """Distinct non-NULL values of each column, exactly.

    Columns of like type are unpivoted to (name, value), so duplicates disappear before the
    shuffle and one narrow pair is moved per distinct value.
    """
    columns = list(df.columns if columns is None else columns)
    types = dict(df.dtypes)
    families: dict[str, list[str]] = {}
    for c in columns:
        families.setdefault(rank._family(types[c]), []).append(c)
    parts = []
    for family, members in families.items():
        narrow = df.select(*[
            (_compact(c, types[c]) if family == "string" else F.col(c).cast(family)).alias(c) for c in members
        ])
        long = narrow.unpivot([], members, "var_name", "value").where(F.col("value").isNotNull())
        parts.append(long.distinct().groupBy("var_name").agg(F.count(F.lit(1)).alias("n")))
    out = dict.fromkeys(columns, 0)
    for part in parts:
        out.update({r["var_name"]: r["n"] for r in part.collect()})
    return out


REPORT_SCHEMA = T.StructType(
    [
        T.StructField("var_name", T.StringType()),
        T.StructField("datatype", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("records", T.LongType()),
        T.StructField("unique", T.LongType()),
        T.StructField("available", T.LongType()),
        T.StructField("available_pct", T.DoubleType()),
        T.StructField("missing", T.LongType()),
        T.StructField("missing_pct", T.DoubleType()),
        *[T.StructField(n, T.DoubleType()) for n in ("min", "max", "mean", *QUANTILES)],
    ]
)


def digest_texts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Texts replaced by their SHA-256: as many distinct and missing values in fewer bytes.

    For tables with long texts that are joined before they are profiled, so that the texts themselves stay out of the join.
    """
    return df.withColumns({c: F.sha2(F.col(c).cast("binary"), 256) for c in columns})


def quality_report(
    df: DataFrame, approximate: bool = False, limits: Limits = LIMITS, keep: bool = False
) -> DataFrame:
    """One row per column: type, rows, distinct values (NULL is one), availability and spread.

    ``approximate`` swaps exact distinct counts and quantiles for sketches, which turns the
    report into a single scan without a shuffle of values.  ``keep`` stores the rows once, for inputs that cost more than a scan,
    such as joins.
    """
    if keep:
        df = materialise(df, "profiled")
    numeric = numeric_columns(df)
    aggregates = [F.count(F.lit(1)).alias("_records")]
    for i, c in enumerate(df.columns):
        aggregates.append(F.count(F.col(c)).alias(f"_available_{i}"))
        if c in numeric:
            value = F.col(c).cast("double")
            aggregates += [F.min(value).alias(f"_min_{i}"), F.max(value).alias(f"_max_{i}"), F.avg(value).alias(f"_mean_{i}")]
        if approximate:
            aggregates.append(F.approx_count_distinct(c).alias(f"_distinct_{i}"))
            if c in numeric:
                probs = F.array(*[F.lit(p) for p in QUANTILES.values()])
                aggregates.append(F.percentile_approx(F.col(c).cast("double"), probs, 10000).alias(f"_quantiles_{i}"))
    seen = df.agg(*aggregates).first()
    sizes = {c: seen[f"_available_{i}"] for i, c in enumerate(df.columns)}
    if approximate:
        distinct = {c: seen[f"_distinct_{i}"] for i, c in enumerate(df.columns)}
        spread = {c: seen[f"_quantiles_{df.columns.index(c)}"] for c in numeric}
    else:
        distinct = distinct_counts(df)
        spread = rank.quantile_values(df, numeric, list(QUANTILES.values()), sizes, limits, distinct)
    rows, records = [], seen["_records"]
    for i, (c, type_name) in enumerate(df.dtypes):
        missing = records - sizes[c]
        share = [_hundredths(n, records) for n in (sizes[c], missing)]
        numbers = (
            [seen[f"_{m}_{i}"] for m in ("min", "max", "mean")] + list(spread[c] or [None] * len(QUANTILES))
            if c in numeric else [None] * (3 + len(QUANTILES))
        )
        rows.append(
            (c, type_name, "numeric" if c in numeric else "text", records, distinct[c] + (missing > 0),
             sizes[c], share[0], missing, share[1], *numbers)
        )
    # One row per column of the table.
    return df.sparkSession.createDataFrame(rows, REPORT_SCHEMA)


def _hundredths(part: int, whole: int) -> float | None:
    return ((200 * part + whole) // (2 * whole)) / 100.0 if whole else None


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None, limits: Limits = LIMITS) -> DataFrame:
    """Five-number summary, mean and missing values per numeric column."""
    columns = numeric_columns(df) if columns is None else list(columns)
    seen = df.agg(
        F.count(F.lit(1)).alias("_records"),
        *[F.avg(F.col(c).cast("double")).alias(f"_mean_{i}") for i, c in enumerate(columns)],
        *[F.count(F.col(c)).alias(f"_available_{i}") for i, c in enumerate(columns)],
        *[F.approx_count_distinct(c, 0.03).alias(f"_distinct_{i}") for i, c in enumerate(columns)],
    ).first()
    sizes, distinct = ({c: seen[f"_{n}_{i}"] for i, c in enumerate(columns)} for n in ("available", "distinct"))
    five = rank.quantile_values(df, columns, [0.0, 0.25, 0.5, 0.75, 1.0], sizes, limits, distinct)
    rows = [(c, *five[c], seen[f"_mean_{i}"], seen["_records"] - sizes[c]) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(
        rows, "var_name string, min double, q1 double, median double, q3 double, max double, mean double, missing bigint"
    )


def category_summary(df: DataFrame, columns: Sequence[str], top: int = 6) -> DataFrame:
    """Most frequent levels per column, the rest pooled as ``(Other)``; NULLs as NULL.

    The rank limit is applied inside each task before rows are brought together per column.
    """
    narrow = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    counts = (
        narrow.unpivot([], list(columns), "var_name", "level").groupBy("var_name", "level")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    known = counts.where(F.col("level").isNotNull())
    w = Window.partitionBy("var_name").orderBy(F.desc("rows"), F.asc("level"))
    best = known.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).drop("place")
    everything = counts.groupBy("var_name").agg(
        F.sum(F.when(F.col("level").isNotNull(), F.col("rows"))).alias("known"),
        F.sum(F.when(F.col("level").isNull(), F.col("rows"))).alias("missing"),
    )
    shown = best.groupBy("var_name").agg(F.sum("rows").alias("shown"))
    sums = everything.join(F.broadcast(shown), "var_name", "left")
    other = sums.select(
        "var_name", F.lit("(Other)").alias("level"), (F.col("known") - F.col("shown")).alias("rows")
    ).where(F.col("rows") > 0)
    missing = sums.select("var_name", F.lit(None).cast("string").alias("level"), F.col("missing").alias("rows"))
    return best.unionByName(other).unionByName(missing.where(F.col("rows") > 0))


def summarise(df: DataFrame, top: int = 6, limits: Limits = LIMITS) -> DataFrame:
    """Summary of every column in long form: ``var_name``, ``item``, ``level``, ``value``.

    Anything but numbers is summarised by its most frequent levels, written as text.
    """
    numeric = numeric_columns(df)
    text = [c for c in df.columns if c not in numeric]
    parts = []
    if numeric:
        table = numeric_summary(df, numeric, limits).withColumn("missing", F.col("missing").cast("double"))
        items = ["min", "q1", "median", "mean", "q3", "max", "missing"]
        parts.append(
            table.unpivot(["var_name"], items, "item", "value")
            .select("var_name", "item", F.lit(None).cast("string").alias("level"), "value")
        )
    if text:
        parts.append(
            category_summary(df, text, top).select(
                "var_name", F.when(F.col("level").isNull(), "missing").otherwise("level").alias("item"), "level",
                F.col("rows").cast("double").alias("value"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def freq(df: DataFrame, column: str) -> DataFrame:
    """Rows per level, NULL left out.

    NULL is left out after counting: a filter on the level would move down to the rows and
    evaluate the expression behind the level a second time.
    """
    return df.groupBy(column).agg(F.count(F.col(column)).alias("rows")).where(F.col("rows") > 0)


def class_share(df: DataFrame, event: str) -> DataFrame:
    """Rows and share of each class of the event."""
    counts = freq(df, event)
    # The window sees one row per class.
    return counts.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy(F.lit(1))))


def distinct_levels(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def crosstab(df: DataFrame, rows: str, columns: str, levels: Sequence | None = None) -> DataFrame:
    """Two-way table of counts without NULLs; ``levels`` fixes the columns and saves a job."""
    known = F.col(rows).isNotNull() & F.col(columns).isNotNull()
    counts = df.groupBy(rows, columns).agg(F.count_if(known).alias("_n")).where(F.col("_n") > 0)
    wide = counts.groupBy(rows).pivot(columns, None if levels is None else list(levels)).agg(F.sum("_n"))
    return wide.na.fill(0)


def _corr_pairs(
    df: DataFrame, columns: Sequence[str], values: Sequence[Column], pairs: Sequence[tuple[int, int]]
) -> DataFrame:
    """The correlations of few columns as one aggregate."""
    # Variances over the rows of the pair; a constant column has no correlation.
    spread = [
        F.var_pop(F.when(values[j].isNotNull(), values[i])) * F.var_pop(F.when(values[i].isNotNull(), values[j])) for i, j in pairs
    ]
    found = [F.when(s > 0, F.covar_pop(values[i], values[j]) / F.sqrt(s)) for s, (i, j) in zip(spread, pairs)]
    shared = [F.count(F.when(values[j].isNotNull(), values[i])) > 1 for i, j in pairs]
    row = df.agg(
        *[f.alias(f"c{k}") for k, f in enumerate(found)], *[s.alias(f"s{k}") for k, s in enumerate(shared)]
    ).first()
    out = [(c, c, 1.0) for c in columns]
    for k, (i, j) in enumerate(pairs):
        if row[f"s{k}"]:
            corr = row[f"c{k}"]
            corr = None if corr is None or math.isnan(corr) else corr
            out += [(columns[i], columns[j], corr), (columns[j], columns[i], corr)]
    return df.sparkSession.createDataFrame(out, "var_1 string, var_2 string, corr double")


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair, in long form, over the rows in which both values are present.

    Each task sums the moments of all pairs of its rows by matrix products; values are first moved by their
    column's mean, so that large offsets cost no digits.
    """
    columns = list(columns)
    values = [F.col(c).cast("double") for c in columns]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i)]
    if len(pairs) <= PAIRS_AT_ONCE:
        return _corr_pairs(df, columns, values, pairs)
    means = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(values)]).first()
    centred = df.select(*[(v - F.lit(float(m or 0.0))).alias(f"v{i}") for i, (v, m) in enumerate(zip(values, means))])
    width = len(columns)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, x, xx, xy = (np.zeros((width, width)) for _ in range(4))
        for batch in batches:
            raw = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            there = (~np.isnan(raw)).astype(float)
            filled = np.nan_to_num(raw, nan=0.0) * there
            n += there.T @ there
            x += filled.T @ there
            xx += (filled**2).T @ there
            xy += filled.T @ filled
        i, j = np.indices((width, width)).reshape(2, -1)
        parts = [n, x, x.T, xx, xx.T, xy]
        yield pa.RecordBatch.from_arrays(
            [pa.array(i), pa.array(j), *[pa.array(np.ascontiguousarray(p).ravel()) for p in parts]],
            ["i", "j", "n", "x", "y", "xx", "yy", "xy"],
        )

    kinds = "i bigint, j bigint, n double, x double, y double, xx double, yy double, xy double"
    sums = centred.mapInArrow(moments, kinds).groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")]
    )
    n = F.col("n")
    cross = F.col("xy") - F.col("x") * F.col("y") / n
    spread = (F.col("xx") - F.col("x") * F.col("x") / n) * (F.col("yy") - F.col("y") * F.col("y") / n)
    corr = F.when(F.col("i") == F.col("j"), F.lit(1.0)).when(spread > 0, cross / F.sqrt(spread))
    names = F.array(*[F.lit(c) for c in columns])
    found = sums.where((n > 1) | (F.col("i") == F.col("j")))
    return found.select(
        F.get(names, F.col("i").cast("int")).alias("var_1"), F.get(names, F.col("j").cast("int")).alias("var_2"),
        corr.alias("corr"),
    )


# --- dropping weak columns -------------------------------------------------------------


def sparse_columns(report: DataFrame, cutoff: float = 0.25) -> list[str]:
    return [r["var_name"] for r in report.where(F.col("missing_pct") > cutoff).select("var_name").collect()]


def drop_sparse(df: DataFrame, report: DataFrame, cutoff: float = 0.25) -> DataFrame:
    """Drop columns whose missing share, as rounded in the report, exceeds the cutoff."""
    return df.drop(*sparse_columns(report, cutoff))


def missing_shares(df: DataFrame) -> DataFrame:
    """The part of the quality report that ``drop_sparse`` needs, from one scan."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_records"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    ).unpivot(["_records"], df.columns, "var_name", "missing")
    return counts.select("var_name", "missing", units_to_rate(rate_units("missing", "_records", 2), 2).alias("missing_pct"))


def high_cardinality_columns(
    df: DataFrame, columns: Sequence[str], fraction: float = 0.3, keep: Sequence[str] = ()
) -> list[str]:
    """Columns with more distinct values (NULL is one) than ``fraction`` of the rows.

    A sketch with one percent error settles the clear cases in one scan; only columns within
    a fifth of the limit, twenty standard errors, are counted exactly.
    """
    wanted = [c for c in columns if c not in keep]
    if not wanted:
        return []
    seen = df.agg(
        F.count(F.lit(1)).alias("_records"),
        *[(F.approx_count_distinct(c, 0.01) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in wanted],
        *[F.max(F.col(c).isNull().cast("int")).alias(f"_null_{i}") for i, c in enumerate(wanted)],
    ).first()
    bound = fraction * seen["_records"]
    if not seen["_records"]:
        return []
    unsure = [c for c in wanted if bound < 1000 or 0.8 * bound <= seen[c] <= 1.2 * bound]
    exact = distinct_counts(df, unsure) if unsure else {}
    levels = {c: exact[c] + seen[f"_null_{i}"] if c in exact else seen[c] for i, c in enumerate(wanted)}
    return [c for c in wanted if levels[c] > bound]


def drop_high_cardinality(
    df: DataFrame, columns: Sequence[str], fraction: float = 0.3, keep: Sequence[str] = ()
) -> DataFrame:
    return df.drop(*high_cardinality_columns(df, columns, fraction, keep))


def constant_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with one level at most, found from minimum and maximum without a shuffle."""
    if not columns:
        return []
    row = df.agg(*[F.min(c).eqNullSafe(F.max(c)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if row[f"c{i}"]]


def drop_constant(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*constant_columns(df, columns))
