"""The three stages of an event-rate study, strung together from the operators.

Every stage takes names and limits as arguments, so it fits any table with a yes/no outcome.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventrate.operators import bins, clean, evaluate, levels, model, profile, segment
from eventrate.runtime import LIMITS, Limits, materialise


class Prepared(NamedTuple):
    data: DataFrame
    report: DataFrame
    variables: clean.Variables
    dropped: list[str]


class Numeric(NamedTuple):
    data: DataFrame
    bin_table: DataFrame


class Study(NamedTuple):
    model: model.LogitModel
    train: DataFrame
    test: DataFrame
    cells: DataFrame
    area: DataFrame
    pairs: DataFrame


def prepare_records(
    raw: DataFrame,
    target: str,
    positive: Any,
    key: str,
    event: str = "event",
    spellings: Mapping[str, Mapping[str, str]] | None = None,
    bad_values: Mapping[str, Sequence[Any]] | None = None,
    implausible: Mapping[str, Column] | None = None,
    sparse_cutoff: float = 0.25,
    cardinality: float = 0.3,
    limits: Limits = LIMITS,
) -> Prepared:
    """Clean records, profile them, and drop columns too sparse or too fine to use.

    ``target`` is a pattern for the outcome column; rows without outcome are left out.  Columns that are
    neither categories nor numbers, as dates, are kept behind those.  The cleaned rows are stored
    once, since the report and the screening read them several times.
    """
    df = clean.rename_matching(raw, target, event)
    for column, mapping in (spellings or {}).items():
        df = clean.canonicalise(df, event if column == target else column, mapping)
    df = clean.encode_event(clean.require_target(df, event), event, positive)
    for column, values in (bad_values or {}).items():
        df = clean.null_values(df, column, values)
    for column, condition in (implausible or {}).items():
        df = clean.null_where(df, column, condition)
    df = materialise(df, "records")
    report = profile.quality_report(df, limits=limits)
    sparse = [c for c in profile.sparse_columns(report, sparse_cutoff) if c not in (event, key)]
    df = df.drop(*sparse)
    variables = clean.split_variables(df, exclude=[event])
    fine = profile.high_cardinality_columns(df, variables.categorical, cardinality, keep=[key])
    df = df.drop(*fine)
    kept = clean.Variables([c for c in variables.categorical if c not in fine and c != key],
                           [c for c in variables.numeric if c != key], [c for c in variables.other if c != key])
    df = df.select(key, event, *kept.categorical, *kept.numeric, *kept.other)
    return Prepared(df, report, kept, sparse + fine)


def prepare_numeric(
    df: DataFrame, event: str, columns: Sequence[str], key: str, bins_wanted: int = 10, limits: Limits = LIMITS
) -> Numeric:
    """Event rate per bin, NULLs filled by nearest rate, outliers pulled to the whiskers."""
    table = bins.bin_event_table(df, event, columns, bins_wanted, key=key, limits=limits)
    filled = bins.impute_null_by_bin(df, table)
    return Numeric(bins.winsorise(filled, columns, limits=limits), table)


def reduce_categories(
    df: DataFrame, event: str, columns: Sequence[str], limits: Limits = LIMITS
) -> levels.Reduced:
    """Few levels per category, merged by event rate."""
    return levels.reduce_levels(df, event, columns, limits=limits)


def study(
    df: DataFrame, event: str, key: str, terms: Sequence[str], fraction: float = 0.7, seed: int = 100,
    limits: Limits = LIMITS,
) -> Study:
    """Split, fit, score both parts, classify at the event share and evaluate on the test part."""
    parts = model.split_sample(df, key, fraction, seed, limits)
    fit = model.fit_logit(parts.train, event, terms)
    share = df.agg(F.avg(event).alias("share")).first()["share"]
    train, test = (
        evaluate.classify(model.score(fit, part, "probability"), "probability", share) for part in parts
    )
    return Study(
        fit, train, test, evaluate.confusion(test, "predicted", event),
        evaluate.auc(test, "probability", event, limits), evaluate.concordance(test, "probability", event, limits),
    )


def targets(
    scored: DataFrame, value: str, key: str, predicted: str = "predicted", tiles: int = 10, keep: int = 2,
    limits: Limits = LIMITS,
) -> DataFrame:
    """Keys with the highest predicted class times value, for a budget of ``keep / tiles``."""
    weighted = scored.withColumn("weighted", F.col(predicted) * F.col(value))
    return segment.budget_target(weighted, "weighted", key, tiles, keep, limits=limits)
