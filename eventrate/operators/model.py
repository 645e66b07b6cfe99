"""Train/test split, logistic regression and stepwise selection.

Fits are Newton steps, each one pass over the rows: every task forms the feature matrix batch by batch and sums the moments
of its rows.  Several fits that do not wait for each other share their passes.  Rows with equal features are
summed inside each task and kept; no row is shuffled.  What reaches the driver are coefficients, levels of categories
and p x p moments.
"""

from __future__ import annotations

import math
import re
from collections.abc import Generator, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from fractions import Fraction
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from eventrate.functions import expressions as X
from eventrate.functions import tails
from eventrate.operators import rank
from eventrate.runtime import LIMITS, Limits, ship

EVENTS, WEIGHT = "_events", "_weight"
MAX_FEATURES = 4096  # moments are p x p numbers
MATRIX_CELLS = 1 << 21  # rows x features that a task holds at a time
HELD_ROWS = 200_000  # rows that a task looks through for equal ones
MAX_STEPS = 25


class Split(NamedTuple):
    train: DataFrame
    test: DataFrame


def split_sample(
    df: DataFrame, key: Sequence[str] | str, fraction: float = 0.7, seed: int = 100, limits: Limits = LIMITS
) -> Split:
    """Exactly ``floor(fraction * rows)`` rows to train, the rest to test.

    Rows are taken in the order of a hash of key and seed.  Only the hash at the border is
    looked up, so both parts are plain filters and do not depend on partitioning.
    """
    key = [key] if isinstance(key, str) else list(key)
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
    hashed = df.withColumn("_hash", digest)
    take = lambda _, n: [t] if (t := math.floor(Fraction(str(fraction)) * n)) else []
    cuts, _ = rank.order_statistics(hashed, ["_hash"], take, key, limits=limits)
    if not cuts["_hash"]:
        return Split(df.where(F.lit(False)), df)
    (border,) = cuts["_hash"].values()
    rank.require_distinct([border], key)
    inside = rank._before([F.col("_hash"), *[F.col(k) for k in key]], border.values, or_same=True)
    return Split(hashed.where(inside).drop("_hash"), hashed.where(~inside).drop("_hash"))


# --- logistic regression ---------------------------------------------------------------


@dataclass(frozen=True)
class LogitModel:
    """A fitted model: the fitted numbers, and how each of them belongs to a term and a level."""

    event: str
    terms: tuple[str, ...]
    names: tuple[str, ...]
    aliased: tuple[str, ...]
    estimates: tuple[float, ...]
    errors: tuple[float, ...]
    null_deviance: float
    deviance: float
    null_df: int
    residual_df: int
    aic: float
    session: Any
    parts: tuple[tuple[str, str | None], ...] = ()  # term and level (None for a number) of each name
    levels: Mapping[str, tuple[str, ...]] = field(default_factory=dict)  # all levels of each category


@dataclass(frozen=True)
class _Design:
    """Rows to fit on, and how their features are made: every feature less its centre, per its scale."""

    data: DataFrame
    names: list[str]
    parts: list[tuple[str, str | None]]
    levels: dict[str, tuple[str, ...]]
    centre: np.ndarray
    scale: np.ndarray
    usable: list[int]
    rows: int
    events: float

    def release(self) -> None:
        self.data.unpersist()


def merged_rows(df: DataFrame, event: str, terms: Sequence[str], complete: bool = True) -> DataFrame:
    """Rows with equal features as one row with numbers of events and rows, cached.

    Rows with any NULL are left out, or, unless ``complete``, those without the event or without any feature.

    The likelihood is the same up to a constant.  The input is read once, and equal rows are summed before the
    shuffle, so categories and coarse numbers move little data.
    """
    rows = df.select(F.col(event).cast("double").alias(EVENTS), *terms)
    rows = rows.dropna() if complete else rows.dropna(subset=[EVENTS]).dropna("all", subset=list(terms))
    merged = rows.groupBy(*terms).agg(F.sum(EVENTS).alias(EVENTS), F.count(F.lit(1)).cast("double").alias(WEIGHT))
    return merged.persist(StorageLevel.MEMORY_AND_DISK)


def category_levels(merged: DataFrame, terms: Sequence[str], numbers: int = 0) -> dict[str, tuple[str, ...]]:
    """Levels of the text terms, in order; an error if they make too many features in all."""
    text = [t for t, kind in merged.select(*terms).dtypes if kind == "string"]
    if not text:
        return {}
    seen = merged.agg(*[F.count_distinct(c).alias(f"n{i}") for i, c in enumerate(text)]).first()
    # Level names go to the driver and become features, so their number is checked first.
    if sum(seen) - len(text) + numbers > MAX_FEATURES:
        sizes = dict(zip(text, seen))
        raise ValueError(f"more than {MAX_FEATURES} features from the levels {sizes}; merge levels with reduce_levels first")
    sets = merged.agg(*[F.sort_array(F.collect_set(c)).alias(f"s{i}") for i, c in enumerate(text)]).first()
    return {c: tuple(levels) for c, levels in zip(text, sets)}


def _combined(rows: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Rows of a task with equal terms as one row with their sums; without a shuffle, as long as it makes fewer of them."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size, useful = 0, True

        def summed() -> pa.Table:
            table = pa.concat_tables(held).group_by(list(terms), use_threads=False).aggregate([(EVENTS, "sum"), (WEIGHT, "sum")])
            table = table.rename_columns([c.removesuffix("_sum") for c in table.column_names]).select(names)
            # Sums may be NULL for Arrow; batches that follow say that the columns are not.
            return pa.Table.from_arrays(table.columns, schema=held[0].schema)

        for batch in batches:
            if not useful:
                yield batch
                continue
            held.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            if size > HELD_ROWS:
                held = [summed()]
                useful = len(held[0]) * 2 <= size
                size = len(held[0])
                if not useful:
                    yield from held[0].to_batches()
                    held = []
        if held:
            yield from summed().to_batches()

    return rows.mapInArrow(run, rows.schema)


def _design(df: DataFrame, event: str, terms: Sequence[str]) -> _Design:
    """Keep the complete rows, summed where equal; categories get dummies against their first level."""
    ship(df.sparkSession)
    text = {t for t, kind in df.select(*terms).dtypes if kind == "string"}
    rows = df.select(
        F.col(event).cast("double").alias(EVENTS), *[F.col(t) if t in text else F.col(t).cast("double").alias(t) for t in terms]
    ).dropna().withColumn(WEIGHT, F.lit(1.0))
    data = _combined(rows, terms).persist(StorageLevel.MEMORY_AND_DISK)
    numbers = [t for t in terms if t not in text]
    w = F.col(WEIGHT)
    seen = data.agg(
        F.sum(w).alias("n"), F.sum(EVENTS).alias("e"),
        *[f.alias(f"{k}{i}") for i, t in enumerate(numbers) for k, f in (
            ("s", F.sum(F.col(t) * w)), ("l", F.min(t)), ("h", F.max(t)))],
    ).first()
    if not seen["n"]:
        data.unpersist()
        raise ValueError("no row without NULL is left")
    levels = category_levels(data, terms, len(numbers))
    names, parts, centre, scale = [], [], [], []
    for t in terms:
        if t in text:
            for level in levels[t][1:]:
                names.append(f"{t}_{level}")
                parts.append((t, level))
                centre.append(0.0)
                scale.append(1.0)
        else:
            i = numbers.index(t)
            spread = seen[f"h{i}"] - seen[f"l{i}"]
            names.append(t)
            parts.append((t, None))
            centre.append(seen[f"s{i}"] / seen["n"])
            scale.append(spread if spread > 0 and math.isfinite(spread) else 1.0)
    design = _Design(data, names, parts, levels, np.array(centre), np.array(scale), [], int(seen["n"]), float(seen["e"]))
    if names:
        design.usable.extend(_independent(design))
    return design


def _independent(design: _Design, tolerance: float = 1e-9) -> list[int]:
    """Features that are neither constant nor a combination of earlier ones.

    Builds the Cholesky factor of their correlations from left to right; a feature with nothing left after the
    earlier ones is left out.
    """
    every = tuple(range(len(design.names) + 1))
    (found,) = _moments(design, [_Problem(every, np.zeros(len(every)))])
    cross = found.information * 4.0 / design.rows  # at coefficients of 0 all weights are a quarter
    cov = cross[1:, 1:] - np.outer(cross[0, 1:], cross[0, 1:])
    variance = np.diag(cov).copy()
    varied = variance > 1e-12
    spread = np.sqrt(np.where(varied, variance, 1.0))
    corr = np.where(np.outer(varied, varied), cov / np.outer(spread, spread), 0.0)
    factor = np.zeros((len(corr), 0))
    usable = []
    for j in np.flatnonzero(varied):
        rest = corr[:, j] - factor @ factor[j]
        if rest[j] > tolerance:
            usable.append(int(j))
            factor = np.column_stack([factor, rest / math.sqrt(rest[j])])
    return usable


# --- passes ----------------------------------------------------------------------------


@dataclass(frozen=True)
class _Problem:
    """A fit: the free columns (0 is the intercept, i + 1 feature i), where they stand, and a held coefficient.

    With the intercept free, features are less their centre; that moves the intercept only.
    ``reach`` asks for the longest row of the matrix times it.
    """

    columns: tuple[int, ...]
    at: np.ndarray
    held: tuple[int, float] | None = None
    reach: np.ndarray | None = None


class _Moments(NamedTuple):
    deviance: float
    slope: np.ndarray
    information: np.ndarray
    reach: float


def _moments(design: _Design, problems: Sequence[_Problem]) -> list[_Moments]:
    """Deviance, slope and information of every problem where it stands, in one pass."""
    terms = [c for c in design.data.columns if c not in (EVENTS, WEIGHT)]
    levels = [design.levels.get(t) for t in terms]
    places = {part: i for i, part in enumerate(design.parts)}
    numbers = [None if known is not None else places[t, None] for t, known in zip(terms, levels)]
    dummies = [None if known is None else [places[t, x] for x in known[1:]] for t, known in zip(terms, levels)]
    width, centre, scale = len(design.names), design.centre, design.scale

    def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        step = max(1, MATRIX_CELLS // (width + 1))
        for first in range(0, batch.num_rows, step):
            part = batch.slice(first, step)
            plain = np.zeros((part.num_rows, width + 1))
            plain[:, 0] = 1.0
            for t, known, number, places_of in zip(terms, levels, numbers, dummies):
                column = part.column(part.schema.get_field_index(t))
                if known is None:
                    plain[:, number + 1] = np.asarray(column) / scale[number]
                elif places_of:
                    code = np.asarray(pc.index_in(column, pa.array(known, column.type)))
                    some = np.flatnonzero(code > 0)
                    plain[some, np.array(places_of)[code[some] - 1] + 1] = 1.0
            yield plain, *(np.asarray(part.column(part.schema.get_field_index(c))) for c in (EVENTS, WEIGHT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(1 + len(q.columns) + len(q.columns) ** 2) for q in problems]
        reach = np.zeros(len(problems))
        shift = np.append(0.0, centre / scale)
        for batch in batches:
            for plain, e, n in matrices(batch):
                centred = plain - shift
                for i, q in enumerate(problems):
                    full = centred if 0 in q.columns else plain
                    own = full[:, list(q.columns)]
                    eta = own @ q.at
                    if q.held:
                        k, value = q.held
                        eta = eta + value * (full[:, k] * scale[k - 1] if k else 1.0)
                    p = 1.0 / (1.0 + np.exp(-np.clip(eta, -700.0, 700.0)))
                    size = len(q.columns)
                    sums[i][0] += 2.0 * np.sum(n * np.logaddexp(0.0, eta) - e * eta)
                    sums[i][1:1 + size] += own.T @ (e - n * p)
                    sums[i][1 + size:] += (own.T @ (own * (n * p * (1.0 - p))[:, None])).ravel()
                    if q.reach is not None and len(own):
                        reach[i] = max(reach[i], float(np.max(np.sum((own @ q.reach) ** 2, axis=1))))
        cells = [np.append(x, r) for x, r in zip(sums, reach)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(cells)), [len(c) for c in cells])),
             pa.array(np.concatenate([np.arange(len(c)) for c in cells])), pa.array(np.concatenate(cells))],
            ["problem", "cell", "value"],
        )

    summed = design.data.mapInArrow(run, "problem bigint, cell bigint, value double").groupBy("problem", "cell").agg(
        F.sum("value").alias("total"), F.max("value").alias("most")
    )
    table = summed.toArrow()
    problem, cell, total, most = (np.asarray(table[c]) for c in ("problem", "cell", "total", "most"))
    out = []
    for i, q in enumerate(problems):
        size = len(q.columns)
        flat = np.zeros(2 + size + size**2)
        mine = problem == i
        flat[cell[mine]] = total[mine]
        longest = most[mine & (cell == len(flat) - 1)]
        out.append(_Moments(
            float(flat[0]), flat[1:1 + size], flat[1 + size:-1].reshape(size, size), math.sqrt(longest[0]) if len(longest) else 0.0
        ))
    return out


class _Solved(NamedTuple):
    columns: tuple[int, ...]
    at: np.ndarray
    deviance: float
    information: np.ndarray


def _solve(design: _Design, problems: Sequence[_Problem]) -> list[_Solved]:
    """Newton's method for all problems side by side; a step that raises the deviance is halved."""
    at = [q.at for q in problems]
    before: list[tuple[np.ndarray, float] | None] = [None] * len(problems)
    done: dict[int, _Solved] = {}
    steps, halved = [0] * len(problems), [0] * len(problems)
    while len(done) < len(problems):
        active = [i for i in range(len(problems)) if i not in done]
        found = _moments(design, [_Problem(problems[i].columns, at[i], problems[i].held) for i in active])
        for i, m in zip(active, found):
            columns = problems[i].columns
            last = before[i]
            if last and not m.deviance <= last[1] + 1e-9 * (1.0 + abs(last[1])) and halved[i] < 30:
                at[i] = (at[i] + last[0]) / 2.0
                halved[i] += 1
                continue
            step = _divided(m.information, m.slope)
            still = last is not None and abs(m.deviance - last[1]) <= 1e-12 * (abs(m.deviance) + 0.1)
            if not len(columns) or m.slope @ step < 1e-12 or still or steps[i] == MAX_STEPS:
                done[i] = _Solved(columns, at[i], m.deviance, m.information)
                continue
            before[i], at[i] = (at[i], m.deviance), at[i] + step
            steps[i], halved[i] = steps[i] + 1, 0
    return [done[i] for i in range(len(problems))]


def _divided(information: np.ndarray, slope: np.ndarray) -> np.ndarray:
    if not len(slope):
        return slope
    try:
        found = np.linalg.solve(information, slope)
        if np.isfinite(found).all():
            return found
    except np.linalg.LinAlgError:
        pass
    return np.linalg.lstsq(information, slope, rcond=1e-12)[0]


def _terms(df: DataFrame, event: str, features: Sequence[str] | None, exclude: Sequence[str]) -> list[str]:
    found = [c for c in (features or df.columns) if c != event and c not in exclude]
    if not found:
        raise ValueError("no feature left")
    return found


def formula_terms(formula: str, columns: Sequence[str]) -> tuple[str, list[str]]:
    """Target and terms of ``y ~ a + b - c`` or ``y ~ .``."""
    left, _, right = formula.partition("~")
    event, terms = left.strip(), []
    for sign, name in re.findall(r"([+-]?)\s*([A-Za-z_.][A-Za-z0-9_.]*)", right):
        named = [c for c in columns if c != event] if name == "." else [name]
        terms = [t for t in terms if t not in named] if sign == "-" else terms + [t for t in named if t not in terms]
    return event, terms


def fit_logit(
    df: DataFrame, event: str | None = None, features: Sequence[str] | None = None,
    exclude: Sequence[str] = (), formula: str | None = None,
) -> LogitModel:
    """Logistic regression of a 0/1 event, on the given features, a formula, or all columns.

    Rows with NULLs are left out.  Constant and linearly dependent features get no estimate.
    """
    if formula:
        event, features = formula_terms(formula, df.columns)
    terms = _terms(df, event, features, exclude)
    design = _design(df, event, terms)
    try:
        if not design.usable:
            return _constant(design, event, terms, df.sparkSession)
        return _logit(design, event, terms, design.usable, df.sparkSession)
    finally:
        design.release()


def _aliased(design: _Design, terms: Sequence[str], use: Sequence[int]) -> tuple[str, ...]:
    used = set(use)
    return tuple(n for i, (n, (t, _)) in enumerate(zip(design.names, design.parts)) if i not in used and t in terms)


def _problem(use: Sequence[int], start: np.ndarray | None = None) -> _Problem:
    return _Problem((0, *(i + 1 for i in use)), np.zeros(len(use) + 1) if start is None else start)


def _logit(design: _Design, event: str, terms: Sequence[str], use: Sequence[int], session, solved: _Solved | None = None) -> LogitModel:
    if solved is None:
        (solved,) = _solve(design, [_problem(use)])
    centre, scale = design.centre[list(use)], design.scale[list(use)]
    # Back to the features as they are: the centres move into the intercept.
    back = np.diag(np.append(1.0, 1.0 / scale))
    back[0, 1:] = -centre / scale
    cov = back @ np.linalg.pinv(solved.information, rcond=1e-14, hermitian=True) @ back.T
    found = back @ solved.at
    return LogitModel(
        event=event, terms=tuple(terms), names=tuple(design.names[i] for i in use),
        aliased=_aliased(design, terms, use), estimates=tuple(found.tolist()),
        errors=tuple(np.sqrt(np.maximum(np.diag(cov), 0.0)).tolist()),
        null_deviance=_null_deviance(design.events, design.rows), deviance=solved.deviance,
        null_df=design.rows - 1, residual_df=design.rows - 1 - len(use),
        # For a 0/1 outcome the deviance is minus twice the log likelihood.
        aic=solved.deviance + 2.0 * (len(use) + 1), session=session,
        parts=tuple(design.parts[i] for i in use), levels={t: v for t, v in design.levels.items() if t in terms},
    )


def _null_deviance(ones: float, rows: int) -> float:
    return -2.0 * sum(n * math.log(n / rows) for n in (ones, rows - ones) if n)


def _constant(design: _Design, event: str, terms: Sequence[str], session) -> LogitModel:
    """Model of the intercept alone, which needs no solver."""
    ones = design.events
    share, deviance = ones / design.rows, _null_deviance(ones, design.rows)
    odds = math.log(share / (1.0 - share)) if 0.0 < share < 1.0 else math.copysign(math.inf, share - 0.5)
    spread = design.rows * share * (1.0 - share)
    return LogitModel(
        event=event, terms=tuple(terms), names=(), aliased=_aliased(design, terms, ()),
        estimates=(odds,), errors=(1.0 / math.sqrt(spread) if spread else math.inf,),
        null_deviance=deviance, deviance=deviance, null_df=design.rows - 1, residual_df=design.rows - 1,
        aic=deviance + 2.0, session=session, levels={t: v for t, v in design.levels.items() if t in terms},
    )


def coef_table(model: LogitModel) -> DataFrame:
    """Estimate, standard error, z and p per coefficient; dependent features without numbers."""
    rows = []
    for name, est, se in zip(("(Intercept)", *model.names), model.estimates, model.errors):
        z = est / se
        rows.append((name, est, se, z, tails.normal_two_sided(z)))
    rows += [(name, None, None, None, None) for name in model.aliased]
    return model.session.createDataFrame(
        rows, "term string, estimate double, std_error double, z double, p_value double"
    )


def fit_summary(model: LogitModel) -> DataFrame:
    """Deviances, degrees of freedom and AIC."""
    return model.session.createDataFrame(
        [(model.null_deviance, model.null_df, model.deviance, model.residual_df, model.aic)],
        "null_deviance double, null_df bigint, deviance double, residual_df bigint, aic double",
    )


def deviance_test(model: LogitModel) -> DataFrame:
    """Chi-square test of the model against the constant model."""
    chi, df = model.null_deviance - model.deviance, model.null_df - model.residual_df
    p = tails.chi_square_upper(chi, df) if df else None
    return model.session.createDataFrame([(chi, df, p)], "chi_square double, df bigint, p_value double")


def conf_int(model: LogitModel, level: float = 0.95, df: DataFrame | None = None, method: str = "wald") -> DataFrame:
    """Confidence interval per coefficient.

    ``wald`` is estimate +/- quantile * error.  ``profile`` needs the training data and refits
    with each coefficient held fixed until the deviance has risen by the chi-square quantile.
    """
    q = tails.normal_quantile(0.5 + level / 2)
    names = ("(Intercept)", *model.names)
    if method == "wald":
        rows = [(n, e - q * s, e + q * s) for n, e, s in zip(names, model.estimates, model.errors)]
    elif method == "profile":
        if df is None:
            raise ValueError("profile intervals need the training data")
        rows = _profile(model, df, q, names)
    else:
        raise ValueError(f"unknown method {method!r}")
    return model.session.createDataFrame(rows, "term string, low double, high double")


def _profile(model: LogitModel, df: DataFrame, q: float, names: Sequence[str]) -> list[tuple]:
    """All ends at once: in every round, each open end asks for one deviance, and all are found in shared passes."""
    design = _design(df, model.event, model.terms)
    try:
        use = [design.names.index(n) + 1 for n in model.names]
        searches = [_profile_end(model, k, sign * q) for k in range(len(names)) for sign in (-1.0, 1.0)]
        columns = [tuple(c for c in (0, *use) if c != (0, *use)[k]) for k in range(len(names)) for _ in (-1.0, 1.0)]
        ends: list[float | None] = [None] * len(searches)
        asked: dict[int, float] = {}
        # Each fit starts from the last one of its end.
        start = [np.zeros(len(c)) for c in columns]

        def advance(i: int, deviance: float | None) -> None:
            try:
                asked[i] = searches[i].send(deviance)
            except StopIteration as end:
                asked.pop(i, None)
                ends[i] = end.value

        for i in range(len(searches)):
            advance(i, None)
        while asked:
            order = list(asked)
            solved = _solve(design, [_Problem(columns[i], start[i], ((0, *use)[i // 2], asked[i])) for i in order])
            for i, found in zip(order, solved):
                start[i] = found.at
                advance(i, found.deviance)
        return [(name, *ends[2 * k:2 * k + 2]) for k, name in enumerate(names)]
    finally:
        design.release()


def _profile_end(model: LogitModel, k: int, goal: float) -> Generator[float, float, float | None]:
    """Value of coefficient ``k`` at which the signed root of the deviance rise equals ``goal``.

    Asks for the least deviance at values of the coefficient.  The root grows with the value, so the end is bracketed by
    doubling steps and then closed in upon by secant steps that stay inside the bracket.  None if the deviance
    never rises that far, as when the feature separates the classes.
    """
    est, se = model.estimates[k], model.errors[k]

    def excess(value: float) -> Generator[float, float, float]:
        rise = (yield value) - model.deviance
        return math.copysign(math.sqrt(max(rise, 0.0)), value - est) - goal

    if not math.isfinite(est) or not math.isfinite(se) or se <= 0:
        return None
    inner, low = est, -goal
    outer = est + goal * se
    high = yield from excess(outer)
    for _ in range(12):
        if high * goal >= 0:
            break
        inner, low = outer, high
        outer = est + 2.0 * (outer - est)
        high = yield from excess(outer)
        if abs(high - low) < 1e-6:
            return None  # flat: the deviance has a limit below the goal
    else:
        return None
    for _ in range(100):
        if abs(high) < 1e-6:
            return outer
        guess = outer - high * (outer - inner) / (high - low)
        width = abs(outer - inner)
        if width <= 1e-9 * max(1.0, abs(outer)):
            return outer
        found = yield from excess(guess)
        if abs(found) < 1e-6:
            return guess
        # Keep the bracket; if one end stays, halve its weight so that it moves as well.
        if found * goal >= 0:
            outer, high, low = guess, found, low / 2.0
        else:
            inner, low, high = guess, found, high / 2.0
    raise RuntimeError("profile interval did not converge")


def score(model: LogitModel, df: DataFrame, name: str = "probability") -> DataFrame:
    """Add the event probability of each row, as one expression over its columns.

    A row with a NULL feature, or with a level that was not there in training, gets NULL.
    """
    parts = dict(zip(model.parts, model.estimates[1:]))
    eta = F.lit(model.estimates[0])
    for term in model.terms:
        if term in model.levels:
            known = [F.lit(x) for level in model.levels[term] for x in (level, float(parts.get((term, level), 0.0)))]
            eta = eta + F.create_map(*known)[F.col(term)]
        else:
            eta = eta + F.lit(parts.get((term, None), 0.0)) * F.col(term).cast("double")
    return df.withColumn(name, X.logistic(eta))


def score_equation(
    df: DataFrame, coefficients: Mapping[str, float], intercept: float = 0.0, name: str = "probability"
) -> DataFrame:
    """Event probability from written coefficients."""
    return df.withColumn(name, X.logistic(X.linear(coefficients, intercept)))


class Selection(NamedTuple):
    model: LogitModel
    steps: DataFrame


class _Fitted(NamedTuple):
    terms: list[str]
    use: list[int]
    solved: _Solved | None  # None for the intercept alone
    deviance: float

    @property
    def aic(self) -> float:
        return self.deviance + 2.0 * (len(self.use) + 1)


def stepwise(
    df: DataFrame, event: str, features: Sequence[str] | None = None, direction: str = "backward",
    exclude: Sequence[str] = (), max_fits: int | None = None,
) -> Selection:
    """Drop or add whole terms while the AIC falls.

    ``backward`` starts with all terms, ``forward`` with the intercept alone.  A round of ``backward`` takes the information
    matrix of the current model and gives every drop a deviance that it cannot stay below; drops are fitted from the most
    promising on, until none of the others can win.  A round of ``forward`` fits all in shared passes.  ``steps``
    lists the path with the number of fits so far; the search stops with an error once ``max_fits``, if given, is passed.
    """
    terms = _terms(df, event, features, exclude)
    design = _design(df, event, terms)
    fits = 0

    def fitted(choices: Sequence[Sequence[str]], start: _Fitted | None = None) -> list[_Fitted]:
        nonlocal fits
        uses = [[i for i in design.usable if design.parts[i][0] in chosen] for chosen in choices]
        fits += sum(bool(use) for use in uses)
        if max_fits is not None and fits > max_fits:
            raise RuntimeError(f"stepwise search needs more than max_fits={max_fits} fits")
        solved = iter(_solve(design, [_problem(use, _carried(use, start)) for use in uses if use]))
        null = _null_deviance(design.events, design.rows)
        out = []
        for chosen, use in zip(choices, uses):
            one = next(solved) if use else None
            out.append(_Fitted(list(chosen), use, one, one.deviance if one else null))
        return out

    try:
        backward = direction == "backward"
        (best,) = fitted([terms if backward else []])
        path = [(0, "", None, best.aic, fits)]
        while moves := [t for t in terms if (t in best.terms) == backward]:
            if backward:
                found = _best_drop(design, best, moves, fitted)
            else:
                tried = fitted([[*best.terms, t] for t in moves])
                found = min(zip(moves, tried), key=lambda f: f[1].aic)
            if found is None or found[1].aic >= best.aic:
                break
            t, best = found
            path.append((len(path), "-" if backward else "+", t, best.aic, fits))
        session = df.sparkSession
        if best.use:
            model = _logit(design, event, best.terms, best.use, session, best.solved)
        else:
            model = _constant(design, event, best.terms, session)
    finally:
        design.release()
    steps = session.createDataFrame(
        path, "step bigint, move string, term string, aic double, fits bigint"
    )
    return Selection(model, steps)


def _carried(use: Sequence[int], start: _Fitted | None) -> np.ndarray | None:
    """Coefficients of the features that a former fit had as well."""
    if start is None or start.solved is None:
        return None
    known = dict(zip(start.solved.columns, start.solved.at))
    return np.array([known.get(c, 0.0) for c in (0, *(i + 1 for i in use))])


def _best_drop(design: _Design, current: _Fitted, moves: Sequence[str], fitted) -> tuple[str, _Fitted] | None:
    """Term whose drop has the least AIC, the first of equal ones; None if no drop can lower the AIC."""
    least = _drop_bounds(design, current, moves)
    best: tuple[str, _Fitted] | None = None
    for t in sorted(moves, key=lambda t: (least[t], moves.index(t))):
        ceiling = current.aic if best is None else best[1].aic
        if least[t] > ceiling + 1e-9 * (1.0 + abs(ceiling)):
            break
        (one,) = fitted([[c for c in current.terms if c != t]], current)
        if best is None or (one.aic, moves.index(t)) < (best[1].aic, moves.index(best[0])):
            best = t, one
    return best


def _drop_bounds(design: _Design, current: _Fitted, moves: Sequence[str]) -> dict[str, float]:
    """AIC that the model without a term cannot be below.

    Near the best coefficients the log likelihood falls as the square of the distance t measured by the information matrix;
    as its third derivative along any line is at most r times the second, where r is the longest row in that measure per unit of t,
    it falls by (exp(-rt) + rt - 1) / r**2 at least (twice that in deviance).  The nearest point without the term is at the Wald distance.
    """
    if current.solved is None:
        return {t: -math.inf for t in moves}
    columns, at = current.solved.columns, current.solved.at
    try:
        cov = np.linalg.inv(current.solved.information)
        root = np.linalg.cholesky((cov + cov.T) / 2.0)
    except np.linalg.LinAlgError:
        return {t: -math.inf for t in moves}
    (seen,) = _moments(design, [_Problem(columns, at, reach=root)])
    out = {}
    for t in moves:
        gone = [k for k, c in enumerate(columns) if c and design.parts[c - 1][0] == t]
        if not gone:
            out[t] = current.aic
            continue
        part = cov[np.ix_(gone, gone)]
        far = math.sqrt(max(0.0, float(at[gone] @ np.linalg.solve(part, at[gone]))))
        rt = seen.reach * far
        rise = far * far if rt < 1e-6 else 2.0 * (math.exp(-rt) + rt - 1.0) / seen.reach**2
        # The fit is exact to a small part of a deviance.
        out[t] = current.aic + rise * (1.0 - 1e-6) - 1e-6 - 2.0 * len(gone)
    return out
