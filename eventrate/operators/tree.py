"""Classification tree on a 0/1 event: subset splits, surrogates for missing values, pruning by cost and complexity.

The tree grows level by level.  Each level is one aggregate over the rows: counts by node, feature and bin, summed in
the tasks first.  Nodes whose wrong rows are too few for any split to be worth its complexity are not split, so a level
has fewer than ``1 / cp`` of them whatever the number of rows, and that is all the driver holds.  The trees of the
cross-validation grow in the same passes.

Numbers are cut exactly.  The gain of a cut is a convex function of the counts on its left, so the counts of a bin bound what
any cut inside it can gain; only bins whose bound beats the best cut known are looked into, finer each time.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventrate.operators.model import EVENTS, WEIGHT, _terms, category_levels, merged_rows
from eventrate.runtime import ship

DEAL = "_deal"
MAX_DEPTH = 30  # node numbers stay below 2**31
FINER = 64  # fine cuts per coarse bin, and parts that an open interval is cut into
VALUES_AT = 256  # rows of an open interval that are looked at value by value
CELLS_HELD = 200_000
SURE = 1e-12  # relative difference of gains that counts


@dataclass(frozen=True)
class Split:
    """A test of one feature: ``value <= threshold`` or the level codes ``left`` go left; ``flip`` turns it round."""

    feature: int
    score: float  # gain of a primary split, rows on the right side of a surrogate
    threshold: float | None = None
    left: frozenset[int] = frozenset()
    flip: bool = False


@dataclass
class Node:
    """A node with its counts; a leaf has no split."""

    events: int = 0
    total: int = 0
    depth: int = 0
    split: Split | None = None
    surrogates: tuple[Split, ...] = ()
    majority: bool = True  # side of rows without any value to go by: left
    present: int = 0  # rows that have the value of the split
    children: tuple[Node, ...] = ()
    complexity: float = math.inf  # rows put right per split below; the node is a leaf at this complexity and above

    @property
    def risk(self) -> int:
        """Rows on the wrong side if the node were a leaf."""
        return min(self.events, self.total - self.events)

    @property
    def predicted(self) -> int:
        return int(2 * self.events > self.total)

    def leaves(self) -> list[Node]:
        return [leaf for child in self.children for leaf in child.leaves()] or [self]

    def inner(self) -> list[Node]:
        return [self, *(n for c in self.children for n in c.inner())] if self.children else []

    def cut(self) -> None:
        self.split, self.surrogates, self.children = None, (), ()


class TreeFit(NamedTuple):
    root: Node
    rules: DataFrame
    complexity: DataFrame
    surrogates: DataFrame


def fit_tree(
    df: DataFrame, event: str, features: Sequence[str] | None = None, exclude: Sequence[str] = (),
    max_depth: int = 30, min_split: int = 20, min_rows: int = 7, cp: float = 0.01, max_bins: int = 64,
    surrogates: int = 5, folds: int = 10,
) -> TreeFit:
    """Gini tree; its leaves as SQL conditions, the table of complexities it was pruned by, and its surrogate splits.

    A category is split into two sets of levels, ordered by event rate; a number at the best of all its values, halfway to
    the next one.  Nodes under ``min_split`` rows are not split and a split leaves ``min_rows`` present values or more on
    both sides.  Splits that put right no more than ``cp`` of the root's wrong rows, on average over the splits below,
    are pruned; with ``cp`` 0 those that put nothing right are, below 0 none, and only the sizes bound the tree.  Of equal gains the earlier feature and the lower cut stay.

    Rows without the event or without any feature are left out.  A row that lacks the value of a split goes by the
    first of up to ``surrogates`` other splits whose value it has, and else to the larger side.  Surrogates are ranked by
    the rows that they send as the split does (rows without their value count against them); those no better than the
    larger side alone, or with fewer than 2 rows on a side, are dropped.  A level that a node has not seen goes to the larger side; NaN is the
    largest number.

    ``complexity`` has ``folds``-fold cross-validated errors (``xerror``, with standard error ``xstd``; NULL without
    folds).  Rows are dealt to folds by a hash of their features and, where several agree in these, in turn.
    ``max_bins`` is the number of bins of a first look at a number; it affects the time taken only.
    """
    ship(df.sparkSession)
    terms = _terms(df, event, features, exclude)
    merged = merged_rows(df, event, terms, complete=False)
    try:
        rows, events, *present = merged.agg(
            F.sum(WEIGHT), F.sum(EVENTS), *[F.sum(F.when(F.col(t).isNotNull(), F.col(WEIGHT))) for t in terms]
        ).first()
        if not rows:
            raise ValueError("no row with a feature is left")
        levels = category_levels(merged, terms)
        grower = _Grower(
            merged, terms, levels, _cuts(merged, [t for t in terms if t not in levels], max_bins), min(max_depth, MAX_DEPTH), min_split,
            min_rows, cp, surrogates if any((n or 0) < rows for n in present) else 0, folds if rows > folds else 0,
        )
        trees = grower.grow()
        root = trees[0]
        whole = root.risk
        steps = prune_order(root)
        table = _table(root, steps, cp)
        errors = grower.held_out(trees, [row[0] for row in table]) if len(trees) > 1 else None
    finally:
        merged.unpersist()
    for node in root.inner():
        if node.complexity <= cp * whole * (1 + SURE):
            node.cut()
    found = _leaf_rules(root, terms, levels)
    leaves = [
        (i, rule, leaf.predicted, leaf.events, leaf.total, leaf.events / leaf.total) for i, (rule, leaf) in enumerate(found)
    ]
    complexity = []
    for i, row in enumerate(table):
        wrong = errors[i] if errors and whole else None
        complexity.append((*row, None if wrong is None else wrong / whole,
                           None if wrong is None else math.sqrt(max(0.0, wrong - wrong * wrong / root.total)) / whole))
    spark = df.sparkSession
    return TreeFit(
        root,
        spark.createDataFrame(leaves, "leaf bigint, rule string, predicted int, events bigint, total bigint, rate double"),
        spark.createDataFrame(complexity, "cp double, splits bigint, rel_error double, xerror double, xstd double"),
        spark.createDataFrame(
            _surrogate_rows(root, terms, levels), "node bigint, split string, place int, surrogate string, agreeing bigint"
        ),
    )


def _cuts(merged: DataFrame, numbers: Sequence[str], bins: int) -> dict[str, np.ndarray]:
    """Fine cuts of each number; every ``FINER``-th is a coarse one.  They place bins only, so they may be rough."""
    if not numbers:
        return {}
    parts = max(2, bins) * FINER
    probs = [i / parts for i in range(1, parts)]
    seen = merged.agg(*[F.percentile_approx(F.col(t).cast("double"), probs, parts * 4).alias(f"c{i}") for i, t in enumerate(numbers)]).first()
    return {t: _ordered(np.array([math.nan if x is None else x for x in seen[i] or []], float)) for i, t in enumerate(numbers)}


def _ordered(values: np.ndarray) -> np.ndarray:
    """NaN as the largest number."""
    return np.where(np.isnan(values), np.inf, values)


# --- scores ----------------------------------------------------------------------------


def _purity(e: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.divide(e * e + (n - e) * (n - e), n, out=np.zeros(np.shape(n)), where=n > 0)


def gini_gain(e, n, all_e, all_n):
    """Rows times the fall of Gini impurity by a split with ``e`` events among ``n`` rows on the left."""
    e, n = np.asarray(e, float), np.asarray(n, float)
    return _purity(e, n) + _purity(all_e - e, all_n - n) - _purity(np.asarray(all_e, float), np.asarray(all_n, float))


def agreement(a, n, all_a, all_n):
    """Rows that a cut sends as another split does, ``a`` of the ``n`` on its left; the better of both directions."""
    same = 2.0 * np.asarray(a, float) - n + all_n - all_a
    return np.maximum(same, all_n - same)


class _Interval(NamedTuple):
    """Values of one feature in one node that may hold a better cut, the counts before them, and all counts."""

    feature: int
    low: float
    high: float
    base_e: float
    base_n: float
    rows: float
    all_e: float
    all_n: float
    bound: float


class _Wanted(NamedTuple):
    """What to count in a node: the cuts of an interval, no cuts for single values; all of a feature without interval."""

    feature: int
    cuts: np.ndarray | None
    interval: _Interval | None


CELL = "tree int, node int, feature int, part int, cell int, e double, n double, low double, high double"
FOUND = (
    "tree int, node int, kind string, feature int, score double, low double, high double, base_e double, base_n double, "
    "rows double, all_e double, all_n double, codes array<int>, flip boolean"
)


# --- work of a task --------------------------------------------------------------------


@dataclass
class _Rows:
    """One batch: values of every feature (codes of levels, or numbers; missing ones marked) and counts of every tree."""

    values: list[np.ndarray]
    present: list[np.ndarray]
    events: np.ndarray
    total: np.ndarray
    deal: np.ndarray
    folds: int

    def fold(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Events and rows of fold ``k``; the rows of one merged row are dealt in turn."""
        others = self.total - self.events
        mine = [
            x // self.folds + ((k - start) % self.folds < x % self.folds)
            for x, start in ((self.events, self.deal), (others, self.deal + self.events))
        ]
        return mine[0], mine[0] + mine[1]

    def counts(self, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """Events and rows that tree ``tree`` learns from: all, or all but fold ``tree - 1``."""
        if not tree:
            return self.events, self.total
        e, n = self.fold(tree - 1)
        return self.events - e, self.total - n


def _read(batch: pa.RecordBatch, levels: Sequence[tuple[str, ...] | None], folds: int) -> _Rows:
    values, present = [], []
    for column, known in zip(batch.columns, levels):
        there = np.asarray(column.is_valid())
        if known is None:
            values.append(_ordered(np.asarray(column.fill_null(0.0))))
        else:
            code = np.asarray(pc.index_in(column, pa.array(known, pa.string())).fill_null(-1))
            values.append(code)
            there = there & (code >= 0)
        present.append(there)
    e, n, deal = (np.asarray(c).astype(np.int64) for c in batch.columns[len(levels):])
    return _Rows(values, present, e, n, deal, folds)


def _sides(split: Split, data: _Rows, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether rows go left by a split, and whether they have its value."""
    values = data.values[split.feature][rows]
    there = data.present[split.feature][rows]
    if split.threshold is not None:
        return (values <= split.threshold) != split.flip, there
    known = np.zeros(values.max(initial=0) + 2, bool)
    known[[c for c in split.left if c < len(known)]] = True
    return known[values], there


def _go_left(node: Node, data: _Rows, rows: np.ndarray) -> np.ndarray:
    left, there = _sides(node.split, data, rows)
    if there.all():
        return left
    open_rows = np.flatnonzero(~there)
    for other in node.surrogates:
        if not len(open_rows):
            break
        side, has = _sides(other, data, rows[open_rows])
        left[open_rows[has]] = side[has]
        open_rows = open_rows[~has]
    left[open_rows] = node.majority
    return left


def _walk(node: Node, number: int, data: _Rows, rows: np.ndarray) -> Iterator[tuple[int, Node, np.ndarray]]:
    """All nodes that rows pass, with their numbers (the children of i are 2 i and 2 i + 1)."""
    yield number, node, rows
    if node.children and len(rows):
        left = _go_left(node, data, rows)
        yield from _walk(node.children[0], 2 * number, data, rows[left])
        yield from _walk(node.children[1], 2 * number + 1, data, rows[~left])


class _Cells:
    """Counts of cells, kept as sums until they are many."""

    def __init__(self) -> None:
        self.sums: dict[tuple[int, ...], list[np.ndarray]] = {}
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, key: tuple[int, int, int, int], cells: np.ndarray, e: np.ndarray, n: np.ndarray, values: np.ndarray, size: int) -> None:
        if key not in self.sums:
            self.sums[key] = [np.zeros(size), np.zeros(size), np.full(size, np.inf), np.full(size, -np.inf)]
        sums = self.sums[key]
        sums[0] += np.bincount(cells, e, size)
        sums[1] += np.bincount(cells, n, size)
        np.minimum.at(sums[2], cells, values)
        np.maximum.at(sums[3], cells, values)

    def add_values(self, key: tuple[int, int, int, int], e: np.ndarray, n: np.ndarray, values: np.ndarray) -> None:
        seen, at = np.unique(values, return_inverse=True)
        self.rows.append((key, np.bincount(at, e), np.bincount(at, n), seen, seen))
        self.held += len(seen)

    def batch(self) -> pa.RecordBatch:
        parts = self.rows + [(key, *sums) for key, sums in self.sums.items()]
        self.sums, self.rows, self.held = {}, [], 0
        columns: list[list[np.ndarray]] = [[] for _ in range(9)]
        for key, e, n, low, high in parts:
            some = np.flatnonzero(n > 0)
            for c, k in zip(columns, key):
                c.append(np.full(len(some), k, np.int32))
            # Single values are told apart by value, not by the number of a cell.
            columns[4].append(np.full(len(some), -1, np.int32) if low is high else some.astype(np.int32))
            for c, x in zip(columns[5:], (e, n, low, high)):
                c.append(x[some])
        kinds = [pa.int32()] * 5 + [pa.float64()] * 4
        flat = [pa.array(np.concatenate(c) if c else [], k) for c, k in zip(columns, kinds)]
        return pa.RecordBatch.from_arrays(flat, ["tree", "node", "feature", "part", "cell", "e", "n", "low", "high"])


def _counter(
    trees: Sequence[Node], wanted: Mapping[tuple[int, int], Sequence[_Wanted]], levels: Sequence[tuple[str, ...] | None],
    folds: int, by_side: bool,
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts what is wanted in the nodes; with ``by_side`` events are rows that the node's split sends left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = _Cells()
        for batch in batches:
            if not batch.num_rows:
                continue
            data = _read(batch, levels, folds)
            for t in sorted({t for t, _ in wanted}):
                events, total = data.counts(t)
                for number, node, rows in _walk(trees[t], 1, data, np.flatnonzero(total > 0)):
                    if (t, number) in wanted and len(rows):
                        _count(cells, (t, number), node, wanted[t, number], data, rows, events[rows], total[rows], levels, by_side)
            if cells.held > CELLS_HELD:
                yield cells.batch()
        yield cells.batch()

    return run


def _count(cells, where, node, wanted, data, rows, e, n, levels, by_side) -> None:
    if by_side:
        left, there = _sides(node.split, data, rows)
        rows, n, e = rows[there], n[there], np.where(left[there], n[there], 0)
    else:
        cells.add((*where, -1, 0), np.zeros(len(rows), np.int64), e, n, np.zeros(len(rows)), 1)
    for part, (feature, cuts, interval) in enumerate(wanted):
        there = data.present[feature][rows]
        values = data.values[feature][rows]
        if interval is not None:
            there = there & (values >= interval.low) & (values <= interval.high)
        values, own_e, own_n = values[there], e[there], n[there]
        if not len(values):
            continue
        key = (*where, feature, part)
        if levels[feature] is not None:
            cells.add(key, values, own_e, own_n, values.astype(float), len(levels[feature]))
        elif cuts is None:
            cells.add_values(key, own_e, own_n, values)
        else:
            cells.add(key, np.searchsorted(cuts, values, "left"), own_e, own_n, values, len(cuts) + 1)


# --- best splits of the counts ---------------------------------------------------------


def _middle(low: float, high: float) -> float:
    """Threshold between two neighbouring values."""
    mid = low + (high - low) / 2
    return mid if low <= mid < high else low


def _number_split(cells: dict[str, np.ndarray], base: _Interval | None, by_side: bool, least: int):
    """Best cut between the cells of one stretch, and the cells that may hide a better one."""
    order = np.argsort(cells["low"], kind="stable")
    e, n, low, high = (cells[c][order] for c in ("e", "n", "low", "high"))
    base_e, base_n = (base.base_e, base.base_n) if base else (0.0, 0.0)
    all_e, all_n = (base.all_e, base.all_n) if base else (e.sum(), n.sum())
    score = agreement if by_side else gini_gain
    after_e, after_n = base_e + np.cumsum(e), base_n + np.cumsum(n)
    before_e, before_n = after_e - e, after_n - n
    best = None
    inside = np.arange(len(n) - 1)
    allowed = inside[(after_n[:-1] >= least) & (all_n - after_n[:-1] >= least)]
    if len(allowed):
        scores = score(after_e[allowed], after_n[allowed], all_e, all_n)
        top = scores.max()
        j = allowed[np.flatnonzero(scores >= top - abs(top) * SURE)[0]]
        same = 2 * after_e[j] - after_n[j] + all_n - all_e
        best = float(score(after_e[j], after_n[j], all_e, all_n)), _middle(high[j], low[j + 1]), bool(by_side and same < all_n - same)
    # Corners of what may stand left of a cut inside a cell: nothing, all events, all others, everything.
    corners = [(0, 0), (e, e), (0 * e, n - e), (e, n)]
    bound = np.max([score(before_e + ce, before_n + cn, all_e, all_n) for ce, cn in corners], axis=0)
    hidden = np.flatnonzero((low < high) & (after_n > least) & (all_n - before_n > least))
    return best, [(bound[j], low[j], high[j], before_e[j], before_n[j], n[j], all_e, all_n) for j in hidden]


def _level_split(cells: dict[str, np.ndarray], by_side: bool, least: int):
    """Best two sets of levels: by event rate, or each level to the side that most of its rows go to."""
    codes, e, n = cells["cell"], cells["e"], cells["n"]
    if by_side:
        left = codes[2 * e > n]
        rows_left = n[2 * e > n].sum()
        if min(rows_left, n.sum() - rows_left) < least:
            return None
        return float(np.maximum(e, n - e).sum()), left
    order = np.lexsort((codes, e / n))
    after_e, after_n = np.cumsum(e[order])[:-1], np.cumsum(n[order])[:-1]
    allowed = np.flatnonzero((after_n >= least) & (n.sum() - after_n >= least))
    if not len(allowed):
        return None
    scores = gini_gain(after_e[allowed], after_n[allowed], e.sum(), n.sum())
    top = scores.max()
    j = allowed[np.flatnonzero(scores >= top - abs(top) * SURE)[0]]
    return float(scores[np.searchsorted(allowed, j)]), codes[order][: j + 1]


def _chooser(wanted: Mapping[tuple[int, int], Sequence[_Wanted]], categories: Sequence[bool], by_side: bool, least: int):
    """Reduces the cells of a node to its total, the rows and best split of each feature, and the stretches left open."""
    names = ["tree", "node", "kind", "feature", "score", "low", "high", "base_e", "base_n", "rows", "all_e", "all_n", "codes", "flip"]
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.int32(), *[pa.float64()] * 8, pa.list_(pa.int32()), pa.bool_()]

    def run(table: pa.Table) -> pa.Table:
        cells = {c: np.asarray(table[c]) for c in table.column_names}
        tree, node = int(cells["tree"][0]), int(cells["node"][0])
        out = []

        def add(kind, feature, score=0.0, low=None, high=None, base_e=0.0, base_n=0.0, rows=0.0, all_e=0.0, all_n=0.0, codes=None, flip=False):
            out.append((tree, node, kind, feature, score, low, high, base_e, base_n, rows, all_e, all_n, codes, flip))

        for feature, part in sorted(set(zip(cells["feature"].tolist(), cells["part"].tolist()))):
            mine = (cells["feature"] == feature) & (cells["part"] == part)
            own = {c: x[mine] for c, x in cells.items()}
            e, n = float(own["e"].sum()), float(own["n"].sum())
            if feature < 0:
                add("total", feature, all_e=e, all_n=n)
                continue
            interval = wanted[tree, node][part].interval
            if interval is None:
                add("rows", feature, all_e=e, all_n=n, codes=sorted(own["cell"].tolist()) if categories[feature] else None)
            if categories[feature]:
                if found := _level_split(own, by_side, least):
                    add("best", feature, found[0], codes=found[1].tolist())
                continue
            best, hidden = _number_split(own, interval, by_side, least)
            if best:
                add("best", feature, best[0], best[1], flip=best[2])
            for bound, low, high, *rest in hidden:
                add("open", feature, bound, low, high, *rest)
        columns = list(zip(*out)) if out else [[] for _ in names]
        return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    return run


# --- growing ---------------------------------------------------------------------------


@dataclass
class _Grower:
    merged: DataFrame
    terms: Sequence[str]
    levels: Mapping[str, tuple[str, ...]]
    cuts: Mapping[str, np.ndarray]
    max_depth: int
    min_split: int
    min_rows: int
    cp: float
    surrogates: int
    folds: int
    known: list[tuple[str, ...] | None] = field(init=False)
    data: DataFrame = field(init=False)

    def __post_init__(self) -> None:
        self.known = [self.levels.get(t) for t in self.terms]
        self.folds = self.folds if self.folds > 1 else 1
        deal = F.pmod(F.xxhash64(*self.terms), F.lit(self.folds))
        columns = [F.col(t) if t in self.levels else F.col(t).cast("double") for t in self.terms]
        self.data = self.merged.select(*[c.alias(f"f{i}") for i, c in enumerate(columns)], EVENTS, WEIGHT, deal.alias(DEAL))

    def grow(self) -> list[Node]:
        """The tree of all rows and, with folds, the tree without each fold."""
        trees = [Node() for _ in range(1 + (self.folds if self.folds > 1 else 0))]
        fresh = {(t, 1): root for t, root in enumerate(trees)}
        floor: dict[int, float] = {}
        while fresh:
            best = self._search(trees, fresh, floor)
            split = {}
            for (t, number), node in fresh.items():
                if chosen := best.get((t, number)):
                    node.split = chosen
                    node.children = (Node(depth=node.depth + 1), Node(depth=node.depth + 1))
                    split[t, number] = node
            if split:
                self._place_missing(trees, split)
            fresh = {(t, 2 * number + side): node.children[side] for (t, number), node in split.items() for side in (0, 1)}
        return trees

    def _run(self, trees, wanted, by_side: bool, least: int) -> list:
        if not wanted:
            return []
        plain = [_bare(t) for t in trees]
        cells = self.data.mapInArrow(_counter(plain, wanted, self.known, self.folds, by_side), CELL)
        summed = cells.groupBy("tree", "node", "feature", "part", "cell", F.when(F.col("cell") < 0, F.col("low")).alias("value")).agg(
            F.sum("e").alias("e"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")
        ).drop("value")
        chooser = _chooser(wanted, [k is not None for k in self.known], by_side, least)
        # A few numbers per node, feature and open stretch.
        return summed.groupBy("tree", "node").applyInArrow(chooser, FOUND).collect()

    def _first_look(self, nodes: int) -> list[_Wanted]:
        """All features of new nodes in coarse bins, or in fine ones while these are few."""
        fine = {t: np.unique(c) for t, c in self.cuts.items()}
        few = nodes * sum(len(c) for c in fine.values()) <= CELLS_HELD
        return [
            _Wanted(i, None if t in self.levels else fine[t] if few else np.unique(self.cuts[t][FINER - 1::FINER]), None)
            for i, t in enumerate(self.terms)
        ]

    def _finer(self, interval: _Interval, turn: int) -> np.ndarray | None:
        """Cuts inside a stretch; None to look at single values."""
        if interval.rows <= VALUES_AT:
            return None
        fine = self.cuts[self.terms[interval.feature]]
        fine = np.unique(fine[(fine >= interval.low) & (fine < interval.high)])
        if turn == 0 and len(fine) > 1:
            return fine
        ends = np.array([interval.low, interval.high])
        if turn % 2 and np.isfinite(ends).all():
            steps = np.linspace(*ends, FINER + 1)[1:-1]
        else:
            # Between the bit patterns of the ends, in the order of numbers, so that any stretch gets narrower.
            bits = ends.view(np.int64)
            keys = np.where(bits < 0, np.int64(-(2**63)) - bits, bits).tolist()
            key = np.array([keys[0] + (keys[1] - keys[0]) * i // FINER for i in range(FINER)], np.int64)
            steps = np.where(key < 0, np.int64(-(2**63)) - key, key).view(np.float64)
        return np.unique(steps[(steps >= interval.low) & (steps < interval.high)])

    def _search(self, trees, nodes, floor: dict[int, float]) -> dict[tuple[int, int], Split]:
        """Totals of new nodes, and the best split of those that are worth one."""
        first = self._first_look(len(nodes))
        found = self._run(trees, {k: first for k in nodes}, False, self.min_rows)
        for r in found:
            if r.kind == "total":
                nodes[r.tree, r.node].events, nodes[r.tree, r.node].total = int(r.all_e), int(r.all_n)
                if r.node == 1:
                    floor[r.tree] = self.cp * nodes[r.tree, 1].risk * (1 + SURE)
        able = {
            k for k, n in nodes.items()
            if n.total >= self.min_split and n.depth < self.max_depth and n.risk > max(0, floor.get(k[0], 0))
        }
        best: dict[tuple[int, int], Split] = {}
        self._refine(trees, found, able, best, lambda r: (r.tree, r.node), False, self.min_rows)
        return {k: s for k, s in best.items() if s.score > SURE * nodes[k].total}

    def _refine(self, trees, found, able, best, key_of, by_side: bool, least: int) -> None:
        """Looks into open stretches until no bound beats the best split of its node (or node and feature)."""
        turn = 0
        while True:
            for r in found:
                if r.kind != "best" or (r.tree, r.node) not in able:
                    continue
                split = Split(r.feature, r.score, r.low if r.codes is None else None, frozenset(r.codes or ()), r.flip)
                if _better(split, best.get(key_of(r))):
                    best[key_of(r)] = split
            wanted = defaultdict(list)
            for r in found:
                if r.kind == "open" and (r.tree, r.node) in able:
                    known = best.get(key_of(r))
                    if known is None or _may_win(r, known):
                        interval = _Interval(r.feature, r.low, r.high, r.base_e, r.base_n, r.rows, r.all_e, r.all_n, r.score)
                        wanted[r.tree, r.node].append(_Wanted(r.feature, self._finer(interval, turn), interval))
            if not wanted:
                return
            found = self._run(trees, dict(wanted), by_side, least)
            turn += 1

    def _place_missing(self, trees, nodes) -> None:
        """Larger side and surrogates of nodes that were split."""
        first = self._first_look(len(nodes))
        wanted = {k: first if self.surrogates else [first[n.split.feature]] for k, n in nodes.items()}
        found = self._run(trees, wanted, True, 2)
        rows = {(r.tree, r.node, r.feature): r for r in found if r.kind == "rows"}
        others = [r for r in found if r.feature != nodes[r.tree, r.node].split.feature]
        best: dict[tuple[int, int, int], Split] = {}
        self._refine(trees, others, set(nodes) if self.surrogates else set(), best, lambda r: (r.tree, r.node, r.feature), True, 2)
        for k, node in nodes.items():
            own = rows[(*k, node.split.feature)]
            node.present, node.majority = int(own.all_n), bool(2 * own.all_e >= own.all_n)
            ranked = [
                s for f in range(len(self.terms))
                if (s := best.get((*k, f))) and s.score > max(rows[(*k, f)].all_e, rows[(*k, f)].all_n - rows[(*k, f)].all_e)
            ]
            ranked.sort(key=lambda s: (-s.score, s.feature))
            node.split, *others = (
                self._with_unseen(s, rows[(*k, s.feature)].codes, node.majority) for s in [node.split, *ranked[: self.surrogates]]
            )
            node.surrogates = tuple(others)

    def _with_unseen(self, split: Split, seen: Sequence[int], majority: bool) -> Split:
        """Levels that the node has not seen go to the larger side."""
        if split.threshold is not None or not majority:
            return split
        return replace(split, left=split.left | (set(range(len(self.known[split.feature]))) - set(seen)))

    def held_out(self, trees: Sequence[Node], worth: Sequence[float]) -> list[float]:
        """Wrong rows, over all folds, of the trees without each fold pruned to each complexity of the table."""
        plain, known, folds = [_bare(t) for t in trees], self.known, self.folds

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], np.ndarray] = defaultdict(lambda: np.zeros(2))
            for batch in batches:
                data = _read(batch, known, folds)
                for t in range(1, len(plain)):
                    e, n = data.fold(t - 1)
                    for number, _, rows in _walk(plain[t], 1, data, np.flatnonzero(n > 0)):
                        sums[t, number] += e[rows].sum(), n[rows].sum()
            keys = list(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
                 pa.array([sums[k][0] for k in keys], pa.float64()), pa.array([sums[k][1] for k in keys], pa.float64())],
                ["tree", "node", "e", "n"],
            )

        counted = self.data.mapInArrow(run, "tree int, node int, e double, n double")
        held = {
            (r.tree, r.node): (r.e, r.n) for r in counted.groupBy("tree", "node").agg(F.sum("e").alias("e"), F.sum("n").alias("n")).collect()
        }
        out = []
        for i in range(len(worth)):
            # Between the complexities at which a tree and the next larger one are chosen; the first is the root alone.
            level = math.inf if i == 0 else math.sqrt(worth[i] * worth[i - 1]) if worth[i] >= 0 else -1.0
            wrong = 0.0
            for t in range(1, len(trees)):
                if i == 0:
                    prune_order(trees[t])
                at = level * trees[t].risk * (1 + SURE) if trees[t].risk else math.inf

                def below(node: Node, number: int) -> float:
                    if node.children and node.complexity > at:
                        return sum(below(c, 2 * number + side) for side, c in enumerate(node.children))
                    e, n = held.get((t, number), (0.0, 0.0))
                    return n - e if node.predicted else e

                wrong += below(trees[t], 1)
            out.append(wrong)
        return out


def _may_win(stretch, known: Split) -> bool:
    """Whether a stretch may hold a better cut, or an equal one that comes first."""
    slack = abs(known.score) * SURE
    if stretch.score > known.score + slack:
        return True
    first = (stretch.feature, stretch.low) < (known.feature, math.inf if known.threshold is None else known.threshold)
    return first and stretch.score >= known.score - slack


def _better(new: Split, old: Split | None) -> bool:
    """Higher score; of equal ones the earlier feature, then the lower cut."""
    if old is None or new.score > old.score + abs(old.score) * SURE:
        return True
    if new.score < old.score - abs(old.score) * SURE:
        return False
    return (new.feature, new.threshold or 0.0) < (old.feature, old.threshold or 0.0)


def _bare(node: Node) -> Node:
    """What a task needs to send rows down."""
    children = tuple(_bare(c) for c in node.children)
    return Node(split=node.split, surrogates=node.surrogates, majority=node.majority, children=children)


# --- pruning ---------------------------------------------------------------------------


def prune_order(root: Node) -> list[tuple[float, int, int]]:
    """Sets the complexity at which each node becomes a leaf; the trees on the way as (complexity, splits, wrong rows)."""
    parent: dict[int, Node] = {}
    risk: dict[int, int] = {}
    leaves: dict[int, int] = {}
    order: list[Node] = []
    stack = [root]
    while stack:
        node = stack.pop()
        order.append(node)
        for child in node.children:
            parent[id(child)] = node
            stack.append(child)
    for node in reversed(order):
        risk[id(node)] = sum(risk[id(c)] for c in node.children) if node.children else node.risk
        leaves[id(node)] = sum(leaves[id(c)] for c in node.children) if node.children else 1

    def worth(node: Node) -> float:
        return (node.risk - risk[id(node)]) / (leaves[id(node)] - 1)

    inner = [n for n in order if n.children]
    for node in inner:
        node.complexity = math.inf
    place = {id(n): i for i, n in enumerate(order)}
    heap = [(worth(n), place[id(n)]) for n in inner]
    heapq.heapify(heap)
    steps, now = [(-math.inf, leaves[id(root)] - 1, risk[id(root)])], 0.0
    while heap:
        gain, i = heapq.heappop(heap)
        node = order[i]
        if node.complexity < math.inf or leaves[id(node)] == 1 or abs(worth(node) - gain) > SURE * max(1.0, abs(gain)):
            continue
        now = max(now, gain)
        below = [node]
        while below:
            one = below.pop()
            if one.complexity == math.inf and one.children:
                one.complexity = now
                below.extend(one.children)
        less_risk, less_leaves = node.risk - risk[id(node)], leaves[id(node)] - 1
        at = node
        while at is not None:
            risk[id(at)] += less_risk
            leaves[id(at)] -= less_leaves
            at = parent.get(id(at))
        up = parent.get(id(node))
        while up is not None:
            if leaves[id(up)] > 1:
                heapq.heappush(heap, (worth(up), place[id(up)]))
            up = parent.get(id(up))
        state = (now, leaves[id(root)] - 1, risk[id(root)])
        if math.isclose(steps[-1][0], now, rel_tol=SURE, abs_tol=0.0):
            steps[-1] = state
        else:
            steps.append(state)
    return steps


def _table(root: Node, steps: Sequence[tuple[float, int, int]], cp: float) -> list[tuple[float, int, float]]:
    """The least complexity at which each tree is chosen, its splits, and its wrong rows per wrong row of the root.

    Goes from the root alone to the tree that ``cp`` keeps.
    """
    whole = root.risk
    if not whole:
        return [(cp, 0, 1.0)]
    limit = cp * whole * (1 + SURE)
    kept = [s for s in steps if s[0] <= limit][-1]
    rows = [(cp, kept[1], kept[2] / whole)]
    rows += [(gain / whole, splits, wrong / whole) for gain, splits, wrong in steps if gain > limit]
    return rows[::-1]


# --- rules -----------------------------------------------------------------------------


def _number(value: float) -> str:
    return repr(float(value)) if math.isfinite(value) else f"double('{value}')"


def _condition(split: Split, terms: Sequence[str], levels: Mapping[str, tuple[str, ...]], inside: bool = True) -> str:
    """SQL for rows that go left (or right) by a split."""
    term = terms[split.feature]
    if split.threshold is not None:
        return f"{term} {'<=' if inside != split.flip else '>'} {_number(split.threshold)}"
    side = [x for i, x in enumerate(levels[term]) if (i in split.left) == inside]
    quoted = ", ".join("'" + x.replace("\\", "\\\\").replace("'", "''") + "'" for x in side)
    return f"{term} IN ({quoted})"


def _rules(node: Node, terms: Sequence[str], levels: Mapping[str, tuple[str, ...]]) -> tuple[str, str]:
    """Conditions of both children; a row without the value goes by the surrogates, then by the larger side."""
    left, right = (_condition(node.split, terms, levels, side) for side in (True, False))
    if node.present == node.total:
        return left, right
    tests = [left, *(_condition(s, terms, levels) for s in node.surrogates)]
    whole = f"coalesce({', '.join(tests)}, {str(node.majority).lower()})"
    return whole, f"not {whole}"


def _leaf_rules(node: Node, terms, levels, path: tuple[str, ...] = ()) -> list[tuple[str, Node]]:
    """Conditions and counts of each leaf, left to right."""
    if not node.children:
        return [(" and ".join(path) or "all rows", node)]
    return [
        x for rule, child in zip(_rules(node, terms, levels), node.children) for x in _leaf_rules(child, terms, levels, (*path, rule))
    ]


def _surrogate_rows(root: Node, terms, levels) -> list[tuple[int, str, int, str, int]]:
    """Split and surrogates of every node, numbered as the children of i are 2 i and 2 i + 1."""
    out, queue = [], [(1, root)]
    while queue:
        number, node = queue.pop(0)
        for place, other in enumerate(node.surrogates, 1):
            out.append((number, _condition(node.split, terms, levels), place, _condition(other, terms, levels), int(other.score)))
        queue += [(2 * number + side, c) for side, c in enumerate(node.children)]
    return out
