"""Exact order statistics, tiles, ranks and running sums over whole tables.

A window without ``partitionBy`` puts all rows into one task.  Nearly every use of
a rank here needs only a few cut points (tile borders, hinges, quantiles, the edge
of a sample), so the cuts are found exactly with a few narrow scans and the rows
are then labelled by comparing them with literals: no row is shuffled.

Finding a cut is selection by sampling (Floyd and Rivest): a row sample places two
splitters around each wanted rank, one counting pass tells how many rows fall
below, on and between the splitters, and only the gap that holds the rank is looked
at again.  The counts are exact, so the sample affects speed and never the result.
A value held by many rows ends up *on* a splitter and costs nothing extra.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any, NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventrate.runtime import LIMITS, Limits

SERIES, GAP, CELL, PART, TIE, COPY = "_series", "_gap", "_cell", "_part", "_tie", "_copy"
COLUMNS_PER_SCAN = 16  # keeps the generated conditions of one scan small
FAN = 256  # borders of parts that are looked up at once
DRAWN, DRAWN_OF = 32, 1 << 30  # rows sampled for each part, and the range of the hash that draws them
COPIES_AT_ONCE = 100_000  # rows that one row of counts becomes in a step


class Cut(NamedTuple):
    """The ordering values of the row at one rank.

    ``shared`` is true when rows with the very same ordering values follow it.
    """

    values: tuple
    shared: bool


@dataclass
class _Gap:
    """Open interval of one series that still hides the rows at ``ranks``."""

    series: Any
    low: tuple | None
    high: tuple | None
    below: int
    rows: int
    ranks: list[int] = field(default_factory=list)


# --- comparing rows with literal cuts -------------------------------------------------


def _same(columns: Sequence[Column], values: Sequence) -> Column:
    """Whether a row equals the literal row; its first column is never NULL."""
    rest = [c.eqNullSafe(F.lit(v)) for c, v in zip(columns[1:], values[1:])]
    return reduce(lambda a, b: a & b, rest, columns[0] == F.lit(values[0]))


def _before(columns: Sequence[Column], values: Sequence, or_same: bool = False) -> Column:
    """Whether a row sorts before the literal row; its first column is never NULL."""
    first, value = columns[0], F.lit(values[0])
    if len(columns) == 1:
        return first <= value if or_same else first < value
    return (first < value) | ((first == value) & _before_nullable(columns[1:], values[1:], or_same))


def _before_nullable(columns: Sequence[Column], values: Sequence, or_same: bool) -> Column:
    """The same for columns that may be NULL, which sorts first."""
    first, value = columns[0], values[0]
    less = F.lit(False) if value is None else F.coalesce(first < F.lit(value), F.lit(True))
    same = first.eqNullSafe(F.lit(value))
    if len(columns) == 1:
        return less | same if or_same else less
    return less | (same & _before_nullable(columns[1:], values[1:], or_same))


def _locate(
    keys: Sequence[Column], cuts: Sequence[Sequence], between: Callable[[int], Column], at: Callable[[int], Column]
) -> Column:
    """Place of a row among ascending literal cuts, found by halving.

    ``between(j)`` labels rows after cut ``j - 1`` and before cut ``j``; ``at(j)`` those on cut ``j``.
    """

    def part(first: int, last: int) -> Column:
        if first == last:
            return between(first)
        mid = (first + last) // 2
        ladder = F.when(_before(keys, cuts[mid]), part(first, mid))
        return ladder.when(_same(keys, cuts[mid]), at(mid)).otherwise(part(mid + 1, last))

    return part(0, len(cuts))


def _sort_key(values: Sequence) -> tuple:
    def one(v):
        if v is None:
            return (0,)
        return (2,) if isinstance(v, float) and math.isnan(v) else (1, v)

    return tuple(one(v) for v in values)


def _has_nan(column: pa.ChunkedArray) -> bool:
    return pa.types.is_floating(column.type) and bool(pc.any(pc.is_nan(column)).as_py())


# --- exact selection -------------------------------------------------------------------


def rows_at_ranks(
    long: DataFrame,
    order: Sequence[str],
    ranks_of: Mapping[Any, Iterable[int]],
    sizes: Mapping[Any, int],
    limits: Limits = LIMITS,
    distinct: Mapping[Any, int] | None = None,
) -> dict[Any, dict[int, Cut]]:
    """Ordering values at the given 1-based ranks of each series.

    ``long`` holds the series label in ``_series`` and the ``order`` columns, the first
    of them never NULL.  ``sizes`` gives the rows of each series.  ``distinct`` may tell, for a
    single ordering column, about how many values a series has: few values are counted at
    once, however many rows hold them.
    """
    found: dict[Any, dict[int, Cut]] = {s: {} for s in ranks_of}
    gaps = [
        _Gap(s, None, None, 0, sizes.get(s, 0), sorted(set(r)))
        for s, r in ranks_of.items()
        if r and sizes.get(s, 0)
    ]
    for gap in gaps:
        if gap.ranks[0] < 1 or gap.ranks[-1] > gap.rows:
            raise ValueError(f"rank outside 1..{gap.rows} for {gap.series!r}")
    attempt = 0
    few = {s for s, n in (distinct or {}).items() if len(order) == 1 and 1.25 * n <= limits.task_rows}
    while gaps:
        small = [g for g in gaps if g.rows <= limits.task_rows or g.series in few]
        large = [g for g in gaps if g not in small]
        if small:
            _rank_within(long, order, small, found)
        gaps = _narrow(long, order, large, found, attempt, limits) if large else []
        attempt += 1
    lost = {s: [r for r in ranks if r not in found[s]] for s, ranks in ranks_of.items() if sizes.get(s, 0)}
    if any(lost.values()):
        raise RuntimeError(f"the table gave different rows in different scans; ranks not found: {lost}")
    return found


def _tag(long: DataFrame, order: Sequence[str], gaps: Sequence[_Gap]) -> DataFrame:
    """Keep rows inside a gap, labelled with its index."""
    keys = [F.col(c) for c in order]
    nowhere = F.lit(None).cast("int")

    def within(members: list[tuple[int, _Gap]]) -> Column:
        # The open gaps of a series do not overlap, so each lies between neighbouring bounds.
        bounds = sorted({b for _, g in members for b in (g.low, g.high) if b is not None}, key=_sort_key)
        index = {(g.low, g.high): i for i, g in members}
        edges = [None, *bounds, None]
        return _locate(
            keys, bounds, lambda j: F.lit(index.get((edges[j], edges[j + 1]))).cast("int"), lambda _: nowhere
        )

    by_series: dict[Any, list[tuple[int, _Gap]]] = {}
    for i, gap in enumerate(gaps):
        by_series.setdefault(gap.series, []).append((i, gap))
    label: Any = F
    for series, members in by_series.items():
        label = label.when(F.col(SERIES) == F.lit(series), within(members))
    return long.select(label.alias(GAP), *order).where(F.col(GAP).isNotNull())


def _rank_within(long: DataFrame, order: Sequence[str], gaps: Sequence[_Gap], found: dict) -> None:
    """Rank the rows of gaps known to be small, one task per gap."""
    tagged = _tag(long, order, gaps)
    keys = [F.col(c) for c in order]
    if len(order) == 1:
        # Equal values collapse before the shuffle; the window then sees distinct values.
        w = Window.partitionBy(GAP).orderBy(*keys)
        upto = F.sum("_rows").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        ranked = tagged.groupBy(GAP, *order).agg(F.count(F.lit(1)).alias("_rows")).withColumn("_upto", upto)
        ranked = ranked.withColumn("_from", F.col("_upto") - F.col("_rows"))
        shared = F.col("_rank") < F.col("_upto")
    else:
        w = Window.partitionBy(GAP).orderBy(*keys)
        place = F.row_number().over(w).cast("bigint")
        following = reduce(
            lambda a, b: a & b,
            [F.lead(c).over(w).eqNullSafe(F.col(c)) for c in order],
        ) & F.lead(F.lit(1)).over(w).isNotNull()
        ranked = tagged.withColumn("_upto", place).withColumn("_shared", following)
        ranked = ranked.withColumn("_from", F.col("_upto") - 1)
        shared = F.col("_shared")
    wanted = reduce(
        lambda acc, ig: acc.when(
            F.col(GAP) == ig[0], F.array(*[F.lit(r - ig[1].below).cast("bigint") for r in ig[1].ranks])
        ),
        enumerate(gaps),
        F,
    )
    hits = F.filter(wanted, lambda r: (r > F.col("_from")) & (r <= F.col("_upto")))
    rows = (
        ranked.withColumn("_hits", hits)
        .where(F.size("_hits") > 0)
        .withColumn("_rank", F.explode("_hits"))
        .select(GAP, "_rank", shared.alias("_more"), *order)
        .collect()
    )
    for row in rows:
        gap = gaps[row[GAP]]
        found[gap.series][gap.below + row["_rank"]] = Cut(tuple(row[c] for c in order), bool(row["_more"]))


def _narrow(
    long: DataFrame, order: Sequence[str], gaps: list[_Gap], found: dict, attempt: int, limits: Limits
) -> list[_Gap]:
    """Place splitters around each rank, count, and return the gaps still open."""
    tagged = _tag(long, order, gaps)
    drawn = _sample(tagged, order, gaps, attempt, limits)
    sample: dict[int, list[tuple]] = {i: [] for i in range(len(gaps))}
    for i, *values in zip(*(drawn.column(c).to_pylist() for c in (GAP, *order))):
        sample[i].append(tuple(values))
    plain = not any(drawn.column(c).null_count or _has_nan(drawn.column(c)) for c in order)
    splitters = {
        i: _splitters(gaps[i], sorted(rows, key=None if plain else _sort_key)) for i, rows in sample.items()
    }

    keys = [F.col(c) for c in order]

    def cell_of(cuts: list[tuple]) -> Column:
        """Even cells are gaps between cuts, odd cells are the cuts."""
        return _locate(keys, cuts, lambda j: F.lit(2 * j), lambda j: F.lit(2 * j + 1))

    cell = reduce(lambda acc, ic: acc.when(F.col(GAP) == ic[0], cell_of(ic[1])), splitters.items(), F)
    counts = {
        (row[GAP], row[CELL]): row["count"]
        for row in tagged.select(GAP, cell.alias(CELL)).groupBy(GAP, CELL).count().collect()
    }
    left = []
    for i, gap in enumerate(gaps):
        cuts, below = splitters[i], gap.below
        for c in range(2 * len(cuts) + 1):
            rows = counts.get((i, c), 0)
            inside = [r for r in gap.ranks if below < r <= below + rows]
            if inside and c % 2:
                for r in inside:
                    found[gap.series][r] = Cut(cuts[c // 2], r < below + rows)
            elif inside:
                low = cuts[c // 2 - 1] if c else gap.low
                high = cuts[c // 2] if c // 2 < len(cuts) else gap.high
                left.append(_Gap(gap.series, low, high, below, rows, inside))
            below += rows
    return left


def _sample(tagged: DataFrame, order: Sequence[str], gaps: Sequence[_Gap], attempt: int, limits: Limits) -> pa.Table:
    """Some rows of each gap, bounded in rows and, for texts, in bytes."""
    share = max(limits.sample_rows // len(gaps), 100)
    texts = [c for c, kind in tagged.select(*order).dtypes if kind in ("string", "binary")]
    if not texts:
        fraction = reduce(
            lambda acc, ig: acc.when(F.col(GAP) == ig[0], F.lit(min(1.0, share / ig[1].rows))), enumerate(gaps), F
        )
        return tagged.where(F.rand(seed=attempt) < fraction).toArrow()
    # Each row draws a height, one more with half the chance.  The rows and bytes of every height are counted before
    # any text is fetched, and only the greatest heights that fit are; one row at least where a single one is too long.
    height = F.floor(-F.log2(F.lit(1.0) - F.rand(seed=attempt))).cast("int")
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint") for c in texts), F.lit(0).cast("bigint"))
    marked = tagged.withColumn("_height", height)
    counts: dict[int, list[tuple[int, int, int]]] = {i: [] for i in range(len(gaps))}
    for r in marked.groupBy(GAP, "_height").agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("b")).collect():
        counts[r[GAP]].append((r["_height"], r["n"], r["b"]))
    least = {}
    for i, found in counts.items():
        rows = size = 0
        for h, n, b in sorted(found, reverse=True):
            if i in least and (rows + n > share or size + b > limits.sample_bytes // len(gaps)):
                break
            rows, size, least[i] = rows + n, size + b, h
    enough = reduce(lambda acc, ih: acc.when(F.col(GAP) == ih[0], F.lit(ih[1])), least.items(), F)
    return marked.where(F.col("_height") >= enough).drop("_height").toArrow()


def _splitters(gap: _Gap, sample: list[tuple]) -> list[tuple]:
    """Sample values just outside the expected place of every rank of the gap."""
    size = len(sample)
    chosen = set()
    for rank in gap.ranks:
        place = (rank - gap.below) / gap.rows * size
        slack = 3.0 * math.sqrt(max(place * (1 - place / size), 1.0)) if size else 0.0
        for at in (math.floor(place - slack) - 1, math.ceil(place + slack)):
            if 0 <= at < size:
                chosen.add(sample[at])
    if not chosen and size:
        chosen.add(sample[size // 2])
    return sorted(chosen, key=_sort_key)


# --- several columns of one table ------------------------------------------------------


def column_sizes(df: DataFrame, columns: Sequence[str], values: bool = False) -> tuple[dict[str, int], dict[str, int]]:
    """Non-NULL rows of each column and, if asked for, about how many distinct values."""
    if not columns:
        return {}, {}
    counts = [F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(columns)]
    sketches = [F.approx_count_distinct(c, 0.03).alias(f"d{i}") for i, c in enumerate(columns)] if values else []
    row = df.agg(*counts, *sketches).first()
    return (
        {c: row[f"n{i}"] for i, c in enumerate(columns)},
        {c: row[f"d{i}"] for i, c in enumerate(columns)} if values else {},
    )


def _family(type_name: str) -> str:
    """Columns of one family may share an unpivoted value column without loss."""
    if type_name in ("tinyint", "smallint", "int", "bigint"):
        return "bigint"
    return "double" if type_name in ("float", "double") else type_name


def order_statistics(
    df: DataFrame,
    columns: Sequence[str],
    ranks_of: Callable[[str, int], Iterable[int]],
    key: Sequence[str] = (),
    sizes: Mapping[str, int] | None = None,
    limits: Limits = LIMITS,
    distinct: Mapping[str, int] | None = None,
) -> tuple[dict[str, dict[int, Cut]], dict[str, int]]:
    """Values (and ``key``) at exact ranks of several columns, NULLs left out.

    ``ranks_of(column, rows)`` names the ranks.  Columns of like type are unpivoted so
    that a batch of them is served by the same scans.
    """
    columns = list(columns)
    if sizes is None:
        sizes, distinct = column_sizes(df, columns, values=not key)
    sizes = dict(sizes)
    families: dict[str, list[str]] = {}
    types = dict(df.dtypes)
    for c in columns:
        families.setdefault(_family(types[c]), []).append(c)
    cuts: dict[str, dict[int, Cut]] = {}
    names = [f"_key{i}" for i in range(len(key))]
    batches = [
        (family, members[i:i + COLUMNS_PER_SCAN])
        for family, members in families.items() for i in range(0, len(members), COLUMNS_PER_SCAN)
    ]
    for family, members in batches:
        keys = [F.col(k).alias(n) for k, n in zip(key, names)]
        if len(members) == 1:
            long = df.select(F.lit(members[0]).alias(SERIES), F.col(members[0]).cast(family).alias("_value"), *keys)
        else:
            wide = df.select(*keys, *[F.col(c).cast(family).alias(c) for c in members])
            long = wide.unpivot(names, members, SERIES, "_value")
        long = long.where(F.col("_value").isNotNull())
        wanted = {c: list(ranks_of(c, sizes[c])) if sizes[c] else [] for c in members}
        cuts.update(rows_at_ranks(long, ["_value", *names], wanted, sizes, limits, distinct))
    return {c: cuts[c] for c in columns}, sizes


def quantile_values(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float],
    sizes: Mapping[str, int] | None = None, limits: Limits = LIMITS, distinct: Mapping[str, int] | None = None,
) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation between neighbouring ranks."""

    def position(p: float, n: int) -> tuple[int, int, float]:
        at = (n - 1) * p
        low = min(math.floor(at + 1e-9), n - 1)
        return low + 1, min(low + 2, n), max(at - low, 0.0)

    cuts, sizes = order_statistics(
        df, columns, lambda _, n: {r for p in probs for r in position(p, n)[:2]}, sizes=sizes, limits=limits,
        distinct=distinct,
    )
    out: dict[str, list[float | None]] = {}
    for c in columns:
        out[c] = []
        for p in probs:
            if not sizes[c]:
                out[c].append(None)
                continue
            low, high, part = position(p, sizes[c])
            a, b = float(cuts[c][low].values[0]), float(cuts[c][high].values[0])
            out[c].append(a if part == 0.0 else a + (b - a) * part)
    return out


# --- tiles -----------------------------------------------------------------------------


def tile_edges(rows: int, tiles: int) -> list[int]:
    """Last rank of each tile but the final one; larger tiles come first."""
    base, extra = divmod(rows, tiles)
    edges = [i * base + min(i, extra) for i in range(1, tiles)]
    return [e for e in edges if 0 < e < rows]


def split_copies(
    df: DataFrame, cut: Callable[[DataFrame, list[str]], Any], cuts_of: Callable[[Any], Iterable[Cut]]
) -> tuple[DataFrame, list[str], Any]:
    """Rows with a key that splits ties where no column does: a hash of the row and, if need be, a copy number.

    ``cut(table, key)`` places cuts and ``cuts_of`` lists them.  Where copies of one row lie on both sides of a cut,
    the copies of that row are counted and numbered; they are alike, so any of them may bear any number.  Nothing
    is stored, and every job gives the same numbers.
    """
    hashed = df.withColumn(TIE, F.xxhash64(*df.columns))
    found = cut(hashed, [TIE])
    crowded = sorted({c.values[-1] for c in cuts_of(found) if c.shared})
    if not crowded:
        return hashed, [TIE], found
    inside = F.col(TIE).isin(crowded)
    counted = hashed.where(inside).groupBy(*hashed.columns).agg(F.count(F.lit(1)).alias("_copies"))
    steps = counted.withColumn("_step", F.explode(F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / COPIES_AT_ONCE))))
    first = F.col("_step") * COPIES_AT_ONCE
    last = F.least(first + COPIES_AT_ONCE, F.col("_copies")) - 1
    # Dealt out again between the steps, so that a row that fills a third of the table is not rebuilt by one task.
    spread = steps.repartition(TIE, "_step")
    numbered = spread.withColumn(COPY, F.explode(F.sequence(first, last))).select(*hashed.columns, COPY)
    whole = hashed.where(~inside).withColumn(COPY, F.lit(0).cast("bigint")).unionByName(numbered)
    return whole, [TIE, COPY], cut(whole, [TIE, COPY])


def tile_label(column: str, key: Sequence[str], edges: Sequence[Cut]) -> Column:
    """Tile number of a row by comparison with literal tile borders; NULL stays NULL."""
    keys = [F.col(c) for c in (column, *key)]

    place = _locate(keys, [cut.values for cut in edges], lambda j: F.lit(j + 1), lambda j: F.lit(j + 1))
    return F.when(F.col(column).isNotNull(), place)


def require_distinct(cuts: Iterable[Cut], key: Sequence[str]) -> None:
    if any(cut.shared for cut in cuts):
        raise ValueError(f"rows at a tile border share the same value and key {list(key)}; pass a unique key")


def ntile(
    df: DataFrame, column: str, tiles: int, key: Sequence[str] | str | None, name: str = "tile",
    limits: Limits = LIMITS,
) -> DataFrame:
    """Add the tile (1..``tiles``) of each row by ``column``, ties split in ``key`` order.

    ``key`` must make rows distinct.  ``None`` splits ties by a hash of the whole row, and copies of one
    row by number.
    """
    if key is None:
        table, key, edges = split_copies(df, lambda t, k: _edges(t, column, tiles, k, limits), lambda found: found)
        return table.withColumn(name, tile_label(column, key, edges)).select(*df.columns, name)
    key = [key] if isinstance(key, str) else list(key)
    edges = _edges(df, column, tiles, key, limits)
    require_distinct(edges, key)
    return df.withColumn(name, tile_label(column, key, edges))


def _edges(df: DataFrame, column: str, tiles: int, key: Sequence[str], limits: Limits) -> list[Cut]:
    cuts, sizes = order_statistics(df, [column], lambda _, n: tile_edges(n, tiles), key, limits=limits)
    return [cuts[column][r] for r in tile_edges(sizes[column], tiles)]


# --- running sums and ranks of every row -----------------------------------------------


def running_sums(
    df: DataFrame, order: Sequence[str], sums: Mapping[str, str], limits: Limits = LIMITS,
) -> DataFrame:
    """Add, for each ``new: column`` of ``sums``, the sum over all rows sorted before.

    Rows are told apart into parts small enough for one task, by borders that a sample places.  The totals of the parts
    give each part its starting value; they are summed in the same way, in parts of parts, however many there are.
    A row's part follows from its values alone, so nothing is stored.  ``order`` must be a total order;
    ``df`` is read four times (twice if one task can sum it).
    """
    return _running_sums(df, df.count(), order, sums, limits)


def _running_sums(df: DataFrame, rows: int, order: Sequence[str], sums: Mapping[str, str], limits: Limits) -> DataFrame:
    """The same for a table of at most ``rows`` rows."""
    # Samples and totals of parts are small; they may fill a task even where rows may not.
    inner = replace(limits, task_rows=max(limits.task_rows, limits.sample_rows))
    keys = [F.col(c) for c in order]
    if rows <= limits.task_rows:
        # Few rows: one task may sort them.
        w = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({new: F.coalesce(F.sum(c).over(w), F.lit(0)) for new, c in sums.items()})
    parts = math.ceil(rows / limits.task_rows)
    inside = label_parts(df, order, parts, rows, limits)
    totals = inside.groupBy(F.col(PART).alias("_of")).agg(*[F.sum(c).alias(f"_total_{new}") for new, c in sums.items()])
    starts = _running_sums(totals, 2 * parts, ["_of"], {f"_start_{new}": f"_total_{new}" for new in sums}, inner)
    starts = starts.select(F.col("_of").alias(PART), *[f"_start_{new}" for new in sums])
    # One row per part; beyond the limit both sides are dealt by part, as the window below is anyway.
    joined = inside.join(F.broadcast(starts) if parts < limits.broadcast_rows else starts, PART)
    w = Window.partitionBy(PART).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    added = {new: F.coalesce(F.sum(c).over(w), F.lit(0)) + F.col(f"_start_{new}") for new, c in sums.items()}
    return joined.withColumns(added).drop(PART, *[f"_start_{new}" for new in sums])


def label_parts(df: DataFrame, order: Sequence[str], parts: int, rows: int, limits: Limits = LIMITS) -> DataFrame:
    """Add ``_part``: how many of about ``parts`` borders, placed by a sample of the rows, a row lies behind.

    The sample is drawn by a hash of the ``order`` columns, so that every job places the same borders.  Blocks of ``FAN``
    borders are looked up one in the other, each by halving.
    """
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)])
    each = max(1, min(DRAWN, limits.task_rows // (4 * FAN)))
    share = max(1, min(DRAWN_OF, math.ceil(DRAWN_OF * parts * each / rows)))
    # Salted, so that a sample of the sample is one.
    drawn = df.select(key.alias("_key")).where(F.pmod(F.xxhash64(*order, F.lit(rows)), F.lit(DRAWN_OF)) < share).withColumn(
        "_one", F.lit(1).cast("bigint")
    )
    # Twice what is expected: the bound only tells whether one task may number the sample.
    inner = replace(limits, task_rows=max(limits.task_rows, limits.sample_rows))
    numbered = _running_sums(drawn, 2 * parts * each, ["_key"], {"_before": "_one"}, inner)
    borders = numbered.where((F.col("_before") + 1) % each == 0).select(
        "_key", (F.floor((F.col("_before") + 1) / each) - 1).cast("bigint").alias("_border")
    )
    levels = max(1, math.ceil(math.log(max(2, 2 * parts), FAN)))
    labelled = df.withColumns({PART: F.lit(0).cast("bigint"), "_place": key})
    for level in range(levels - 1, -1, -1):
        # The last border of each block of the level below, or each border itself.
        size = FAN**level
        chosen = borders.where((F.col("_border") + 1) % size == 0).withColumn("_border", F.floor(F.col("_border") / size))
        blocks = chosen.groupBy(F.floor(F.col("_border") / FAN).cast("bigint").alias("_block")).agg(
            F.sort_array(F.collect_list("_key")).alias("_borders")
        )
        small = parts <= limits.broadcast_rows
        labelled = labelled.join(F.broadcast(blocks) if small else blocks, F.col(PART) == F.col("_block"), "left")
        labelled = labelled.withColumn("_behind", F.lit(0))
        step = FAN // 2
        while step:
            behind = F.get("_borders", F.col("_behind") + (step - 1)) < F.col("_place")
            labelled = labelled.withColumn("_behind", F.when(behind, F.col("_behind") + step).otherwise(F.col("_behind")))
            step //= 2
        behind = F.get("_borders", F.col("_behind")) < F.col("_place")
        labelled = labelled.withColumn("_behind", F.when(behind, F.col("_behind") + 1).otherwise(F.col("_behind")))
        labelled = labelled.withColumn(PART, F.col(PART) * FAN + F.col("_behind")).drop("_block", "_borders", "_behind")
    return labelled.drop("_place")


def global_rank(
    df: DataFrame, order: Sequence[str], name: str = "position", limits: Limits = LIMITS
) -> DataFrame:
    """Number all rows 1, 2, ... in the total order ``order``."""
    counted = running_sums(df.withColumn("_one", F.lit(1).cast("bigint")), order, {name: "_one"}, limits)
    return counted.withColumn(name, (F.col(name) + 1).cast("bigint")).drop("_one")


def lag_difference(df: DataFrame, group: str, order: str, value: str, name: str = "difference") -> DataFrame:
    """Previous value minus own value inside each group of a small report."""
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn(name, F.lag(value).over(w) - F.col(value))
