"""Exact top-k inner products by best-first search in an M-tree.

Quantised vectors x get one more component, sqrt(M^2 - |x|^2) with M the greatest length, and queries a zero: then
distance^2 = |q|^2 + M^2 - 2 <q, x>, so the nearest neighbours in this metric space are the greatest inner products.

The tree has three levels above the vectors: a root, subtrees around routing vectors, and pages.  Every page
stores its centre, covering radius, the distance of the centre to the subtree's centre (its parent), and the distance
of each entry to the page's centre.  By the triangle inequality these rule out pages and entries
before their distance to the query is computed.  Subtrees are rows of a stored table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventrate.runtime import materialise

EXACT = 2.0**53  # whole numbers below are exact in a double
BATCH_ROWS = 4096


@dataclass(frozen=True)
class Settings:
    """``scale`` quantises: floor(scale * x).  Subtrees hold about ``subtree`` vectors and pages up to ``page``.

    ``routing`` bounds the vectors sampled to place subtrees, ``seeds`` those that give a query its first bound,
    ``round_queries`` the queries that are sent to all tasks at a time.
    """

    scale: float = 64.0
    subtree: int = 1024
    page: int = 64
    routing: int = 1024
    seeds: int = 2048
    round_queries: int = 65_536


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Whole-number inner products, by floating point where that is exact."""
    if not len(queries) or not len(vectors):
        return np.zeros((len(queries), len(vectors)), np.int64)
    greatest = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * queries.shape[1]
    if greatest < EXACT:
        return (queries.astype(float) @ vectors.astype(float).T).astype(np.int64)
    return queries @ vectors.T


def _lift(vectors: np.ndarray, reach: float) -> np.ndarray:
    """Vectors with the component that gives all of them length ``reach``."""
    plain = vectors.astype(float)
    rest = np.sqrt(np.maximum(reach**2 - (plain**2).sum(1), 0))
    return np.column_stack([plain, rest])


def _distances(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    squares = (one**2).sum(1)[:, None] + (two**2).sum(1)[None] - 2 * one @ two.T
    return np.sqrt(np.maximum(squares, 0))


def _spread(points: np.ndarray, count: int) -> np.ndarray:
    """Places of routing points, each the farthest from those before it."""
    chosen = [0]
    far = _distances(points, points[:1])[:, 0]
    while len(chosen) < count and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(points, points[chosen[-1]:chosen[-1] + 1])[:, 0])
    return np.array(chosen)


# --- building --------------------------------------------------------------------------


def quantise(table: DataFrame, key: str, vector: str, settings: Settings) -> DataFrame:
    """``id``, ``dim``, ``v`` (whole numbers), ``squares`` (length squared) of the vectors that take part, each once."""
    number = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    told = table.select(F.col(key).alias("id"), number.alias("x"), finite.alias("ok"))
    told = told.where("id is not null and x is not null and ok and size(x) > 0")
    whole = F.transform("x", lambda x: F.floor(x * settings.scale).cast("bigint"))
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return told.select(F.col("id").cast("bigint").alias("id"), F.size("x").alias("dim"), whole.alias("v")).distinct().withColumn(
        "squares", squares
    )


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _pages(vectors: np.ndarray, lifted: np.ndarray, page: int) -> list[np.ndarray]:
    """Rows of each page: nearest of some routing points, cut at the capacity by distance."""
    if len(vectors) <= page:
        return [np.arange(len(vectors))]
    step = max(1, len(vectors) // math.ceil(2 * len(vectors) / page))
    centres = lifted[::step]
    far = _distances(lifted, centres)
    nearest, own = far.argmin(1), far.min(1)
    out = []
    for c in np.unique(nearest):
        rows = np.flatnonzero(nearest == c)
        rows = rows[np.argsort(own[rows], kind="stable")]
        out += [rows[i:i + page] for i in range(0, len(rows), page)]
    return out


def build(quantised: DataFrame, dim: int, rows: int, reach: float, settings: Settings) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The stored subtrees of all vectors of one dimension, and the sampled vectors with their ids."""
    most = max(settings.routing, settings.seeds)
    drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < min(1 << 30, (most << 30) // rows + 1)
    sample = quantised.where(drawn).select("id", "v").orderBy(F.xxhash64("id"), "id").limit(most).toArrow()
    if not sample.num_rows:
        sample = quantised.select("id", "v").limit(1).toArrow()
    sample_ids = sample["id"].to_numpy()
    sampled = _matrix(sample["v"].combine_chunks(), dim)
    lifted = _lift(sampled[: settings.routing], reach)
    routing = lifted[_spread(lifted, min(len(lifted), max(1, rows // settings.subtree)))]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(a, BATCH_ROWS)
                cell = _distances(_lift(_matrix(part.column(1), dim), reach), routing).argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell)], ["id", "v", "cell"])

    placed = materialise(
        quantised.select("id", "v").mapInArrow(assign, "id bigint, v array<bigint>, cell bigint"), "cells"
    )
    # A crowded cell, as around a vector that many rows share, becomes several subtrees of one centre.
    sizes = dict(placed.groupBy("cell").count().collect())  # one row per routing vector
    parts = F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (c, math.ceil(n / settings.subtree))])
    salted = placed.withColumn("part", F.pmod(F.xxhash64("id"), parts[F.col("cell")]))

    def grow(group: pa.Table) -> pa.Table:
        ids = group["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], _matrix(group["v"].combine_chunks(), dim)[order]
        points, cell = _lift(vectors, reach), group["cell"][0].as_py()
        leaves = _pages(vectors, points, settings.page)
        rows = np.concatenate(leaves)
        centres = np.array([leaf[len(leaf) // 2] for leaf in leaves])
        near = [_distances(points[leaf], points[[c]])[:, 0] for leaf, c in zip(leaves, centres)]
        pack = {
            "ids": ids[rows], "vectors": vectors[rows], "sizes": np.array([len(x) for x in leaves], np.int64),
            "centres": points[centres], "radii": np.array([x.max() for x in near]), "near": np.concatenate(near),
            "parents": _distances(points[centres], routing[[cell]])[:, 0], "root": routing[cell],
            "radius": _distances(points, routing[[cell]]).max(),
        }
        return pa.table({k: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for k, x in pack.items()})

    schema = ", ".join(f"{c} binary" for c in (
        "ids", "vectors", "sizes", "centres", "radii", "near", "parents", "root", "radius"
    ))
    return materialise(salted.groupBy("cell", "part").applyInArrow(grow, schema), "subtrees"), sample_ids, sampled


# --- searching -------------------------------------------------------------------------


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, reach: float):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.points = np.column_stack([vectors.astype(float), np.zeros(len(vectors))])
        self.base = (self.points**2).sum(1) + reach**2
        self.slack = 1e-6 * max(reach, 1.0) + 1e-6 * np.sqrt(self.base)
        self.floor = np.full(len(ids), np.iinfo(np.int64).min)  # a score that k candidates are known to reach
        self.score = np.full((len(ids), k), np.iinfo(np.int64).min)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def seed(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        for a in range(0, len(self.ids), BATCH_ROWS):
            score = products(self.vectors[a:a + BATCH_ROWS], vectors)
            score[ids[None] == self.ids[a:a + BATCH_ROWS, None]] = np.iinfo(np.int64).min
            if score.shape[1] >= self.k:
                self.floor[a:a + BATCH_ROWS] = np.partition(score, -self.k, axis=1)[:, -self.k]

    def limit(self) -> np.ndarray:
        """Distance beyond which an entry cannot be among the best."""
        least = np.maximum(self.floor, self.score[:, -1])
        squares = self.base - 2.0 * least
        return np.where(least == np.iinfo(np.int64).min, np.inf, np.sqrt(np.maximum(squares, 0))) + self.slack

    def take(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        score = products(self.vectors[rows], vectors)
        own = ids[None] == self.ids[rows, None]
        bar = np.maximum(self.floor[rows], self.score[rows, -1])
        hit = (score >= bar[:, None]) & ~own
        some = hit.any(1)
        if not some.any():
            return
        rows, score, hit = rows[some], score[some], hit[some]
        score = np.concatenate([self.score[rows], np.where(hit, score, np.iinfo(np.int64).min)], 1)
        found = np.concatenate([self.found[rows], np.where(hit, ids[None], np.iinfo(np.int64).max)], 1)
        order = np.lexsort((found, -np.maximum(score, -np.iinfo(np.int64).max)), axis=1)[:, : self.k]
        self.score[rows] = np.take_along_axis(score, order, 1)
        self.found[rows] = np.take_along_axis(found, order, 1)


def search(best: Best, tree: dict[str, np.ndarray]) -> None:
    """All queries against one subtree, its most promising pages first."""
    root, limit = tree["root"][None], best.limit()
    to_root = _distances(best.points, root)[:, 0]
    reached = np.flatnonzero(to_root - tree["radius"][0] <= limit)
    if not len(reached):
        return
    # Known without a distance to the page: |d(query, root) - d(page, root)| - radius.
    least = np.abs(to_root[reached, None] - tree["parents"][None]) - tree["radii"][None]
    first = np.cumsum(tree["sizes"]) - tree["sizes"]
    for p in np.argsort(least.min(0), kind="stable"):
        rows = reached[least[:, p] <= best.limit()[reached]]
        if not len(rows):
            continue
        far = _distances(best.points[rows], tree["centres"][[p]])[:, 0]
        open_ = far - tree["radii"][p] <= best.limit()[rows]
        rows, far = rows[open_], far[open_]
        if not len(rows):
            continue
        entries = slice(first[p], first[p] + tree["sizes"][p])
        close = np.abs(far[:, None] - tree["near"][entries][None]) <= best.limit()[rows, None]
        wanted, asked = close.any(0), close.any(1)
        best.take(rows[asked], tree["ids"][entries][wanted], tree["vectors"][entries][wanted])


def _tree(row: dict[str, bytes], dim: int) -> dict[str, np.ndarray]:
    whole = ("ids", "vectors", "sizes")
    tree = {k: np.frombuffer(x, np.int64 if k in whole else float) for k, x in row.items()}
    tree["vectors"] = tree["vectors"].reshape(-1, dim)
    tree["centres"] = tree["centres"].reshape(-1, dim + 1)
    return tree


def top_k(
    table: DataFrame, queries: DataFrame, k: int = 20, settings: Settings = Settings(), key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k rows of ``table`` with the greatest inner products.

    Scores are inner products of quantised vectors, ties go to the smaller id, and a row with the query's own id
    is no candidate.  Vectors that are NULL, empty, or hold NULL or non-finite components take no part, nor do rows
    with a NULL key.  Vectors of different dimension are never compared.  Rows equal in key and vector
    count once; several vectors of one key are all candidates, and as queries share one list.  A query with
    fewer candidates than k gets them all; empty tables give no rows; other columns are not read.
    """
    spark = table.sparkSession
    stored = materialise(quantise(table, key, vector, settings), "quantised")
    asked = materialise(quantise(queries, key, vector, settings), "queries")
    kinds = stored.groupBy("dim").agg(F.count(F.lit(1)), F.max("squares")).collect()
    result = None
    for dim, rows, squares in sorted(kinds):
        own = stored.where(F.col("dim") == dim)
        mine = asked.where(F.col("dim") == dim)
        rounds = math.ceil(mine.count() / settings.round_queries)
        if not rounds:
            continue
        reach = math.sqrt(squares) * (1 + 1e-12)
        subtrees, sample_ids, sampled = build(own, dim, rows, reach, settings)
        seeds = (sample_ids[: settings.seeds], sampled[: settings.seeds])
        for r in range(rounds):
            chunk = mine.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == r).select("id", "v").toArrow()
            if chunk.num_rows:
                sent = spark.sparkContext.broadcast(
                    (chunk["id"].to_numpy(), _matrix(chunk["v"].combine_chunks(), dim), seeds)
                )
                found = subtrees.mapInArrow(_searcher(sent, dim, k, reach), "query_id bigint, vec_id bigint, score bigint")
                result = found if result is None else result.unionByName(found)
    if result is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = result.withColumn("rank", F.row_number().over(place))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searcher(sent, dim: int, k: int, reach: float):
    """Search of a task's subtrees for all queries of a round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, seeds = sent.value
        best = Best(ids, vectors, k, reach)
        best.seed(*seeds)
        for batch in batches:
            for i in range(batch.num_rows):
                search(best, _tree({n: batch.column(c)[i].as_py() for c, n in enumerate(batch.schema.names)}, dim))
        row, col = np.nonzero(best.found != np.iinfo(np.int64).max)
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.ids[row]), pa.array(best.found[row, col]), pa.array(best.score[row, col])],
            ["query_id", "vec_id", "score"],
        )

    return run
