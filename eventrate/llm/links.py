"""Groups of alike records from shared bucket keys, without forming all pairs of a bucket.

Members of a bucket are first compared with one of them only.  Whatever that unites is one group
from then on, and only pairs of different groups in one bucket are looked at again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventrate.runtime import materialise

STAR_ROUNDS = 2
PAIRED = 8  # largest bucket whose pairs are listed at once


def components(edges: DataFrame) -> DataFrame:
    """``node`` and the smallest node reachable from it, ``component``, for all ends of ``edges`` (a, b).

    Alternates the large-star and small-star steps of Kiveris et al. until every node hangs on the root of its group.
    Each round is stored, so a lost executor repeats one round at most.
    """
    apart = F.col("a") != F.col("b")
    current = materialise(
        edges.where(apart).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    while not _is_forest(current):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _is_forest(edges: DataFrame) -> bool:
    """Whether every node hangs on one root that hangs on nothing."""
    seen = edges.select("u", F.lit(1).alias("below")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("below")).distinct())
    return seen.groupBy("u").agg(F.sum("below").alias("up"), F.min("below").alias("root")).where("up > 1 or up > 0 and root = 0").isEmpty()


def group(
    members: DataFrame, attributes: DataFrame, may_link: Callable[[str, str], Column],
    prepare: Callable[[DataFrame], DataFrame], confirm: Callable[[DataFrame, DataFrame], DataFrame],
) -> DataFrame | None:
    """``node`` and ``component`` of every node that is linked with another one; None if there is no link.

    ``members`` has ``key`` and ``node`` and should be cheap to read twice.  ``attributes`` has one row per
    ``node``; ``may_link(x, y)`` reads them with the name prefixes of two sides and rules pairs out early.
    ``prepare`` gets the nodes that share a key with another one, once, and returns what ``confirm`` needs of them.
    ``confirm`` gets stored pairs (a, b) with a < b, never none, and that, and returns those that are linked.  Two
    nodes are compared if they share a key, may link and are not yet in one group.
    """
    # Buckets of one node, by far the most, end here; the others are stored once.
    shared = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("_size"), F.min("node").alias("_centre"), F.max("node").alias("_last")
    ).where("_centre <> _last").drop("_last")
    held = materialise(members.join(shared, "key").join(attributes, "node"), "buckets")
    ready: list[DataFrame] = []
    plain = [c for c in attributes.columns if c != "node"]
    other = [F.col(c).alias(f"_c_{c}") for c in plain]

    def compare(pairs: DataFrame, edges: DataFrame | None) -> DataFrame | None:
        near = pairs.where(may_link("", "_c_")).select(
            F.least("node", "_centre").alias("a"), F.greatest("node", "_centre").alias("b")
        )
        near = materialise(near.distinct(), "pairs")
        if near.isEmpty():
            return edges
        if not ready:
            ready.append(prepare(held.select("node").distinct()))
        found = confirm(near, ready[0])
        return materialise(found if edges is None else found.unionByName(edges), "links")

    def with_centre(rows: DataFrame) -> DataFrame:
        centres = attributes.select(F.col("node").alias("_centre"), *other)
        return rows.where("node <> _centre").select("node", "_centre", *plain).distinct().join(centres, "_centre")

    # Small buckets give their pairs at once; they are done with the first comparison.
    small, large = (held.where(F.col("_size") <= PAIRED), held.where(F.col("_size") > PAIRED).drop("_size"))
    mates = small.select("key", F.col("node").alias("_centre"), *other)
    pairs = small.select("key", "node", *plain).join(mates, "key").where("node < _centre").drop("key")
    edges = compare(pairs.unionByName(with_centre(large)), None)
    for _ in range(STAR_ROUNDS):
        if edges is None:
            labelled = large.withColumn("component", F.col("node"))
        else:
            labelled = large.drop("component").join(components(edges), "node", "left")
            labelled = labelled.withColumn("component", F.coalesce("component", "node"))
        ends = labelled.groupBy("key").agg(F.min("component").alias("_low"), F.max("component").alias("_high"))
        several = labelled.drop("_centre").join(ends.where("_low <> _high").drop("_high"), "key")
        # Next centre: the first member outside the group of the bucket's lowest.
        centres = several.where("component <> _low").groupBy("key").agg(F.min("node").alias("_centre"))
        large = materialise(several.drop("_low").join(centres, "key"), "buckets")
        if large.isEmpty():
            return None if edges is None else components(edges)
        # The last step takes all pairs that are left; where they are few, another star would only take time.
        sizes = large.groupBy("key").count().agg(F.sum("count"), F.sum(F.col("count").cast("double") * F.col("count"))).first()
        if sizes[1] <= max(PAIRED * sizes[0], held.count()):
            break
        edges = compare(with_centre(large), edges)
    # What is left: members of different groups that share a bucket.
    if edges is not None:
        large = large.drop("component").join(components(edges), "node", "left")
        large = large.withColumn("component", F.coalesce("component", "node"))
    left = large.select("key", "node", "component", *plain)
    mates = left.select("key", F.col("node").alias("_centre"), F.col("component").alias("_other"), *other)
    apart = left.join(mates, "key").where("node < _centre and component <> _other").select(
        "node", "_centre", *plain, *[f"_c_{c}" for c in plain]
    )
    edges = compare(apart, edges)
    return None if edges is None else components(edges)
