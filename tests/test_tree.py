"""The tree against a plain version that tries every split of every node."""

import math
import random

import pytest
from pyspark.sql import functions as F

from eventrate.operators import tree

TERMS = ["x", "g", "k", "z"]
SCHEMA = "x double, g string, k int, z double, e int"


def purity(e, n):
    return (e * e + (n - e) ** 2) / n if n else 0.0


def gain(left, rows):
    e, n = sum(r["e"] for r in left), len(left)
    all_e, all_n = sum(r["e"] for r in rows), len(rows)
    return purity(e, n) + purity(all_e - e, all_n - n) - purity(all_e, all_n)


def agreeing(left, rows):
    """Rows sent alike by a cut and by ``side``, in the better direction, and whether it is turned round."""
    same = sum(r["side"] for r in left) + sum(not r["side"] for r in rows) - sum(not r["side"] for r in left)
    return max(same, len(rows) - same), same < len(rows) - same


def cuts(rows, term):
    values = sorted({r[term] for r in rows})
    for low, high in zip(values, values[1:]):
        yield (low + high) / 2, [r for r in rows if r[term] <= low]


def best_split(rows, least):
    found = None
    for term in TERMS:
        there = [r for r in rows if r[term] is not None]
        options = []
        if term == "g":
            levels = sorted({r["g"] for r in there}, key=lambda g: (sum(r["e"] for r in there if r["g"] == g) / sum(r["g"] == g for r in there), g))
            options = [(frozenset(levels[:i]), [r for r in there if r["g"] in levels[:i]]) for i in range(1, len(levels))]
        else:
            options = cuts(there, term)
        for where, left in options:
            if len(left) < least or len(there) - len(left) < least:
                continue
            score = gain(left, there)
            if score > 1e-9 and (found is None or score > found[0] * (1 + 1e-9)):
                found = (score, term, where)
    return found


def goes_left(test, row):
    term, where, turned = test
    if row[term] is None:
        return None
    return (row[term] in where if term == "g" else row[term] <= where) != turned


def surrogates(rows, split, most, seen_all):
    there = [r | {"side": goes_left((split[1], split[2], False), r)} for r in rows if r[split[1]] is not None]
    majority = 2 * sum(r["side"] for r in there) >= len(there)
    found = []
    for place, term in enumerate(TERMS):
        if term == split[1]:
            continue
        both = [r for r in there if r[term] is not None]
        blind = max(sum(r["side"] for r in both), sum(not r["side"] for r in both))
        best = None
        if term == "g":
            levels = {r["g"] for r in both}
            left = frozenset(g for g in levels if 2 * sum(r["side"] for r in both if r["g"] == g) > sum(r["g"] == g for r in both))
            rows_left = sum(r["g"] in left for r in both)
            score = sum(max(sum(r["side"] for r in both if r["g"] == g), sum(not r["side"] for r in both if r["g"] == g)) for g in levels)
            if min(rows_left, len(both) - rows_left) >= 2:
                best = (score, left | (seen_all - levels) if majority else left, False)
        else:
            for where, left in cuts(both, term):
                if min(len(left), len(both) - len(left)) < 2:
                    continue
                score, turned = agreeing(left, both)
                if best is None or score > best[0]:
                    best = (score, where, turned)
        if best and best[0] > blind:
            found.append((-best[0], place, (term, best[1], best[2])))
    return [t for _, _, t in sorted(found, key=lambda f: f[:2])[:most]], majority


def grow(rows, whole, cp, least=7, min_split=20, depth=0, most=5, max_depth=30):
    node = {"e": sum(r["e"] for r in rows), "n": len(rows), "kids": []}
    risk = min(node["e"], node["n"] - node["e"])
    if len(rows) < min_split or risk <= cp * whole or depth == max_depth:
        return node
    split = best_split(rows, least)
    if not split:
        return node
    levels = {r["g"] for r in ALL if r["g"] is not None}
    others, majority = surrogates(rows, split, most, levels)
    where = split[2]
    if split[1] == "g" and majority:
        where = where | (levels - {r["g"] for r in rows if r["g"] is not None})
    tests = [(split[1], where, False), *others]
    sides = ([], [])
    for r in rows:
        side = next((s for t in tests if (s := goes_left(t, r)) is not None), majority)
        sides[not side].append(r)
    node["test"], node["tests"] = tests[0], tests
    node["kids"] = [grow(side, whole, cp, least, min_split, depth + 1, most, max_depth) for side in sides]
    return node


def prune(node, limit):
    """Cut the weakest splits, one at a time, while they are worth no more than ``limit``."""
    def walk(n):
        if not n["kids"]:
            return min(n["e"], n["n"] - n["e"]), 1, []
        below = [walk(k) for k in n["kids"]]
        risk, leaves = sum(b[0] for b in below), sum(b[1] for b in below)
        own = (min(n["e"], n["n"] - n["e"]) - risk) / (leaves - 1)
        return risk, leaves, [(own, n), *below[0][2], *below[1][2]]

    while True:
        found = walk(node)[2]
        if not found:
            return
        worth, weakest = min(found, key=lambda f: f[0])
        if worth > limit * (1 + 1e-9):
            return
        weakest["kids"] = []


def leaves(node):
    return [x for k in node["kids"] for x in leaves(k)] or [(node["e"], node["n"])]


def make(seed, rows, holes):
    draw = random.Random(seed)
    out = []
    for _ in range(rows):
        x, z, g, k = draw.gauss(0, 1), draw.choice([0.0, 1.5, 2.25, draw.random()]), draw.choice("abcdef"), draw.randint(0, 9)
        chance = 0.15 + 0.35 * (x > 0.3) + 0.3 * (g in "bd") * (k > 3)
        row = {"x": x + 0.2 * z, "g": g, "k": k, "z": z + 0.3 * (x > 0.3) + 0.2 * draw.random(), "e": int(draw.random() < chance)}
        for term in TERMS:
            if draw.random() < holes:
                row[term] = None
        out.append(row)
    return out


ALL = []


@pytest.mark.parametrize("seed, rows, holes, cp", [(1, 900, 0.0, 0.02), (2, 700, 0.15, 0.03), (3, 1000, 0.3, 0.02), (4, 200, 0.1, 0.0)])
def test_against_every_split(spark, seed, rows, holes, cp):
    data = make(seed, rows, holes)
    df = spark.createDataFrame([tuple(r[c] for c in (*TERMS, "e")) for r in data], SCHEMA).repartition(5)
    kept = [r for r in data if any(r[t] is not None for t in TERMS)]
    ALL[:] = kept
    events = sum(r["e"] for r in kept)
    whole = min(events, len(kept) - events)
    want = grow(kept, whole, cp)
    prune(want, cp * whole)
    fit = tree.fit_tree(df, "e", TERMS, cp=cp, folds=0)
    got = fit.rules.orderBy("leaf").collect()
    assert [(r.events, r.total) for r in got] == leaves(want)
    assert len(got) > 3
    # The rules give every row its leaf, also those with missing values.
    usable = df.dropna("all", subset=TERMS)
    counts = usable.select(*[F.expr(f"({r.rule})").cast("int").alias(f"l{r.leaf}") for r in got])
    sums = counts.agg(*[F.sum(c) for c in counts.columns]).first()
    assert list(sums) == [r.total for r in got]
    assert counts.where(F.coalesce(sum(F.col(c) for c in counts.columns), F.lit(0)) != 1).count() == 0
    assert (fit.surrogates.count() > 0) == (holes > 0)


def test_outer_values_are_tried(spark):
    """The best cut lies among the last 1 % of many different values, far from any quantile."""
    df = spark.range(40_000).select(
        (F.col("id") * F.col("id") / 7).alias("v"), ((F.col("id") >= 39_873) | (F.col("id") % 50 == 0)).cast("int").alias("e")
    )
    rules = tree.fit_tree(df, "e", max_depth=1, cp=0.0, max_bins=8, folds=0).rules.orderBy("leaf").collect()
    border = (39_872**2 / 7 + 39_873**2 / 7) / 2
    assert [r.total for r in rules] == [39_873, 127]
    assert float(rules[0].rule.split("<= ")[1]) == pytest.approx(border, rel=1e-12)


def test_nodes_do_not_grow_with_the_rows(spark, monkeypatch):
    """Noise: what the driver grows is bounded by the complexity, whatever the number of rows."""
    seen = []
    plain = tree._Grower.grow

    def counted(self):
        trees = plain(self)
        seen.append(sum(len(t.inner()) for t in trees))
        return trees

    monkeypatch.setattr(tree._Grower, "grow", counted)
    for rows in (1_000, 6_000):
        noise = spark.range(rows).select(
            (F.xxhash64("id", F.lit(1)) % 100_003).alias("a"), (F.xxhash64("id", F.lit(2)) % 100_003).alias("b"),
            (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(10)) < 4).cast("int").alias("e"),
        )
        fit = tree.fit_tree(noise, "e", cp=0.1, folds=0)
        assert sum(r.total for r in fit.rules.collect()) == rows
    assert max(seen) <= 10 * 30 and seen[1] <= 2 * seen[0] + 20


def test_cross_validated_table(spark):
    df = spark.createDataFrame([tuple(r[c] for c in (*TERMS, "e")) for r in make(6, 1500, 0.1)], SCHEMA)
    fits = [tree.fit_tree(d, "e", TERMS, cp=0.03, max_depth=3, folds=4) for d in (df.repartition(3), df.repartition(11))]
    table, again = (f.complexity.orderBy("splits").collect() for f in fits)
    assert table == again
    assert table[0].splits == 0 and table[0].rel_error == 1.0 and table[0].xerror == pytest.approx(1.0, abs=0.02)
    rows, whole = fits[0].root.total, fits[0].root.risk
    for r in table:
        wrong = r.xerror * whole
        assert wrong == pytest.approx(round(wrong), abs=1e-6) and r.xstd == pytest.approx(math.sqrt(wrong - wrong**2 / rows) / whole)
    # Real structure is found by trees that have not seen the rows, and noise below it is not.
    assert min(r.xerror for r in table) < 0.95 and table[-1].xerror > table[-1].rel_error - 0.02
    # Pure noise is not predictable.
    noise = spark.range(3000).select((F.xxhash64("id") % 1000).alias("v"), (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(3)) == 0).cast("int").alias("e"))
    assert all(r.xerror >= 0.97 for r in tree.fit_tree(noise, "e", cp=0.01, max_depth=3, folds=3).complexity.collect())


def test_folds_deal_every_row_once():
    import numpy as np

    draw = np.random.default_rng(1)
    total = draw.integers(1, 40, 200)
    data = tree._Rows([], [], draw.integers(0, total + 1), total, draw.integers(0, 10, 200), 10)
    parts = [data.fold(k) for k in range(10)]
    assert (sum(p[0] for p in parts) == data.events).all() and (sum(p[1] for p in parts) == data.total).all()
    assert all((n - e >= 0).all() and (np.abs(n - total / 10) < 2).all() for e, n in parts)


def test_rows_without_any_value(spark):
    df = spark.range(60).select(
        F.lit(None).cast("string").alias("g"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("v"), (F.col("id") >= 30).cast("int").alias("e")
    )
    rules = tree.fit_tree(df, "e", folds=0).rules.orderBy("leaf").collect()
    # Twenty rows lack the only value there is; they are left out.
    assert [(r.total, r.rule) for r in rules] == [(20, "v <= 30.0"), (20, "v > 30.0")]
    with pytest.raises(ValueError):
        tree.fit_tree(df.where("v is null"), "e")


def test_levels_and_numbers_with_odd_texts(spark):
    df = spark.range(400).select(
        F.element_at(F.array(F.lit("o'x"), F.lit("a\\b"), F.lit(""), F.lit("é")), (F.col("id") % 4 + 1).cast("int")).alias("g"),
        F.when(F.col("id") % 5 == 0, float("nan")).when(F.col("id") % 7 == 0, float("-inf")).otherwise(F.col("id").cast("double")).alias("v"),
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("w"),
    ).withColumn("e", (F.col("g").isin("o'x", "") | F.isnan("v")).cast("int"))
    fit = tree.fit_tree(df, "e", cp=0.0, folds=3)
    rules = fit.rules.collect()
    assert [df.where(r.rule).count() for r in rules] == [r.total for r in rules]
    assert all(r.events in (0, r.total) for r in rules)
