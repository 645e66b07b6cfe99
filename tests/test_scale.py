"""What must hold whatever the size: parts, comparisons and passes that do not grow."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from eventrate.functions.numeric import rate_gap
from eventrate.operators import levels, model, profile, rank
from eventrate.runtime import Limits, discard, materialise, passing_tables


def test_running_sums_over_many_parts(spark, monkeypatch):
    """More than 10,000 parts, by borders in two stages; nothing is stored."""
    import eventrate.runtime

    monkeypatch.setattr(eventrate.runtime, "scratch_path", lambda *a: pytest.fail("nothing is to be stored"))
    rows = 1_100_000
    df = spark.range(rows).select((F.col("id") * 7919 % rows).alias("v"), F.lit(2).cast("bigint").alias("two"))
    got = rank.running_sums(df, ["v"], {"before": "two"}, Limits(task_rows=100))
    assert got.where("before <> 2 * v").count() == 0
    parts = rank.label_parts(df, ["v"], 11_000, rows, Limits(task_rows=100)).groupBy("_part").count()
    found = parts.agg(F.count(F.lit(1)).alias("parts"), F.max("count").alias("most")).first()
    assert found.parts > 10_000 and found.most < 100 * 15


def test_running_sums_of_odd_orders(spark):
    draw = random.Random(4)
    rows = [(draw.choice([None, "a", "b", "", "é"]), draw.choice([None, -0.0, 0.0, float("nan"), 1.5, -3.0]), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, v double, id bigint").repartition(7)
    got = rank.global_rank(df, ["g", "v", "id"], "r", Limits(task_rows=60))
    plain = df.withColumn("p", F.row_number().over(Window.orderBy("g", "v", "id"))).select("id", "p")
    assert got.count() == 4000 and got.join(plain, "id").where("r <> p").count() == 0
    # Rows of equal first values, a third of all, are told apart by the next column.
    assert rank.label_parts(df, ["g", "v", "id"], 66, 4000, Limits(task_rows=60)).groupBy("_part").count().agg(F.max("count")).first()[0] < 900


def test_samples_of_long_texts_are_bounded_in_bytes(spark, monkeypatch):
    """Texts of 100 kB as key of equal values: what the driver gets stays within its bytes."""
    limits = Limits(task_rows=50, sample_rows=1000, sample_bytes=1_500_000)
    df = spark.range(600).select(
        (F.col("id") % 3).alias("v"), F.concat(F.sha2(F.col("id").cast("string"), 256), F.repeat(F.lit("x"), 100_000)).alias("k")
    ).repartition(4)
    sizes, plain = [], rank._sample

    def watched(*args):
        drawn = plain(*args)
        sizes.append(sum(len(t) for t in drawn["_key0"].to_pylist()))
        return drawn

    monkeypatch.setattr(rank, "_sample", watched)
    tiles = rank.ntile(df, "v", 4, "k", limits=limits).groupBy("tile").count().collect()
    assert sorted(r["count"] for r in tiles) == [150] * 4
    assert sizes and max(sizes) <= limits.sample_bytes


def test_rates_are_compared_as_fractions(spark):
    draw = random.Random(2)
    rows = []
    for _ in range(400):
        n, on = draw.randint(1, 10**12), draw.randint(1, 10**12)
        e, oe = draw.randint(0, n), draw.randint(0, on)
        rows.append((e, n, oe, on, abs(Fraction(oe, on) - Fraction(e, n)) * on, Fraction(e, n) > Fraction(oe, on)))
    df = spark.createDataFrame([r[:4] for r in rows], "e bigint, n bigint, oe bigint, on bigint")
    gap, above = rate_gap(F.lit(None), "e", "n", {"events": F.col("oe"), "total": F.col("on")}, None)
    got = df.select(gap.alias("gap"), above.alias("above")).collect()
    for r, (*_, distance, over) in zip(got, rows):
        digits = r.gap.p0 * 10**24 + r.gap.p1 * 10**12 + r.gap.p2
        assert digits == math.floor(distance * 10**24) and r.above == over


def test_nearest_of_rates_that_differ_after_the_ninth_digit(spark):
    million = 1_000_000_007
    rows = [("x", "far", 500_000_000, million), ("x", "near", 500_000_001, million + 2), ("x", None, 500_000_001, million + 3)]
    rates = spark.createDataFrame(rows, "var_name string, level string, events bigint, total bigint")
    rates = rates.withColumns({"rate": F.col("events") / F.col("total"), "total_levels": F.lit(3).cast("bigint")})
    exact = min(rows[:2], key=lambda r: abs(Fraction(r[2], r[3]) - Fraction(rows[2][2], rows[2][3])))[1]
    assert [r.receiver for r in levels.null_receivers(rates, digits=None).collect()] == [exact]


def test_correlations_of_few_and_many_columns_agree(spark, monkeypatch):
    draw = random.Random(1)
    rows = [tuple(draw.choice([None, draw.gauss(5, 2)]) for _ in range(4)) + (3.0,) for _ in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, k double")

    def found():
        return {(r.var_1, r.var_2): r["corr"] for r in profile.corr_matrix(df, df.columns).collect()}

    few = found()
    monkeypatch.setattr(profile, "PAIRS_AT_ONCE", 0)
    many = found()
    assert few.keys() == many.keys()
    assert all(many[k] == few[k] or many[k] == pytest.approx(few[k], abs=1e-9) for k in few)


def test_texts_stay_out_of_the_join(spark):
    from eventrate.plans import prepare_queries

    folder = "/root/testdata/sf0.001"
    plan = prepare_queries.labelled(spark, folder, texts=False)._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join")
    assert "sha2" in plan[join:] and "sha2" not in plan[:join]


def test_stored_tables_can_be_let_go(spark):
    with passing_tables() as keep:
        gone, stays = materialise(spark.range(5)), keep(materialise(spark.range(7)))
    assert stays.count() == 7
    with pytest.raises(Exception):
        spark.read.parquet(gone._stored_at).count()
    discard(stays)


# --- fits --------------------------------------------------------------------------------


def _study(spark, rows=1200):
    draw = random.Random(9)
    out = []
    for i in range(rows):
        a, b, g, h = draw.gauss(0, 1), draw.uniform(2000, 2010), draw.choice("pqrs"), draw.choice("xyz")
        eta = -0.3 + 0.7 * a + 0.6 * (g == "q") - 0.2 * (h == "z")
        out.append((i, a, b, draw.gauss(0, 1), draw.choice("uv"), g, h, int(draw.random() < 1 / (1 + math.exp(-eta)))))
    return spark.createDataFrame(out, "id bigint, a double, b double, n double, m string, g string, h string, e int").repartition(4)


def test_screened_search_takes_the_path_of_the_whole_one(spark, monkeypatch):
    df, terms = _study(spark), ["a", "b", "n", "m", "g", "h"]
    screened = model.stepwise(df, "e", terms)
    monkeypatch.setattr(model, "_drop_bounds", lambda design, current, moves: dict.fromkeys(moves, -math.inf))
    whole = model.stepwise(df, "e", terms)
    one, all_ = ([(r.step, r.move, r.term) for r in s.steps.orderBy("step").collect()] for s in (screened, whole))
    assert one == all_ and len(one) > 2
    assert screened.model.aic == pytest.approx(whole.model.aic, abs=1e-7)
    spent = [s.steps.agg(F.max("fits")).first()[0] for s in (screened, whole)]
    assert spent[0] <= len(one) + 3 and spent[1] > 2 * spent[0]


def test_bounds_hold(spark):
    df, terms = _study(spark, 300), ["a", "b", "n", "m", "g", "h"]
    design = model._design(df, "e", terms)
    (solved,) = model._solve(design, [model._problem(design.usable)])
    current = model._Fitted(terms, design.usable, solved, solved.deviance)
    least = model._drop_bounds(design, current, terms)
    for t in terms:
        use = [i for i in design.usable if design.parts[i][0] != t]
        (less,) = model._solve(design, [model._problem(use)])
        exact = less.deviance + 2.0 * (len(use) + 1)
        assert least[t] <= exact + 1e-6
    design.release()


def test_fits_shuffle_no_rows(spark):
    design = model._design(_study(spark), "e", ["a", "n", "g"])
    plan = design.data._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "MapInArrow" in plan
    design.release()


def test_equal_rows_are_summed_in_the_task(spark):
    df = spark.range(50_000).select((F.col("id") % 7).alias("k"), (F.col("id") % 3).cast("string").alias("g"), (F.col("id") % 2).alias("e")).coalesce(2)
    design = model._design(df, "e", ["k", "g"])
    assert design.data.count() <= 2 * 21 and design.rows == 50_000 and design.events == 25_000
    design.release()
