import random

import pytest
from pyspark.sql import functions as F

from eventrate.operators import bins
from eventrate.runtime import Limits

TINY = Limits(task_rows=4, sample_rows=100)


def fixture(spark, null_events):
    xs = [0, 0, 0, 0, 1, 2, 3, 4, 5, 6]
    es = [1, 0, 0, 0, 0, 1, 1, 1, 0, 0]
    rows = [(i, float(x), e) for i, (x, e) in enumerate(zip(xs, es))]
    rows += [(10 + i, None, int(i < null_events[0])) for i in range(null_events[1])]
    return spark.createDataFrame(rows, "id bigint, x double, e int")


@pytest.mark.parametrize("limits", [Limits(), TINY])
def test_adaptive_bins_and_null_bin(spark, limits):
    df = fixture(spark, (1, 2))
    assert bins.choose_bins(df, ["x"], limits=limits) == {"x": 2}
    table = {r["bin"]: r for r in bins.bin_event_table(df, "e", ["x"], key="id", limits=limits).collect()}
    assert sorted(table, key=str) == [1, 2, None]
    assert [(table[b]["events"], table[b]["total"], table[b]["mean"]) for b in (1, 2)] == [(1, 5, 0.2), (3, 5, 4.0)]
    assert (table[None]["rate"], table[None]["mean"], table[None]["levels"]) == (0.5, None, 3)


@pytest.mark.parametrize("nulls,fill", [((1, 2), 4.0), ((2, 5), 0.2)])
def test_null_imputation_by_nearest_bin(spark, nulls, fill):
    df = fixture(spark, nulls)
    table = bins.bin_event_table(df, "e", ["x"], key="id")
    done = bins.impute_null_by_bin(df, table)
    assert {r["x"] for r in done.where("id >= 10").collect()} == {fill}


def test_equally_near_bins_below_are_averaged(spark):
    rows = [(1, 0.3, 1.0), (2, 0.3, 5.0), (3, 0.5, 9.0), (None, 0.4, None)]
    table = spark.createDataFrame([("x", *r) for r in rows], "var_name string, bin bigint, rate double, mean double")
    assert [r["fill"] for r in bins.null_fill_values(table).collect()] == [3.0]
    above = table.where("bin is null or bin = 3")
    assert [r["fill"] for r in bins.null_fill_values(above).collect()] == [9.0]


def test_no_null_means_no_imputation(spark):
    df = fixture(spark, (0, 0))
    table = bins.bin_event_table(df, "e", ["x"], key="id")
    null_bin = table.where("bin is null").first()
    assert (null_bin["total"], null_bin["rate"], null_bin["events"]) == (None, None, 0)
    assert bins.impute_null_by_bin(df, table) is df


def test_all_equal_all_zero_and_all_null(spark):
    df = spark.createDataFrame([(i, 0.0, 7.0, None, i % 2) for i in range(20)], "id bigint, z double, s double, n double, e int")
    assert bins.choose_bins(df, ["z", "s", "n"]) == {"z": 1, "s": 10, "n": 1}
    table = bins.bin_event_table(df, "e", ["z", "s", "n"], key="id")
    assert table.where("var_name = 's' and bin is not null").agg(F.sum("total")).first()[0] == 20
    assert table.where("var_name = 'n' and bin is null").first()["total"] == 20


def test_fixed_bins_without_key(spark):
    df = spark.createDataFrame([(1.0, i % 2) for i in range(10)], "x double, e int")
    table = bins.bin_event_table(df, "e", ["x"], bins=4, adaptive=False).orderBy("bin").collect()
    assert [r["total"] for r in table if r["bin"]] == [3, 3, 2, 2]
    series = bins.rate_series(bins.bin_event_table(df, "e", ["x"], bins=2, adaptive=False), "x").collect()
    assert [r["bin"] for r in series] == [1, 2]


@pytest.mark.parametrize("limits", [Limits(), TINY])
@pytest.mark.parametrize(
    "values,want",
    [
        ([1, 2, 3, 4, 5, 6, 7, 8, 9, 100], {100: 9}),
        ([-50, *range(2, 11)], {-50: 2}),
        ([5] * 7 + [100], {}),
    ],
)
def test_winsorise(spark, values, want, limits):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id int, v double")
    once = bins.winsorise(df, ["v"], limits=limits)
    got = [r["v"] for r in once.orderBy("id").collect()]
    assert got == [float(want.get(v, v)) for v in values]
    again = [r["v"] for r in bins.winsorise(once, ["v"]).orderBy("id").collect()]
    assert again == got


def test_winsorise_keeps_null_and_type(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 100, None])], "id int, v int")
    done = bins.winsorise(df, ["v"])
    assert dict(done.dtypes)["v"] == "int"
    assert [r["v"] for r in done.orderBy("id").collect()][-2:] == [9, None]


def test_median_imputation(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,), (None,)], "v double")
    assert sorted(r["v"] for r in bins.impute_median(df, "v").collect()) == [1.0, 2.0, 3.0, 4.0, 9.0]


def test_bins_of_many_columns_match_plain_ntile(spark):
    rng = random.Random(3)
    df = spark.createDataFrame(
        [(i, rng.choice([None, 0.0, rng.random()]), rng.randrange(5), rng.randrange(2)) for i in range(500)],
        "id bigint, a double, b bigint, e int",
    )
    table = bins.bin_event_table(df, "e", ["a", "b"], bins=5, adaptive=False, key="id", limits=TINY)
    df.createOrReplaceTempView("t")
    for c in ("a", "b"):
        plain = spark.sql(
            f"select t5 bin, sum(e) events, count(*) total from (select *, ntile(5) over (order by {c}, id) t5"
            f" from t where {c} is not null) group by 1"
        )
        got = table.where((F.col("var_name") == c) & F.col("bin").isNotNull()).select("bin", "events", "total")
        assert got.exceptAll(plain).count() == 0 and got.count() == 5


def test_large_whole_numbers_keep_their_digits(spark):
    base = 2**60
    df = spark.range(4000).select((F.col("id") + base).alias("v")).unionByName(spark.range(1).select(F.lit(2**62).alias("v")))
    done = bins.winsorise(df, ["v"])
    assert done.agg(F.max("v")).first()[0] == base + 3999 and done.where(F.col("v") < base).count() == 0


def test_bins_without_key_split_copies_of_a_row(spark):
    """Two thirds of the rows are copies of one row, so borders fall among copies."""
    df = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, F.col("id") / 900).otherwise(0.5).alias("x"), (F.col("id") % 3 == 1).cast("int").alias("e")
    )
    for parts in (1, 7):
        table = bins.bin_event_table(df.repartition(parts), "e", ["x"], adaptive=False).collect()
        assert sorted(r["total"] for r in table if r["bin"]) == [90] * 10
        assert sum(r["events"] for r in table) == 300


def test_nearest_bin_of_unrounded_rates(spark):
    rows = [(1, 0.10005, 1.0), (2, 0.10004, 2.0), (3, 0.10001, 3.0), (None, 0.10002, None)]
    table = spark.createDataFrame([("x", *r) for r in rows], "var_name string, bin bigint, rate double, mean double")
    assert bins.null_fill_values(table).first()["fill"] == 3.0
