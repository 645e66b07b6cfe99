import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from eventrate.operators import rank
from eventrate.runtime import Limits

TINY = Limits(task_rows=50, sample_rows=60)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for i in range(3000):
        # A third of all rows hold one value; some are NULL.
        v = 5.0 if i % 3 == 0 else (None if i % 50 == 1 else round(rng.gauss(5, 4), 2))
        data.append((i, v, f"k{i:05d}"))
    rng.shuffle(data)
    return spark.createDataFrame(data, "id bigint, v double, name string").repartition(7).persist()


@pytest.mark.parametrize("limits", [Limits(), TINY])
@pytest.mark.parametrize("key", ["id", "name"])
@pytest.mark.parametrize("tiles", [2, 7, 10])
def test_ntile_equals_plain_window(rows, limits, key, tiles):
    got = rank.ntile(rows, "v", tiles, key, "t", limits)
    plain = rows.where("v is not null").withColumn("p", F.ntile(tiles).over(Window.orderBy("v", key)))
    assert got.where("v is null and t is not null").count() == 0
    assert got.join(plain.select("id", "p"), "id").where("t <> p").count() == 0
    sizes = [r["count"] for r in got.where("t is not null").groupBy("t").count().collect()]
    assert len(sizes) == tiles and max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("partitions", [1, 4, 37])
def test_result_does_not_depend_on_partitions(rows, partitions):
    a = rank.ntile(rows.repartition(partitions), "v", 10, "id", "t", TINY)
    b = rank.ntile(rows, "v", 10, "id", "t")
    assert a.exceptAll(b).count() == 0


def test_ntile_without_key_splits_copies(spark):
    df = spark.createDataFrame([(1.0,)] * 10, "v double")
    sizes = rank.ntile(df, "v", 3, None).groupBy("tile").count().orderBy("tile").collect()
    assert [r["count"] for r in sizes] == [4, 3, 3]
    with pytest.raises(ValueError):
        rank.ntile(df.withColumn("k", F.lit(1)), "v", 3, "k")


def test_ntile_without_key_uses_the_whole_row(rows):
    got = rank.ntile(rows, "v", 10, None, "t", TINY)
    sizes = [r["count"] for r in got.where("t is not null").groupBy("t").count().collect()]
    assert len(sizes) == 10 and max(sizes) - min(sizes) <= 1 and got.columns == [*rows.columns, "t"]
    assert got.groupBy("t").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo > hi").count() == 0


def test_many_columns_in_batches(spark):
    df = spark.range(300).select(*[(F.col("id") * (i + 1)).alias(f"c{i}") for i in range(20)])
    got = rank.quantile_values(df, df.columns, [0.5], limits=TINY)
    assert got == {f"c{i}": [149.5 * (i + 1)] for i in range(20)}


def test_changing_table_is_reported(spark):
    df = spark.range(10).withColumn(rank.SERIES, F.lit("s"))
    with pytest.raises(RuntimeError):
        rank.rows_at_ranks(df, ["id"], {"s": [12]}, {"s": 12})


def test_fixture_tiles(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)] + [(None,)], "v double")
    got = rank.ntile(df, "v", 3, ["v"]).groupBy("tile").count().collect()
    assert {r["tile"]: r["count"] for r in got} == {1: 4, 2: 3, 3: 3, None: 1}
    few = rank.ntile(df.where("v <= 2"), "v", 3, ["v"]).orderBy("v").collect()
    assert [r["tile"] for r in few] == [1, 2]


@pytest.mark.parametrize("limits", [Limits(), TINY])
def test_quantiles_equal_exact_percentile(rows, limits):
    probs = [0.0, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 1.0]
    df = rows.withColumn("big", F.col("id") + F.lit(2**53))
    got = rank.quantile_values(df, ["v", "id", "big"], probs, limits=limits)
    for c in ("v", "id"):
        want = rows.agg(F.percentile(c, F.array(*map(F.lit, probs))).alias("q")).first()["q"]
        assert got[c] == pytest.approx(want, abs=1e-9)
    assert got["big"][0] == float(2**53)


def test_many_equal_values_need_no_ranking(spark):
    df = spark.range(5000).select(F.lit(3).alias("v"))
    assert rank.quantile_values(df, ["v"], [0.1, 0.5], limits=TINY) == {"v": [3.0, 3.0]}
    empty = rank.quantile_values(df.where("v > 9"), ["v"], [0.5])
    assert empty == {"v": [None]}


@pytest.mark.parametrize("limits", [Limits(), Limits(task_rows=100)])
def test_global_rank_and_running_sums(rows, limits):
    got = rank.global_rank(rows, ["v", "id"], "r", limits)
    plain = rows.withColumn("p", F.row_number().over(Window.orderBy("v", "id")))
    assert got.join(plain.select("id", "p"), "id").where("r <> p").count() == 0
    sums = rank.running_sums(rows.select("id"), ["id"], {"before": "id"}, limits)
    assert sums.where("before <> id * (id - 1) div 2").count() == 0


def test_lag_difference(spark):
    df = spark.createDataFrame([("a", 1, 0.3), ("a", 2, 0.1), ("b", 1, 0.5)], "g string, o int, v double")
    got = rank.lag_difference(df, "g", "o", "v").orderBy("g", "o").collect()
    assert got[0]["difference"] is None and got[1]["difference"] == pytest.approx(0.2)


def test_few_values_are_counted_at_once(spark, monkeypatch):
    monkeypatch.setattr(rank, "_narrow", lambda *a: pytest.fail("no sampling needed"))
    df = spark.range(2000).select((F.col("id") % 7).alias("v"))
    assert rank.quantile_values(df, ["v"], [0.0, 0.5, 1.0], limits=TINY) == {"v": [0.0, 3.0, 6.0]}
