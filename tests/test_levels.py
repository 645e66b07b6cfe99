import pytest
from pyspark.sql import functions as F

from eventrate.operators import levels
from eventrate.runtime import Limits


def records(spark, spec, var="g"):
    """Rows from {level: (events, rows)}."""
    data = [(k, int(i < e)) for k, (e, n) in spec.items() for i in range(n)]
    return spark.createDataFrame(data, f"{var} string, e int")


def rate_rows(spark, rates, condensed=True):
    data = [("g", 1, str(i + 1), int(r * 1000), 1000, r, len(rates), condensed) for i, r in enumerate(rates)]
    return spark.createDataFrame(
        data,
        "var_name string, col_num bigint, level string, events bigint, total bigint, rate double,"
        " total_levels bigint, condensed boolean",
    )


FIXTURE = {"a": (1, 10), "b": (2, 10), "c": (3, 10), "d": (4, 10), "e": (0, 5), None: (2, 8)}


def test_rates_and_zero_levels(spark):
    df = records(spark, FIXTURE)
    got = {r["level"]: r for r in levels.level_event_rate(df, "e", ["g"]).collect()}
    assert {k: r["rate"] for k, r in got.items()} == {"a": 0.1, "b": 0.2, "c": 0.3, "d": 0.4, None: 0.25}
    assert {r["total_levels"] for r in got.values()} == {5}
    assert [r["level"] for r in levels.zero_event_levels(df, "e", ["g"]).collect()] == ["e"]


def test_null_goes_to_lower_of_two_near_levels(spark):
    df = records(spark, FIXTURE)
    done = levels.impute_null_level(df, levels.level_event_rate(df, "e", ["g"]))
    assert done.data.where("g is null").count() == 0
    assert done.data.where("g = 'b'").count() == 18
    b = done.rates.where("level = 'b'").first()
    assert (b["events"], b["total"], b["total_levels"]) == (2, 10, 4)


def test_null_without_candidate_stays(spark):
    df = records(spark, {"a": (0, 4), None: (2, 4)})
    done = levels.impute_null_level(df, levels.level_event_rate(df, "e", ["g"]))
    assert done.data.where("g is null").count() == 4
    assert done.rates.count() == 0


@pytest.mark.parametrize("limits", [Limits(), Limits(task_rows=2, sample_rows=10)])
def test_condense(spark, limits):
    df = records(spark, FIXTURE)
    rates = levels.impute_null_level(df, levels.level_event_rate(df, "e", ["g"])).rates
    done = levels.condense_levels(rates, 3, limits)
    got = {r["level"]: (r["events"], r["total"], r["rate"]) for r in done.groups.collect()}
    assert got == {"1": (3, 20, 0.15), "2": (3, 10, 0.3), "3": (4, 10, 0.4)}
    assert {r["level"]: r["imputed_lvl"] for r in done.decode.collect()} == {"a": "1", "b": "1", "c": "2", "d": "3"}


def test_condense_many_levels_beyond_one_task(spark):
    df = spark.range(4000).select(F.format_string("L%05d", "id").alias("g"), (F.col("id") % 2).alias("e"))
    rates = levels.level_event_rate(df, "e", ["g"])
    a = levels.condense_levels(rates, 3, Limits(task_rows=100, sample_rows=80))
    b = levels.condense_levels(rates, 3)
    assert a.decode.exceptAll(b.decode).count() == 0 and a.decode.count() == 2000


def test_three_or_fewer_levels_pass_through(spark):
    df = records(spark, {"a": (1, 10), "b": (5, 10), "c": (9, 10)})
    done = levels.condense_levels(levels.level_event_rate(df, "e", ["g"]))
    assert done.decode.count() == 0
    assert sorted(r["level"] for r in done.groups.collect()) == ["a", "b", "c"]


@pytest.mark.parametrize(
    "rates,codes",
    [
        ([0.10, 0.11, 0.30], ["1", "1", "3"]),
        ([0.10, 0.30, 0.31], ["1", "2", "2"]),
        ([0.100, 0.115, 0.130], ["1", "1", "1"]),
        ([0.10, 0.20, 0.30], ["1", "2", "3"]),
        ([0.10, 0.11], ["1", "1"]),
        ([0.10], ["1"]),
    ],
)
def test_clubbing_cases(spark, rates, codes):
    groups = rate_rows(spark, rates)
    decode = groups.select("var_name", "col_num", F.concat(F.lit("x"), "level").alias("level"),
                           F.col("level").alias("imputed_lvl"))
    done = levels.club_levels(groups, decode)
    assert [r["imputed_lvl"] for r in done.decode.orderBy("level").collect()] == codes
    pooled = done.rates.collect()
    assert len(pooled) == len(set(codes)) and {r["total_levels"] for r in pooled} == {len(set(codes))}
    assert sum(r["total"] for r in pooled) == 1000 * len(rates)


def test_clubbing_of_uncondensed_variable_uses_level_names(spark):
    groups = rate_rows(spark, [0.10, 0.11, 0.30], condensed=False)
    done = levels.club_levels(groups, spark.createDataFrame([], "var_name string, col_num bigint, level string, imputed_lvl string"))
    assert [(r["level"], r["imputed_lvl"]) for r in done.decode.collect()] == [("2", "1")]


@pytest.mark.parametrize("limits", [Limits(), Limits(broadcast_rows=0)])
def test_decode_matches_null_and_keeps_unmapped(spark, limits):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "g string, id int")
    decode = spark.createDataFrame([("g", 1, "a", "1"), ("g", 1, None, "0")],
                                   "var_name string, col_num bigint, level string, imputed_lvl string")
    got = levels.apply_decode(df, decode, limits=limits).orderBy("id").collect()
    assert [r["g"] for r in got] == ["1", "1", "b", "0"]


def test_shuffled_decode_of_copies_and_hot_levels(spark):
    """A third of the rows are copies of one row; the lookup is too large to broadcast."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("l"), F.col("id") % 50)).alias("g"))
    names = [r["g"] for r in df.distinct().collect()]
    decode = spark.createDataFrame([("g", 1, n, n[:2]) for n in names],
                                   "var_name string, col_num bigint, level string, imputed_lvl string")
    a = levels.apply_decode(df, decode, limits=Limits(broadcast_rows=0)).groupBy("g").count()
    b = levels.apply_decode(df, decode).groupBy("g").count()
    assert a.exceptAll(b).count() == 0 and a.agg(F.sum("count")).first()[0] == 3000


def test_reduce_levels_end_to_end(spark):
    df = records(spark, FIXTURE).withColumn("near", F.when(F.col("g") == "a", "x").otherwise("y"))
    df = df.withColumn("same", F.lit("only"))
    done = levels.reduce_levels(df, "e", ["g", "near", "same"])
    assert "same" in done.dropped and "same" not in done.data.columns
    got = {(r["g"]): r["count"] for r in done.data.groupBy("g").count().collect()}
    assert got == {"1": 28, "2": 10, "3": 10, "0": 5}
    assert done.data.count() == df.count()


def test_totals_are_kept(spark):
    df = records(spark, {k: v for k, v in FIXTURE.items() if k and v[0]})
    rates = levels.level_event_rate(df, "e", ["g"])
    done = levels.condense_levels(rates)
    final = levels.club_levels(done.groups, done.decode)
    for table in (done.groups, final.rates):
        assert table.agg(F.sum("events"), F.sum("total")).first()[:] == (10, 40)


def test_no_events_and_empty_input(spark):
    df = records(spark, {"a": (0, 3), "b": (0, 2)})
    assert levels.level_event_rate(df, "e", ["g"]).count() == 0
    assert levels.zero_event_levels(df, "e", ["g"]).count() == 2
    done = levels.reduce_levels(df.limit(0), "e", ["g"])
    assert done.data.count() == 0 and done.dropped == ["g"]


def test_condensing_orders_unrounded_rates(spark):
    rows = [("v", 1, f"l{i}", 10_005 - i, 100_000, (10_005 - i) / 100_000, 6) for i in range(6)]
    rates = spark.createDataFrame(rows, "var_name string, col_num bigint, level string, events bigint, total bigint, rate double, total_levels bigint")
    tiles = {r["level"]: r["imputed_lvl"] for r in levels.condense_levels(rates, 3).decode.collect()}
    assert tiles == {"l5": "1", "l4": "1", "l3": "2", "l2": "2", "l1": "3", "l0": "3"}


@pytest.mark.parametrize("groups", [3, 4, 12])
def test_any_number_of_groups_is_clubbed(spark, groups):
    df = records(spark, {f"g{i:02d}": (100 + i, 1000) for i in range(14)})
    done = levels.reduce_levels(df, "e", ["g"], groups=groups)
    assert done.rates.count() == 1 and done.dropped == ["g"]


@pytest.mark.parametrize("limits", [Limits(), Limits(broadcast_rows=0)])
def test_rows_in_levels(spark, limits):
    df = spark.range(600).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 != 0, F.concat(F.lit("l"), F.col("id") % 20)).alias("g"))
    counts = levels.level_counts(df.withColumn("e", F.lit(0)), "e", ["g"])
    wanted = spark.createDataFrame([("hot",), (None,), ("l4",), ("absent",), ("hot",)], "level string")
    inside = F.col("g").isNull() | F.col("g").isin("hot", "l4")
    for given in (None, counts):
        kept = levels.rows_in_levels(df, "g", wanted, limits=limits, counts=given)
        assert kept.exceptAll(df.where(inside)).count() == 0 and kept.count() == df.where(inside).count()
        gone = levels.rows_in_levels(df, "g", wanted, keep=False, limits=limits, counts=given)
        assert gone.count() == 600 - kept.count() and gone.where(F.col("g").isin("hot", "l4")).count() == 0
