import os

import pytest
from pyspark.sql import functions as F

from eventrate.functions import expressions as X
from eventrate.functions.numeric import rate_units, round_k
from eventrate.operators import clean, features, profile
from eventrate.runtime import Limits, materialise, scratch_folder
from eventrate.sources import records, reports


def column(df, name):
    return [r[name] for r in df.collect()]


# --- sources ---------------------------------------------------------------------------


@pytest.fixture()
def raw(tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(
        'Case Number,Year,Fatal (Y/N),2nd,Note,Note\n'
        'c1,1900,Y,1.5,"a, b",x\nc2,NA, N,#VALUE!,"say ""hi""",UNKNOWN\nc3,,N ,2,NA,z\n'
    )
    return str(path)


def test_read_records_nulls_names_and_types(spark, raw):
    df = records.read_records(spark, raw, infer=True)
    assert df.columns == ["Case_Number", "Year", "Fatal__Y_N_", "X2nd", "Note", "Note_1"]
    assert dict(df.dtypes)["Year"] == "int" and dict(df.dtypes)["X2nd"] == "double"
    assert column(df, "Year") == [1900, None, None]
    assert column(df, "X2nd") == [1.5, None, 2.0]
    assert column(df, "Fatal__Y_N_") == ["Y", " N", "N "]
    assert column(df, "Note") == ["a, b", 'say "hi"', None]
    assert column(df, "Note_1") == ["x", None, "z"]


def test_read_records_declared_types_and_odd_names(spark, raw):
    df = records.read_records(spark, raw, types={"Year": "bigint", "Case_Number": "int"})
    assert dict(df.dtypes)["Year"] == "bigint" and column(df, "Case_Number") == [None] * 3
    odd = spark.createDataFrame([(1, 2, 3)], ["a b", "A.b", ""])
    assert records.clean_names(odd).columns == ["a_b", "A_b_1", "X"]


def test_line_breaks_inside_quotes(spark, tmp_path):
    (tmp_path / "m.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    got = records.read_records(spark, str(tmp_path / "m.csv"), infer=True, multi_line=True).collect()
    assert [tuple(r) for r in got] == [(1, "x\ny"), (2, "z")]


def test_reports_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, None), ("a", 1, 'q "x", y')], "k string, n int, t string")
    reports.write_report(df, str(tmp_path / "r"), index_by=["k"])
    back = records.read_records(spark, str(tmp_path / "r"), infer=True).orderBy("index").collect()
    assert [tuple(r) for r in back] == [(1, "a", 1, 'q "x", y'), (2, "b", 2, None)]
    reports.write_report(df, str(tmp_path / "p"), fmt="parquet")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    with pytest.raises(ValueError):
        reports.write_report(df, str(tmp_path / "z"), fmt="xml")


def test_scratch_folder_of_the_session_is_used(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert scratch_folder(spark) == folder
    assert materialise(spark.range(3), "three").count() == 3
    assert [f for f in os.listdir(folder) if f.startswith("three-")]


# --- cleaning --------------------------------------------------------------------------


def test_clean_chain(spark):
    df = spark.createDataFrame(
        [("y", "M ", 1950), (" N", ".", 77), ("F", "lli", None), (None, "M", 1999), ("n", None, 2000)],
        "flag_x string, sex string, year int",
    )
    df = clean.rename_matching(df, "flag", "flag")
    df = clean.canonicalise(df, "flag", {"y": "Y", "n": "N", "F": "N", " N": "N", "N ": "N"})
    df = clean.canonicalise(df, "sex", {"M ": "M"})
    df = clean.null_values(df, "sex", [".", "lli"])
    df = clean.null_where(df, "year", F.col("year") < 1000)
    df = clean.encode_event(clean.require_target(df, "flag"), "flag", "Y")
    assert [tuple(r) for r in df.collect()] == [(1, "M", 1950), (0, None, None), (0, None, None), (0, None, 2000)]
    with pytest.raises(ValueError):
        clean.rename_matching(df, "e", "z")


def test_casts_and_columns(spark):
    df = spark.createDataFrame([("1", 2), ("x", 3)], "a string, b int")
    assert column(clean.to_number(df, ["a"]), "a") == [1.0, None]
    assert column(clean.to_text(df, ["b"]), "b") == ["2", "3"]
    assert clean.add_columns(df, one=1, twice=F.col("b") * 2).first()[2:] == (1, 4)


def test_split_order_and_alignment(spark):
    df = spark.range(100).select(
        F.col("id"), (F.col("id") % 3).cast("int").alias("few"), (F.col("id") % 19).cast("int").alias("limit"),
        (F.col("id") * 1.5).alias("x"), F.lit("t").alias("t"), (F.col("id") % 2).cast("int").alias("e"),
    )
    v = clean.split_variables(df, exclude=["e"])
    assert v == (["few", "limit", "t"], ["id", "x"], [])
    nulls = df.withColumn("limit", F.when(F.col("id") > 0, F.col("limit")))
    assert "limit" not in clean.split_variables(nulls.withColumn("limit", F.col("id") % 19), 19).categorical
    assert clean.order_columns(df, "e", v).columns == ["e", "few", "limit", "t", "id", "x"]
    report = profile.quality_report(df)
    assert clean.check_aligned(df, report)
    less, fewer = clean.drop_vars(df, report, ["x"])
    assert "x" not in less.columns and fewer.count() == 5 and clean.check_aligned(less, fewer)
    assert not clean.check_aligned(less, report)


# --- profiling -------------------------------------------------------------------------


@pytest.mark.parametrize("limits", [Limits(), Limits(task_rows=2)])
def test_quality_report_fixture(spark, limits):
    df = spark.createDataFrame([(1, "a" * 100), (2, "a" * 99 + "b"), (None, None), (2, "s"), (10, "s")], "v int, t string")
    v, t = profile.quality_report(df, limits=limits).collect()
    want = {"records": 5, "unique": 4, "available": 4, "available_pct": 0.8, "missing": 1, "missing_pct": 0.2,
            "min": 1, "max": 10, "mean": 3.75, "p5": 1.15, "p10": 1.3, "p25": 1.75, "p50": 2, "p75": 4,
            "p90": 7.6, "p95": 8.8}
    for name, value in want.items():
        assert v[name] == pytest.approx(value)
    assert (t["kind"], t["unique"], t["min"], t["p50"]) == ("text", 4, None, None)


def test_approximate_report_is_close(spark):
    df = spark.range(2000).select(F.col("id").alias("v"))
    row = profile.quality_report(df, approximate=True).first()
    assert abs(row["unique"] - 2000) < 200 and abs(row["p50"] - 1000) < 20


def test_empty_table(spark):
    df = spark.createDataFrame([], "v double, t string")
    assert [(r["records"], r["unique"], r["missing_pct"]) for r in profile.quality_report(df).collect()] == [(0, 0, None)] * 2
    assert profile.high_cardinality_columns(df, ["t"]) == []


def test_sparse_cutoff_uses_rounded_share(spark):
    df = spark.range(1000).select(*[F.when(F.col("id") >= n, 1).alias(f"m{n}") for n in (0, 250, 254, 256)])
    for report in (profile.quality_report(df), profile.missing_shares(df)):
        assert profile.drop_sparse(df, report, 0.25).columns == ["m0", "m250", "m254"]
    assert {r["var_name"]: r["missing"] for r in profile.null_counts(df).collect()}["m254"] == 254


def test_screening(spark):
    df = spark.range(5000).select(
        F.col("id").cast("string").alias("key"), (F.col("id") % 1600).cast("string").alias("fine"),
        (F.col("id") % 1400).cast("string").alias("coarse"), F.lit("c").alias("const"),
        F.when(F.col("id") < 3, "c").alias("const_or_null"), F.lit(None).cast("string").alias("nothing"),
    )
    cols = df.columns
    assert profile.high_cardinality_columns(df, cols, 0.3, keep=["key"]) == ["fine"]
    assert profile.constant_columns(df, cols) == ["const", "const_or_null", "nothing"]
    assert profile.drop_constant(df, []).columns == cols


def test_frequencies_and_crosstab(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), (None, "x"), ("a", None)], "g string, h string")
    assert {r["g"]: r["rows"] for r in profile.freq(df, "g").collect()} == {"a": 3, "b": 1}
    assert {r["g"]: r["share"] for r in profile.class_share(df, "g").collect()} == {"a": 0.75, "b": 0.25}
    assert sorted(tuple(r) for r in profile.crosstab(df, "g", "h").collect()) == [("a", 1, 1), ("b", 1, 0)]
    assert profile.distinct_levels(df, "g").count() == 3


def test_summaries(spark):
    df = spark.createDataFrame([(i, float(i), f"l{i % 10}" if i else None) for i in range(101)], "id int, v double, g string")
    n = {r["var_name"]: r for r in profile.numeric_summary(df).collect()}["v"]
    assert (n["min"], n["q1"], n["median"], n["q3"], n["max"], n["mean"], n["missing"]) == (0, 25, 50, 75, 100, 50, 0)
    c = {r["level"]: r["rows"] for r in profile.category_summary(df, ["g"], top=3).collect()}
    assert c == {"l0": 10, "l1": 10, "l2": 10, "(Other)": 70, None: 1}
    long = profile.summarise(df.select("v", "g"), top=3)
    assert long.where("var_name = 'v'").count() == 7 and long.where("item = 'missing' and value = 1").count() == 1


def test_correlation(spark):
    df = spark.range(50).select(F.col("id").alias("a"), (-2 * F.col("id")).alias("b"), F.sin("id").alias("c"))
    m = {(r["var_1"], r["var_2"]): r["corr"] for r in profile.corr_matrix(df, ["a", "b", "c"]).collect()}
    assert len(m) == 9 and m["a", "b"] == pytest.approx(-1) and m["a", "c"] == m["c", "a"] and m["b", "b"] == 1.0


# --- features --------------------------------------------------------------------------


def test_rounding(spark):
    df = spark.createDataFrame([(0.125,), (-0.125,), (2.0 / 3,), (0.0,), (None,), (-1e300,)], "v double")
    assert [r[0] for r in df.select(round_k("v", 2)).collect()] == [0.13, -0.13, 0.67, 0.0, None, -1e300]
    df = spark.createDataFrame([(1, 2000), (1, 3), (0, 5), (3, 0), (4503599627, 9007199254)], "n bigint, d bigint")
    assert [r[0] for r in df.select(rate_units("n", "d")).collect()] == [1, 333, 0, None, 500]


def test_ratio_and_labels(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 3.0), (None, 1.0)], "n double, d double")
    assert column(features.safe_ratio(df, "n", "d", 0.0), "ratio") == [0.0, 0.33, None]
    assert column(features.safe_ratio(df, "n", "d"), "ratio") == [None, 0.33, None]
    v = spark.createDataFrame([(4.0,), (4.1,), (22.0,), (200.0,), (None,)], "v double")
    got = features.threshold_label(v, "v", [4, 22, 177.67], ["Low", "Med", "High", "V_High"])
    assert column(got, "v") == ["Low", "Med", "Med", "V_High", None]


def test_interval_cut(spark):
    df = spark.createDataFrame([(y,) for y in (0, 1906, 1907, 2013, 2016, 2017, None)], "y int")
    got = features.interval_cut(df, "y", [0, 1906, 1956, 2013, 2016], [1, 2, 3, 4])
    assert column(got, "y") == [None, 1, 2, 3, 4, None, None]


def test_dummies_interaction_and_score(spark):
    df = spark.createDataFrame([("WC", "0", 2.0), ("WCMB", "3", 3.0), (None, "2", 4.0)], "w string, a string, r double")
    d = features.dummies(df, "w", {"WC": "w_wc", "WCMB": "w_wcmb"})
    assert "w" not in d.columns and [(r["w_wc"], r["w_wcmb"]) for r in d.collect()] == [(1, 0), (0, 1), (None, None)]
    assert features.dummies(df, "w", ["WC"], drop=False).columns[-1] == "w_WC"
    low = F.col("a").isin("0", "1")
    got = features.interaction(df, [(low & (F.col("w") == "WC"), "both"), (~low, "high")], "rest")
    assert column(got, "interaction") == ["both", "high", "high"]
    unknown = features.interaction(df, [(F.col("w") == "WC", "wc")], "other")
    assert column(unknown, "interaction") == ["wc", "other", None]
    assert column(features.weighted_score(df.withColumn("p", F.lit(1)), "p", "r"), "weighted") == [2.0, 3.0, 4.0]
    with pytest.raises(ValueError):
        X.threshold("r", [2, 1], ["a", "b", "c"])


def test_summary_covers_every_column(spark):
    df = spark.range(60).select(
        "id", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 2).cast("int")).alias("day"),
        F.when(F.col("id") > 9, F.encode(F.lit("b"), "utf-8")).alias("raw"), F.array(F.lit(1)).alias("list"),
    )
    got = profile.summarise(df)
    assert {r["var_name"] for r in got.collect()} == {"id", "day", "raw", "list"}
    days = {r["level"]: r["value"] for r in got.where("var_name = 'day'").collect()}
    assert days == {"2020-01-01": 30.0, "2020-01-02": 30.0}
    assert got.where("var_name = 'raw' and item = 'missing'").first()["value"] == 10.0


def test_one_rounding_of_missing_shares(spark):
    df = spark.range(200).select("id", F.when(F.col("id") >= 57, 1).alias("x"))
    one = {r["var_name"]: r["missing_pct"] for r in profile.missing_shares(df).collect()}
    assert one == {r["var_name"]: r["missing_pct"] for r in profile.quality_report(df).collect()} == {"id": 0.0, "x": 0.29}


def test_distinct_texts_of_any_length(spark):
    df = spark.createDataFrame([("a",), ("a",), ("x" * 200,), ("x" * 199 + "y",), (None,), ("",)], "t string")
    assert profile.distinct_counts(df) == {"t": 4}


def test_correlation_of_pairs_with_gaps(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3)) + 1e6
    x[:, 1] += x[:, 0]
    holes = rng.random((400, 3)) < 0.2
    rows = [tuple(None if h else float(v) for v, h in zip(a, b)) for a, b in zip(x, holes)]
    df = spark.createDataFrame(rows, "a double, b double, c double").withColumn("k", F.lit(3))
    got = {(r["var_1"], r["var_2"]): r["corr"] for r in profile.corr_matrix(df, ["a", "b", "c", "k"]).collect()}
    assert len(got) == 16 and got[("k", "a")] is None and got[("k", "k")] == 1.0
    for i, one in enumerate("abc"):
        for j, two in enumerate("abc"):
            both = ~holes[:, i] & ~holes[:, j]
            assert got[(one, two)] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
