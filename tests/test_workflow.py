"""From a raw file to a target list."""

import random

import pytest
from pyspark.sql import functions as F

from eventrate.operators import evaluate, model, profile
from eventrate.plans import workflow
from eventrate.sources.records import read_records


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    rng = random.Random(11)
    lines = ["Case Number,Year,Kind,Area,Note,Hour,Outcome (Y/N),Price"]
    for i in range(1200):
        area = rng.choice(["north", "south", "east", "west"] * 2 + ["", "UNKNOWN"])
        kind = rng.choice(["a", "b", "c", ".", "a "])
        bad = {"north": 0.1, "south": 0.25, "east": 0.5}.get(area, 0.4) + (0.2 if kind == "b" else 0)
        outcome = rng.choice(["Y", "y"]) if rng.random() < bad else rng.choice(["N", " N", "F"])
        if i % 100 == 0:
            outcome = "NA"
        year = rng.choice([77, *range(1900, 2016)])
        hour = "" if rng.random() < 0.6 else str(rng.randrange(24))
        price = "#VALUE!" if rng.random() < 0.1 else f"{rng.lognormvariate(3, 1):.2f}"
        lines.append(f"k{i},{year},{kind},{area},note {i},{hour},{outcome},{price}")
    path = tmp_path_factory.mktemp("raw") / "records.csv"
    path.write_text("\n".join(lines))
    return read_records(spark, str(path), infer=True)


def test_study_from_raw_records(spark, raw):
    done = workflow.prepare_records(
        raw, "Outcome", "Y", "Case_Number",
        spellings={"Outcome": {"y": "Y", "F": "N", " N": "N"}, "Kind": {"a ": "a"}},
        bad_values={"Kind": ["."]}, implausible={"Year": F.col("Year") < 1000}, sparse_cutoff=0.26,
    )
    assert done.dropped == ["Hour", "Note"]
    assert done.variables == (["Kind", "Area"], ["Year", "Price"], [])
    assert done.data.count() == 1188 and done.data.where("Year < 1000").count() == 0
    assert done.report.where("var_name = 'Hour'").first()["missing_pct"] > 0.5

    small = workflow.reduce_categories(done.data, "event", done.variables.categorical)
    assert small.data.count() == 1188
    assert profile.null_counts(small.data).where("var_name in ('Kind', 'Area') and missing > 0").count() == 0

    numbers = workflow.prepare_numeric(small.data, "event", ["Year", "Price"], "Case_Number")
    assert profile.null_counts(numbers.data).where("missing > 0").count() == 0
    assert numbers.bin_table.where("var_name = 'Price' and bin is null").first()["total"] > 50
    top = numbers.data.agg(F.max("Price")).first()[0]
    assert top < raw.agg(F.max("Price")).first()[0]

    terms = [c for c in numbers.data.columns if c not in ("Case_Number", "event")]
    found = workflow.study(numbers.data, "event", "Case_Number", terms)
    assert (found.train.count(), found.test.count()) == (831, 357)
    assert 0.5 < found.area.first()["auc"] < 0.95
    cells = found.cells.first()
    assert sum(cells) == 357
    assert found.pairs.first()["pairs"] == (cells["tp"] + cells["fn"]) * (cells["fp"] + cells["tn"])
    assert model.deviance_test(found.model).first()["p_value"] < 0.001
    assert evaluate.error_rate(found.test, "predicted", "event").first()[0] < 0.5

    picked = workflow.targets(found.test, "Price", "Case_Number")
    assert picked.count() == 70  # larger tiles come first, so tiles 9 and 10 hold 35 rows each


def test_no_column_gets_lost(spark):
    df = spark.range(200).select(
        F.col("id").alias("key"), F.when(F.col("id") % 2 == 0, "Y").otherwise("N").alias("Outcome"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 30).cast("int")).alias("day"),
        F.timestamp_seconds(F.col("id")).alias("at"), F.col("id").cast("string").cast("binary").alias("raw"),
        (F.col("id") % 3 == 0).alias("flag"), (F.col("id") % 5).cast("string").alias("kind"), F.rand(1).alias("x"),
        F.array("id").alias("list"),
    )
    done = workflow.prepare_records(df, "Outcome", "Y", "key")
    assert done.variables == (["flag", "kind"], ["x"], ["day", "at", "raw", "list"])
    assert set(done.data.columns) == {"key", "event", "day", "at", "raw", "flag", "kind", "x", "list"} and done.dropped == []
    assert done.data.where("day is null or at is null or raw is null").count() == 0
