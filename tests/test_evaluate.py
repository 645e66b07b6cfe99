import random

import pytest
from pyspark.sql import functions as F

from eventrate.functions import tails
from eventrate.operators import evaluate, segment
from eventrate.runtime import Limits

ONES, ZEROS = [0.9, 0.6, 0.4], [0.5, 0.4, 0.1, 0.2]


def scored(spark):
    return spark.createDataFrame([(p, 1) for p in ONES] + [(p, 0) for p in ZEROS], "p double, e int")


@pytest.mark.parametrize("limits", [Limits(), Limits(task_rows=2)])
def test_pairs_and_auc(spark, limits):
    row = evaluate.concordance(scored(spark), "p", "e", limits).first()
    assert [int(row[c]) for c in ("pairs", "concordant", "discordant", "ties")] == [12, 10, 1, 1]
    assert evaluate.auc(scored(spark), "p", "e", limits).first()["auc"] == pytest.approx(0.875)


def test_pairs_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(5 if i % 3 == 0 else rng.randrange(10), rng.randrange(2)) for i in range(300)]
    df = spark.createDataFrame(rows, "p int, e int")
    ones, zeros = [p for p, e in rows if e], [p for p, e in rows if not e]
    row = evaluate.concordance(df, "p", "e", Limits(task_rows=3)).first()
    assert int(row["concordant"]) == sum(a > b for a in ones for b in zeros)
    assert int(row["ties"]) == sum(a == b for a in ones for b in zeros)


def test_one_class_only(spark):
    df = scored(spark).where("e = 1")
    assert evaluate.auc(df, "p", "e").first()["auc"] is None


@pytest.mark.parametrize("limits", [Limits(), Limits(task_rows=2)])
def test_roc(spark, limits):
    got = evaluate.roc_curve(scored(spark), "p", "e", limits).orderBy("tp", "fp").collect()
    assert [(r["tp"], r["fp"]) for r in got] == [(0, 0), (1, 0), (2, 0), (2, 1), (3, 2), (3, 3), (3, 4)]
    area = sum((b["fpr"] - a["fpr"]) * (a["tpr"] + b["tpr"]) / 2 for a, b in zip(got, got[1:]))
    assert area == pytest.approx(0.875)


def confusion_fixture(spark):
    rows = [(1, 1)] * 3 + [(0, 1)] + [(1, 0)] * 2 + [(0, 0)] * 4
    return spark.createDataFrame(rows, "p int, e int")


def test_confusion(spark):
    df = confusion_fixture(spark)
    cells = evaluate.confusion(df, "p", "e")
    assert tuple(cells.first()) == (3, 1, 2, 4)
    s = evaluate.confusion_stats(cells).first()
    want = {"accuracy": 0.7, "sensitivity": 0.75, "specificity": 2 / 3, "ppv": 0.6, "npv": 0.8,
            "balanced_accuracy": 17 / 24, "kappa": 0.4, "prevalence": 0.4, "detection_rate": 0.3,
            "detection_prevalence": 0.5, "no_information_rate": 0.6}
    for name, value in want.items():
        assert s[name] == pytest.approx(value)
    assert evaluate.error_rate(df, "p", "e").first()[0] == pytest.approx(0.3)
    t = evaluate.confusion_tests(cells).first()
    assert t["accuracy_low"] == pytest.approx(0.3475, abs=1e-4)
    assert t["accuracy_high"] == pytest.approx(0.9333, abs=1e-4)
    assert t["accuracy_p"] == pytest.approx(0.3823, abs=1e-4)
    assert t["mcnemar_p"] == pytest.approx(1.0)


def test_kappa(spark):
    k = evaluate.kappa_test(confusion_fixture(spark), "p", "e").first()
    assert (k["subjects"], k["kappa"]) == (10, pytest.approx(0.4))
    assert k["z"] == pytest.approx(1.2910, abs=1e-4) and k["p_value"] == pytest.approx(0.1967, abs=1e-4)


def test_classify_at_base_rate(spark):
    got = evaluate.classify(scored(spark), "p", event="e").where("predicted = 1")
    assert sorted(r["p"] for r in got.collect()) == [0.5, 0.6, 0.9]


def test_tails():
    assert tails.chi_square_upper(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert tails.chi_square_upper(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-12)
    assert tails.chi_square_upper(2.0, 10) == pytest.approx(0.9963401531726563, abs=1e-12)
    assert tails.chi_square_upper(1723.0, 24) < 1e-300
    assert tails.normal_quantile(0.975) == pytest.approx(1.959963984540054, abs=1e-12)
    assert tails.beta_lower(0.3, 2, 5) == pytest.approx(0.579825, abs=1e-9)
    assert tails.binomial_upper(3, 5, 0.5) == pytest.approx(0.5)


def test_tiers_and_lists(spark):
    df = spark.createDataFrame([(i, float(i), i % 2) for i in range(1, 21)], "id bigint, v double, p int")
    got = segment.budget_target(df, "v", "id")
    assert sorted(r["id"] for r in got.collect()) == [17, 18, 19, 20]
    share = segment.target_share(got, df).first()
    assert (share["targeted"], share["population"], share["share"]) == (4, 20, 0.2)
    tiers = segment.tier(df, "v", 3, "id", labels=["Low", "Med", "High"])
    bounds = {r["tier"]: (r["min"], r["max"]) for r in segment.tier_bounds(tiers, "tier", "v").collect()}
    assert bounds == {"Low": (1.0, 7.0), "Med": (8.0, 14.0), "High": (15.0, 20.0)}
    both = segment.tier_crosstab(tiers, "tier", "p").orderBy("tier").collect()
    assert [(r["0"], r["1"]) for r in both] == [(3, 3), (3, 4), (4, 3)]
    assert [r["id"] for r in segment.target_list(df, {"v": 18, "id": 19}, "id").collect()] == [20]
    assert segment.flagged_list(df, "p", "id").count() == 10
