import numpy as np
import pytest
from pyspark.sql import functions as F

from eventrate.operators import model, tree
from eventrate.runtime import Limits


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    n = 2000
    x1, x2 = rng.normal(size=n), rng.uniform(-1, 1, size=n)
    g = rng.choice(["a", "b", "c"], size=n)
    eta = -0.4 + 0.8 * x1 + 0.7 * (g == "c") - 0.5 * (g == "b")
    e = (rng.uniform(size=n) < 1 / (1 + np.exp(-eta))).astype(int)
    rows = [(i, float(a), float(b), str(c), int(d)) for i, (a, b, c, d) in enumerate(zip(x1, x2, g, e))]
    df = spark.createDataFrame(rows, "id bigint, x1 double, x2 double, g string, e int").repartition(3).persist()
    design = np.column_stack([np.ones(n), x1, x2, g == "b", g == "c"]).astype(float)
    return df, design, e.astype(float)


def newton(design, e, offset=0.0):
    """Independent fit by Newton steps."""
    beta = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(design @ beta + offset)))
        info = design.T @ (design * (p * (1 - p))[:, None])
        beta = beta + np.linalg.solve(info, design.T @ (e - p))
    p = 1 / (1 + np.exp(-(design @ beta + offset)))
    dev = -2 * np.sum(np.where(e == 1, np.log(p), np.log(1 - p)))
    return beta, np.sqrt(np.diag(np.linalg.inv(info))), dev, p


def test_logit_agrees_with_independent_fit(data, spark):
    df, design, e = data
    fit = model.fit_logit(df, "e", exclude=["id"])
    beta, se, dev, p = newton(design, e)
    table = {r["term"]: r for r in model.coef_table(fit).collect()}
    for term, b, s in zip(["(Intercept)", "x1", "x2", "g_b", "g_c"], beta, se):
        assert table[term]["estimate"] == pytest.approx(b, abs=1e-6)
        assert table[term]["std_error"] == pytest.approx(s, abs=1e-6)
    assert fit.deviance == pytest.approx(dev, abs=1e-6)
    assert fit.aic == pytest.approx(dev + 10, abs=1e-6)
    assert (fit.null_df, fit.residual_df) == (1999, 1995)
    test = model.deviance_test(fit).first()
    assert test["df"] == 4 and test["p_value"] < 1e-20
    scored = model.score(fit, df).orderBy("id").collect()
    assert np.allclose([r["probability"] for r in scored], p, atol=1e-6)


def test_merged_rows_give_the_same_fit(data):
    df, design, e = data
    coarse = df.withColumn("c1", F.round("x1")).select("c1", "g", "e")
    fit = model.fit_logit(coarse, "e")
    ids = df.orderBy("id").select(F.round("x1").alias("c1")).collect()
    design = np.column_stack([design[:, 0], [r["c1"] for r in ids], design[:, 3:]])
    beta, se, dev, _ = newton(design, e)
    table = {r["term"]: r for r in model.coef_table(fit).collect()}
    for term, b, s in zip(["(Intercept)", "c1", "g_b", "g_c"], beta, se):
        assert (table[term]["estimate"], table[term]["std_error"]) == (pytest.approx(b, abs=1e-6), pytest.approx(s, abs=1e-6))
    share = e.mean()
    null = -2 * (e.sum() * np.log(share) + (len(e) - e.sum()) * np.log(1 - share))
    assert (fit.deviance, fit.null_deviance) == (pytest.approx(dev, abs=1e-5), pytest.approx(null, abs=1e-5))
    assert (fit.aic, fit.residual_df) == (pytest.approx(dev + 8, abs=1e-5), 1996)


def test_profile_interval_is_where_deviance_has_risen(data):
    df, design, e = data
    fit = model.fit_logit(df, formula="e ~ x1 + x2")
    design = design[:, :3]
    _, _, dev, _ = newton(design, e)
    rows = {r["term"]: r for r in model.conf_int(fit, df=df, method="profile").collect()}
    for k, term in enumerate(["(Intercept)", "x1", "x2"]):
        rest = np.delete(design, k, axis=1)
        for end in (rows[term]["low"], rows[term]["high"]):
            _, _, held, _ = newton(rest, e, design[:, k] * end)
            assert held - dev == pytest.approx(3.8414588, abs=1e-3)
    wald = {r["term"]: r for r in model.conf_int(fit).collect()}
    assert wald["x1"]["low"] == pytest.approx(rows["x1"]["low"], abs=0.02)


def test_dependent_and_constant_features_get_no_estimate(data):
    df, _, _ = data
    wide = df.withColumn("twice", F.col("x1") * 2 + 1).withColumn("one", F.lit(1.0))
    fit = model.fit_logit(wide, formula="e ~ x1 + twice + one + g")
    assert set(fit.aliased) == {"twice", "one"}
    plain = model.fit_logit(df, formula="e ~ x1 + g")
    assert fit.deviance == pytest.approx(plain.deviance, abs=1e-8)
    assert model.coef_table(fit).where("estimate is null").count() == 2


def test_formula():
    assert model.formula_terms("y ~ . - key", ["key", "y", "a", "b"]) == ("y", ["a", "b"])
    assert model.formula_terms("y ~ a + b_2", []) == ("y", ["a", "b_2"])


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_stepwise_drops_noise_and_keeps_whole_factor(data, direction):
    df, design, e = data
    noisy = df.withColumn("n1", F.sin(F.col("id") * 12.9898)).withColumn("n2", F.cos(F.col("id") * 78.233))
    done = model.stepwise(noisy, "e", ["x1", "g", "n1", "n2"], direction)
    assert {"x1", "g"} <= set(done.model.terms)
    assert {"g_b", "g_c"} <= set(done.model.names)
    aics = [r["aic"] for r in done.steps.orderBy("step").collect()]
    assert aics == sorted(aics, reverse=True)


def test_stepwise_may_end_at_the_intercept(spark):
    df = spark.range(400).select((F.col("id") % 2).alias("e"), F.sin(F.col("id") * 3.7).alias("a"))
    done = model.stepwise(df, "e", ["a"])
    assert done.model.terms == () and done.steps.count() == 2
    assert model.coef_table(done.model).first()["estimate"] == pytest.approx(0.0)
    assert model.score(done.model, df).first()["probability"] == pytest.approx(0.5)


def test_null_feature_scores_null(data, spark):
    df, _, _ = data
    fit = model.fit_logit(df, formula="e ~ x1 + g")
    more = df.limit(5).withColumn("x1", F.when(F.col("id") % 2 == 0, F.col("x1")))
    scored = model.score(fit, more)
    assert scored.count() == 5 and scored.where("(x1 is null) <> (probability is null)").count() == 0


def test_score_equation(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    got = model.score_equation(df, {"a": 0.5, "b": -0.25}, 1.0).first()["probability"]
    assert got == pytest.approx(1 / (1 + np.exp(-1.0)))


@pytest.mark.parametrize("partitions", [1, 4, 37])
@pytest.mark.parametrize("limits", [Limits(), Limits(task_rows=50, sample_rows=100)])
def test_split_is_exact_and_stable(data, partitions, limits):
    df, _, _ = data
    train, test = model.split_sample(df.repartition(partitions), "id", 0.7, 100, limits)
    assert (train.count(), test.count()) == (1400, 600)
    assert train.join(test, "id").count() == 0
    base = model.split_sample(df, "id", 0.7, 100).train
    assert train.exceptAll(base).count() == 0


def test_small_split(spark):
    df = spark.range(10)
    train, test = model.split_sample(df, "id")
    assert (train.count(), test.count()) == (7, 3)
    train, test = model.split_sample(df.limit(1), "id")
    assert (train.count(), test.count()) == (0, 1)


def test_tree_rules(spark):
    df = spark.range(200).select(
        F.when(F.col("id") % 4 == 0, "x").otherwise("y").alias("g"), (F.col("id") % 7).cast("double").alias("v"),
        F.when(F.col("id") % 4 == 0, 1).otherwise(0).alias("e"),
    )
    fit = tree.fit_tree(df, "e", max_depth=1)
    rules = fit.rules.orderBy("leaf").collect()
    assert sorted((r["events"], r["total"]) for r in rules) == [(0, 150), (50, 50)]
    assert {r["rule"] for r in rules} == {"g IN ('x')", "g IN ('y')"}
    assert df.where(rules[0]["rule"]).count() == rules[0]["total"]
    assert {r["predicted"] for r in rules} == {0, 1}


def test_tree_splits_a_category_into_sets(spark):
    df = spark.range(4000).select(F.element_at(F.array(*[F.lit(x) for x in "abcdefgh"]), (F.col("id") % 8 + 1).cast("int")).alias("g"))
    df = df.withColumn("e", F.col("g").isin("a", "c", "e", "g").cast("int"))
    rules = [r["rule"] for r in tree.fit_tree(df, "e", max_depth=1).rules.orderBy("leaf").collect()]
    assert rules == ["g IN ('b', 'd', 'f', 'h')", "g IN ('a', 'c', 'e', 'g')"]


def test_tree_is_pruned_by_complexity(spark):
    # Eight rows among the 2,000 of one level are turned round: two splits put them right, four rows each.
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "o'x").otherwise("y").alias("g"), F.col("id").alias("v"))
    turned = F.col("v").between(1500, 1511) & (F.col("g") == "y")
    df = df.withColumn("e", ((F.col("g") == "o'x") | turned).cast("int"))
    whole, pruned = (tree.fit_tree(df, "e", cp=cp, max_bins=4000) for cp in (0.0, 0.01))
    assert whole.rules.count() > pruned.rules.count() == 2
    for fit in (whole, pruned):
        leaves = fit.rules.collect()
        assert sum(r["total"] for r in leaves) == 3000 and min(r["total"] for r in leaves) >= 7
        assert [df.where(r["rule"]).count() for r in leaves] == [r["total"] for r in leaves]
        table = fit.complexity.collect()
        assert table[0]["splits"] == 0 and table[0]["rel_error"] == 1.0
        assert [r["splits"] for r in table] == sorted({r["splits"] for r in table})
        errors = [r["rel_error"] for r in table]
        assert errors == sorted(errors, reverse=True)
    wrong = sum(min(r["events"], r["total"] - r["events"]) for r in pruned.rules.collect())
    root = df.agg(F.sum("e")).first()[0]
    assert pruned.complexity.orderBy(F.desc("splits")).first()["rel_error"] == pytest.approx(wrong / min(root, 3000 - root))


def test_tree_without_a_split(spark):
    df = spark.range(15).select((F.col("id") % 2).alias("e"), F.col("id").alias("v"))
    assert [r["rule"] for r in tree.fit_tree(df, "e").rules.collect()] == ["all rows"]
    same = spark.range(100).select(F.lit(1).alias("e"), F.lit("k").alias("g"))
    (leaf,) = tree.fit_tree(same, "e").rules.collect()
    assert (leaf["rule"], leaf["predicted"], leaf["total"]) == ("all rows", 1, 100)
    few = spark.range(18).select((F.col("id") >= 9).cast("int").alias("e"), F.col("id").alias("v"))
    assert tree.fit_tree(few, "e").rules.count() == 1 and tree.fit_tree(few, "e", min_split=18).rules.count() == 2


# --- odd inputs ------------------------------------------------------------------------


@pytest.mark.parametrize("value", [5, "only", 2.5])
def test_constant_features_give_the_constant_model(spark, value):
    df = spark.range(300).select((F.col("id") % 3 == 0).cast("int").alias("e"), F.lit(value).alias("k"))
    fit = model.fit_logit(df, formula="e ~ k")
    assert fit.estimates[0] == pytest.approx(np.log(0.5)) and fit.names == ()
    assert model.score(fit, df).agg(F.avg("probability")).first()[0] == pytest.approx(1 / 3)
    ends = model.conf_int(fit, df=df, method="profile").first()
    assert ends["low"] < np.log(0.5) < ends["high"]


def test_profile_of_a_single_feature(data):
    df, design, e = data
    fit = model.fit_logit(df, formula="e ~ x1")
    design = design[:, :2]
    _, _, dev, _ = newton(design, e)
    for k, r in enumerate(model.conf_int(fit, df=df, method="profile").collect()):
        for end in (r["low"], r["high"]):
            _, _, held, _ = newton(np.delete(design, k, axis=1), e, design[:, k] * end)
            assert held - dev == pytest.approx(3.8414588, abs=1e-4)


def test_levels_not_seen_in_training_score_null(data):
    df, _, _ = data
    fit = model.fit_logit(df, formula="e ~ x1 + g")
    more = df.limit(4).withColumn("g", F.when(F.col("id") % 2 == 0, "new").otherwise(F.col("g")))
    scored = model.score(fit, more)
    assert scored.count() == 4 and scored.where("(g = 'new') <> (probability is null)").count() == 0


def test_score_reads_its_input_once(spark, data, tmp_path):
    df, _, _ = data
    fit = model.fit_logit(df, formula="e ~ x1 + g")
    df.write.parquet(str(tmp_path / "rows"))
    plan = model.score(fit, spark.read.parquet(str(tmp_path / "rows")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Join" not in plan and "Union" not in plan


def test_too_many_features_in_all(spark):
    df = spark.range(5000).select(
        (F.col("id") % 2).alias("e"), F.concat(F.lit("a"), F.col("id") % 2500).alias("g"), F.concat(F.lit("b"), F.col("id") % 2400).alias("h")
    )
    with pytest.raises(ValueError, match="features"):
        model.fit_logit(df, "e")


def test_backward_search_of_many_terms_has_no_cap(spark):
    """46 terms, as wide as the widest study this was made for."""
    noise = [F.sin(F.col("id") * float(3.7 + i)).alias(f"n{i}") for i in range(46)]
    df = spark.range(300).select((F.sin(F.col("id") * 2.1) > 0.3).cast("int").alias("e"), *noise)
    terms = [f"n{i}" for i in range(46)]
    with pytest.raises(RuntimeError):
        model.stepwise(df, "e", terms, max_fits=40)


@pytest.mark.parametrize("values", [7, 1 << 40])
def test_rows_summed_in_a_task_that_reads_more_than_it_holds(spark, values):
    """Few distinct rows, summed again and again, and many, which are passed on after the first look."""
    n = 2 * model.HELD_ROWS + 12_345
    rows = spark.range(0, n, 1, 1).select(
        (F.col("id") % 3).cast("double").alias(model.EVENTS), (F.col("id") % values).cast("double").alias("x"),
        F.lit(1.0).alias(model.WEIGHT),
    )
    got = model._combined(rows, ["x"]).agg(F.sum(model.EVENTS), F.sum(model.WEIGHT), F.count_distinct("x"), F.count("x")).first()
    assert tuple(got)[:3] == (sum(i % 3 for i in range(n)), n, min(n, values))
    assert got[3] == (7 if values == 7 else n)
