"""Catalogue: scores from a written equation, evaluation, tiers and target lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventrate.functions import expressions as X
from eventrate.functions.numeric import round_k
from eventrate.operators import evaluate, features, model, segment
from eventrate.plans.registry import flag, query, rounded, sql_round, table

# --- scores ----------------------------------------------------------------------------

LINE_COEFFICIENTS = {"l_quantity": 0.011, "l_discount": -2.4, "l_tax": 3.1, "price": 0.0042, "urgent": 0.15}
LINE_INTERCEPT = -1.1


def scored_lines(spark, folder):
    """Line items with a written score in millionths and whether their order is finished."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey", flag(F.col("o_orderstatus") == "F").alias("e"),
        flag(F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
    )
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_quantity", "l_discount", "l_tax", (F.col("l_extendedprice") / F.lit(1000.0)).alias("price")
    )
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    scored = model.score_equation(joined, LINE_COEFFICIENTS, LINE_INTERCEPT, "p")
    # The sum behind the probability orders rows as it does, and both engines get the same digits for it.
    eta = X.linear(LINE_COEFFICIENTS, LINE_INTERCEPT)
    return scored.select("l_orderkey", "e", F.floor(F.col("p") * 1000000.0).cast("bigint").alias("ppm"), eta.alias("eta"))


LINE_ETA = " + ".join(
    ["-1.1::DOUBLE"] + [f"{w}::DOUBLE * {c}::DOUBLE" for c, w in LINE_COEFFICIENTS.items()]
)
LINE_SCORES = f"""
rows AS (SELECT l_orderkey, e, floor(1.0::DOUBLE / (1.0::DOUBLE + exp(-({LINE_ETA}))) * 1000000.0::DOUBLE)::BIGINT AS ppm, {LINE_ETA} AS eta
  FROM (SELECT l_orderkey, l_quantity, l_discount, l_tax, l_extendedprice / 1000.0::DOUBLE AS price,
               CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS e,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS urgent
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey))"""


@query(f"WITH {LINE_SCORES} SELECT ppm // 10000 AS percent, sum(e)::BIGINT AS events, count(*)::BIGINT AS rows FROM rows GROUP BY 1")
def score_equation(spark, folder):
    percent = F.floor(F.col("ppm") / 10000).cast("bigint")
    return scored_lines(spark, folder).groupBy(percent.alias("percent")).agg(
        F.sum("e").cast("bigint").alias("events"), F.count(F.lit(1)).alias("rows")
    )


# --- classes ---------------------------------------------------------------------------

CLASSIFIED = f"""{LINE_SCORES},
classed AS (SELECT e, CASE WHEN ppm / 1000000.0::DOUBLE >= (SELECT avg(e) FROM rows) THEN 1 ELSE 0 END AS predicted FROM rows),
cells AS (SELECT count(*) FILTER (predicted = 1 AND e = 1)::BIGINT AS tp, count(*) FILTER (predicted = 0 AND e = 1)::BIGINT AS fn,
                 count(*) FILTER (predicted = 1 AND e = 0)::BIGINT AS fp, count(*) FILTER (predicted = 0 AND e = 0)::BIGINT AS tn
          FROM classed)"""


def classified(spark, folder):
    scored = scored_lines(spark, folder).withColumn("p", F.col("ppm") / F.lit(1000000.0))
    return evaluate.classify(scored, "p", event="e")


@query(f"WITH {CLASSIFIED} SELECT predicted::INTEGER AS predicted, count(*)::BIGINT AS rows FROM classed GROUP BY 1")
def classify(spark, folder):
    return classified(spark, folder).groupBy("predicted").agg(F.count(F.lit(1)).alias("rows"))


@query(f"WITH {CLASSIFIED} SELECT * FROM cells")
def confusion(spark, folder):
    return evaluate.confusion(classified(spark, folder), "predicted", "e")


_N = "(tp + fn + fp + tn)::DOUBLE"
STATS = {
    "accuracy": f"(tp + tn) / {_N}",
    "no_information_rate": f"greatest(tp + fn, fp + tn) / {_N}",
    "kappa": f"((tp + tn) / {_N} - c) / (1 - c)",
    "sensitivity": "tp / (tp + fn)::DOUBLE",
    "specificity": "tn / (fp + tn)::DOUBLE",
    "ppv": "tp / (tp + fp)::DOUBLE",
    "npv": "tn / (fn + tn)::DOUBLE",
    "prevalence": f"(tp + fn) / {_N}",
    "detection_rate": f"tp / {_N}",
    "detection_prevalence": f"(tp + fp) / {_N}",
    "balanced_accuracy": "(tp / (tp + fn)::DOUBLE + tn / (fp + tn)::DOUBLE) / 2",
}


@query(f"""WITH {CLASSIFIED} SELECT {', '.join(f"{sql_round(f'({e})', 9)} AS {n}" for n, e in STATS.items())}
FROM (SELECT *, ((tp + fp)::DOUBLE * (tp + fn) + (fn + tn)::DOUBLE * (fp + tn)) / ({_N} * {_N}) AS c FROM cells)""")
def confusion_stats(spark, folder):
    return rounded(evaluate.confusion_stats(confusion(spark, folder)), 9, *STATS)


# Binomial tails by their terms; the interval by halving; a normal tail by Simpson's rule.
def _normal_sql(z: str) -> str:
    """Two-sided normal tail of ``z`` (an expression of one-row ``m``)."""
    point = f"(i * least(abs({z}), 9.0::DOUBLE) / 4000.0::DOUBLE)"
    weight = "CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    area = f"sum({weight} * exp(-{point} * {point} / 2)) * max(least(abs({z}), 9.0::DOUBLE)) / 12000.0::DOUBLE / sqrt(2 * pi())"
    return f"(SELECT greatest(1 - 2 * ({area}), 0) FROM m, range(0, 4001) t(i))"


CELL_TESTS = f"""{CLASSIFIED},
m AS (SELECT (tp + fn + fp + tn) AS n, (tp + tn) AS hits, greatest(tp + fn, fp + tn)::DOUBLE / (tp + fn + fp + tn) AS base,
             CASE WHEN fp + fn > 0 THEN (abs(fp - fn) - 1)::DOUBLE * (abs(fp - fn) - 1) / (fp + fn) END AS chi FROM cells),
terms AS (SELECT k, n, hits, lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0) AS c FROM m, (SELECT unnest(range(0, n + 1)) AS k FROM m)),
halves AS (
  SELECT 0 AS i, side, CASE WHEN side = 0 THEN 0::DOUBLE ELSE hits::DOUBLE / n END AS a,
         CASE WHEN side = 0 THEN hits::DOUBLE / n ELSE 1::DOUBLE END AS b FROM m, (VALUES (0), (1)) AS t(side)
  UNION ALL
  -- The low end has an upper tail of 2.5 %, the high end a lower one.
  SELECT i + 1, side, CASE WHEN (side = 0) = (tail < 0.025) THEN (a + b) / 2 ELSE a END,
         CASE WHEN (side = 0) = (tail < 0.025) THEN b ELSE (a + b) / 2 END
  FROM (SELECT i, side, a, b, sum(exp(c + k * ln((a + b) / 2) + (n - k) * ln(1 - (a + b) / 2))) AS tail
        FROM halves, terms WHERE i < 40 AND CASE WHEN side = 0 THEN k >= hits ELSE k <= hits END GROUP BY i, side, a, b))"""


@query(f"""WITH RECURSIVE {CELL_TESTS}
SELECT {sql_round("(SELECT (a + b) / 2 FROM halves WHERE i = 40 AND side = 0)", 6)} AS accuracy_low,
  {sql_round("(SELECT (a + b) / 2 FROM halves WHERE i = 40 AND side = 1)", 6)} AS accuracy_high,
  {sql_round("(SELECT sum(exp(c + k * ln(base) + (t.n - k) * ln(1 - base))) FROM terms t, m WHERE k >= m.hits)", 6)} AS accuracy_p,
  {sql_round("(SELECT chi FROM m)", 6)} AS mcnemar, {sql_round(_normal_sql("sqrt(chi)"), 6)} AS mcnemar_p""")
def confusion_tests(spark, folder):
    """Exact accuracy interval, its test, and McNemar's test."""
    found = evaluate.confusion_tests(confusion(spark, folder))
    return rounded(found, 6, *found.columns)


@query(f"WITH {CLASSIFIED} SELECT {sql_round('avg(CASE WHEN predicted <> e THEN 1 ELSE 0 END)', 9)} AS error_rate FROM classed")
def error_rate(spark, folder):
    return rounded(evaluate.error_rate(classified(spark, folder), "predicted", "e"), 9, "error_rate")


@query(f"""WITH {CLASSIFIED},
m AS (SELECT {_N} AS n, (tp + tn)::DOUBLE AS same, (tp + fp)::DOUBLE AS r1, (fn + tn)::DOUBLE AS r0,
             (tp + fn)::DOUBLE AS c1, (fp + tn)::DOUBLE AS c0 FROM cells),
k AS (SELECT n, same / n AS po, (r1 * c1 + r0 * c0) / (n * n) AS pe,
             (r1 * c1 * (r1 + c1) + r0 * c0 * (r0 + c0)) / (n * n * n) AS s FROM m)
SELECT n::BIGINT AS subjects, {sql_round('((po - pe) / (1 - pe))', 9)} AS kappa,
       {sql_round('(((po - pe) / (1 - pe)) / (sqrt(pe + pe * pe - s) / ((1 - pe) * sqrt(n))))', 6)} AS z FROM k""")
def kappa(spark, folder):
    found = evaluate.kappa(classified(spark, folder), "predicted", "e")
    return rounded(rounded(found, 9, "kappa"), 6, "z")


KAPPA = f"""{CLASSIFIED},
w AS (SELECT {_N} AS n, (tp + tn)::DOUBLE AS same, (tp + fp)::DOUBLE AS r1, (fn + tn)::DOUBLE AS r0,
             (tp + fn)::DOUBLE AS c1, (fp + tn)::DOUBLE AS c0 FROM cells),
k AS (SELECT n, same / n AS po, (r1 * c1 + r0 * c0) / (n * n) AS pe,
             (r1 * c1 * (r1 + c1) + r0 * c0 * (r0 + c0)) / (n * n * n) AS s FROM w),
m AS (SELECT n, (po - pe) / (1 - pe) AS kappa, ((po - pe) / (1 - pe)) / (sqrt(pe + pe * pe - s) / ((1 - pe) * sqrt(n))) AS z FROM k)"""


@query(f"""WITH {KAPPA} SELECT n::BIGINT AS subjects, {sql_round('kappa', 9)} AS kappa, {sql_round('z', 6)} AS z,
  {sql_round(_normal_sql('z'), 6)} AS p_value FROM m""")
def kappa_test(spark, folder):
    found = evaluate.kappa_test(classified(spark, folder), "predicted", "e")
    return rounded(rounded(found, 9, "kappa"), 6, "z", "p_value")


# --- curves and pairs ------------------------------------------------------------------

BY_SCORE = f"""{LINE_SCORES},
s AS (SELECT eta AS score, sum(e)::BIGINT AS ones, (count(*) - sum(e))::BIGINT AS zeros FROM rows GROUP BY eta),
run AS (SELECT *, coalesce(sum(ones) OVER w, 0) AS ones_below, coalesce(sum(zeros) OVER w, 0) AS zeros_below,
               sum(ones) OVER () AS p, sum(zeros) OVER () AS n
        FROM s WINDOW w AS (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pairs AS (SELECT sum(ones)::HUGEINT * sum(zeros) AS pairs, sum(ones * zeros_below) AS concordant, sum(ones * zeros) AS ties FROM run)"""


@query(f"""WITH {BY_SCORE} SELECT score, (p - ones_below)::BIGINT AS tp, (n - zeros_below)::BIGINT AS fp,
  (p - ones_below)::DOUBLE / p::DOUBLE AS tpr, (n - zeros_below)::DOUBLE / n::DOUBLE AS fpr FROM run
UNION ALL SELECT NULL, 0, 0, 0, 0 FROM pairs""")
def roc_curve(spark, folder):
    return evaluate.roc_curve(scored_lines(spark, folder), "eta", "e")


@query(f"WITH {BY_SCORE} SELECT {sql_round('((concordant::DOUBLE + ties::DOUBLE / 2) / pairs::DOUBLE)', 9)} AS auc FROM pairs")
def auc(spark, folder):
    return rounded(evaluate.auc(scored_lines(spark, folder), "eta", "e"), 9, "auc")


@query(f"""WITH {BY_SCORE} SELECT pairs::BIGINT AS pairs, concordant::BIGINT AS concordant,
  (pairs - concordant - ties)::BIGINT AS discordant, ties::BIGINT AS ties,
  {sql_round('(concordant::DOUBLE / pairs::DOUBLE)', 9)} AS concordance_ratio,
  {sql_round('((pairs - concordant - ties)::DOUBLE / pairs::DOUBLE)', 9)} AS discordance_ratio,
  {sql_round('(ties::DOUBLE / pairs::DOUBLE)', 9)} AS tie_ratio FROM pairs""")
def concordance(spark, folder):
    found = evaluate.concordance(scored_lines(spark, folder), "eta", "e")
    counts = {c: F.col(c).cast("bigint") for c in ("pairs", "concordant", "discordant", "ties")}
    return rounded(found.withColumns(counts), 9, "concordance_ratio", "discordance_ratio", "tie_ratio")


# --- tiers and targets -----------------------------------------------------------------


def scored_orders(spark, folder):
    """Orders with score, predicted class and value."""
    orders = table(spark, folder, "orders")
    urgent = features.dummies(
        orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice"), "o_orderpriority",
        {"1-URGENT": "urgent", "2-HIGH": "high"},
    ).withColumn("price", F.col("o_totalprice") / F.lit(100000.0))
    scored = model.score_equation(urgent, {"urgent": 0.35, "high": 0.2, "price": -0.17}, -0.4, "p")
    scored = scored.withColumn("ppm", F.floor(F.col("p") * 1000000.0).cast("bigint"))
    return scored.withColumn("predicted", flag(F.col("ppm") >= 380000)).select(
        "o_orderkey", "o_custkey", "o_totalprice", "ppm", "predicted"
    )


ORDER_SCORES = """
rows AS (SELECT *, CASE WHEN ppm >= 380000 THEN 1 ELSE 0 END AS predicted FROM (
  SELECT o_orderkey, o_custkey, o_totalprice, floor(1.0::DOUBLE / (1.0::DOUBLE + exp(-(-0.4::DOUBLE
      + 0.35::DOUBLE * (CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END)::DOUBLE
      + 0.2::DOUBLE * (CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END)::DOUBLE
      + -0.17::DOUBLE * (o_totalprice / 100000.0::DOUBLE)))) * 1000000.0::DOUBLE)::BIGINT AS ppm FROM orders))"""
TIERS = f"""{ORDER_SCORES},
tiered AS (SELECT *, ['Low', 'Med', 'High'][ntile(3) OVER (ORDER BY ppm, o_orderkey)] AS prob_tier,
                  ['Low', 'Med', 'High'][ntile(3) OVER (ORDER BY o_totalprice, o_orderkey)] AS value_tier FROM rows)"""
LABELS = ["Low", "Med", "High"]


def tiered_orders(spark, folder):
    scored = segment.tier(scored_orders(spark, folder), "ppm", 3, "o_orderkey", "prob_tier", LABELS)
    return segment.tier(scored, "o_totalprice", 3, "o_orderkey", "value_tier", LABELS)


@query(f"WITH {TIERS} SELECT o_orderkey, prob_tier, value_tier FROM tiered")
def tier_labels(spark, folder):
    return tiered_orders(spark, folder).select("o_orderkey", "prob_tier", "value_tier")


@query(f"WITH {TIERS} SELECT prob_tier, max(ppm) AS max, min(ppm) AS min, count(*)::BIGINT AS rows FROM tiered GROUP BY prob_tier")
def tier_bounds(spark, folder):
    tiers = segment.tier(scored_orders(spark, folder), "ppm", 3, "o_orderkey", "prob_tier", LABELS)
    return segment.tier_bounds(tiers, "prob_tier", "ppm")


@query(f"""WITH {TIERS} SELECT value_tier, {', '.join(f'count(*) FILTER (prob_tier = {chr(39)}{t}{chr(39)})::BIGINT AS "{t}"' for t in LABELS)}
FROM tiered GROUP BY value_tier""")
def tier_crosstab(spark, folder):
    return segment.tier_crosstab(tiered_orders(spark, folder), "value_tier", "prob_tier", LABELS)


@query(f"""WITH {TIERS} SELECT o_orderkey FROM tiered
WHERE ppm > (SELECT max(ppm) FROM tiered WHERE prob_tier = 'Low')
  AND o_totalprice > (SELECT max(o_totalprice) FROM tiered WHERE value_tier = 'Low')""")
def target_list(spark, folder):
    """Rows above the low tier in score and value, the thresholds taken from the tiers."""
    tiers = tiered_orders(spark, folder)
    top = tiers.agg(
        F.max(F.when(F.col("prob_tier") == "Low", F.col("ppm"))).alias("ppm"),
        F.max(F.when(F.col("value_tier") == "Low", F.col("o_totalprice"))).alias("o_totalprice"),
    ).first().asDict()
    return segment.target_list(scored_orders(spark, folder), top, "o_orderkey")


@query(f"WITH {ORDER_SCORES} SELECT o_orderkey FROM rows WHERE predicted = 1")
def flagged_list(spark, folder):
    return segment.flagged_list(scored_orders(spark, folder), "predicted", "o_orderkey")


@query(f"WITH {ORDER_SCORES} SELECT o_orderkey, {sql_round('(predicted * o_totalprice)', 2)} AS weighted FROM rows")
def weighted_score(spark, folder):
    scored = features.weighted_score(scored_orders(spark, folder), "predicted", "o_totalprice")
    return scored.select("o_orderkey", round_k("weighted", 2).alias("weighted"))


BUDGET = f"""{ORDER_SCORES},
tiled AS (SELECT *, ntile(10) OVER (ORDER BY predicted * o_totalprice, o_orderkey) AS tile FROM rows),
picked AS (SELECT tile::INTEGER AS tile, o_custkey, count(*)::BIGINT AS rows FROM tiled WHERE tile > 8 GROUP BY tile, o_custkey)"""


def budget(spark, folder):
    scored = features.weighted_score(scored_orders(spark, folder), "predicted", "o_totalprice")
    return segment.budget_target(scored, "weighted", "o_custkey", tie_key="o_orderkey")


@query(f"WITH {BUDGET} SELECT * FROM picked")
def budget_target(spark, folder):
    return budget(spark, folder)


@query(f"""WITH {BUDGET} SELECT sum(rows)::BIGINT AS targeted, (SELECT count(*) FROM rows)::BIGINT AS population,
  sum(rows)::DOUBLE / (SELECT count(*) FROM rows)::DOUBLE AS share FROM picked""")
def target_share(spark, folder):
    scored = features.weighted_score(scored_orders(spark, folder), "predicted", "o_totalprice")
    picked = segment.budget_target(scored, "weighted", "o_orderkey")
    return segment.target_share(picked, scored)
