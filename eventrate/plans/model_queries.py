"""Catalogue: split, logistic regression, stepwise selection and trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventrate.operators import model, tree
from eventrate.plans.registry import flag, query, rounded, sql_round, table


@query("""SELECT o_orderkey, CASE WHEN place <= floor(0.7 * n) THEN 'train' ELSE 'test' END AS part FROM (
  SELECT o_orderkey, count(*) OVER () AS n,
         row_number() OVER (ORDER BY md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), '100')), o_orderkey) AS place FROM orders)""")
def split_sample(spark, folder):
    parts = model.split_sample(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey", 0.7, 100)
    return parts.train.withColumn("part", F.lit("train")).unionByName(parts.test.withColumn("part", F.lit("test")))


def line_features(spark, folder):
    """Line items with order and part attributes, and whether the order is finished."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey", flag(F.col("o_orderstatus") == "F").alias("finished"), "o_orderpriority",
        flag(F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
    )
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", (F.col("l_quantity") / F.lit(10.0)).alias("tens"), "l_discount", "l_returnflag"
    )
    parts = table(spark, folder, "part").select("p_partkey", "p_type", "p_size")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select("finished", "tens", "l_discount", "urgent", "l_returnflag", "p_type", "p_size", "o_orderpriority")
    )


# Newton steps for an intercept and two features over the distinct feature values.
NEWTON = f"""
cells AS (SELECT x1, x2, sum(e)::DOUBLE AS e, count(*)::DOUBLE AS n FROM (
    SELECT l_quantity / 10.0::DOUBLE AS x1, (CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END)::DOUBLE AS x2,
           CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS e
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey) GROUP BY x1, x2),
steps AS (
  SELECT 0 AS i, 0::DOUBLE AS b0, 0::DOUBLE AS b1, 0::DOUBLE AS b2
  UNION ALL
  SELECT i + 1,
    b0 + ((c*f - d*d)*g0 + (q*d - a*f)*g1 + (a*d - q*c)*g2) / (h*(c*f - d*d) - a*(a*f - q*d) + q*(a*d - q*c)),
    b1 + ((q*d - a*f)*g0 + (h*f - q*q)*g1 + (a*q - h*d)*g2) / (h*(c*f - d*d) - a*(a*f - q*d) + q*(a*d - q*c)),
    b2 + ((a*d - q*c)*g0 + (a*q - h*d)*g1 + (h*c - a*a)*g2) / (h*(c*f - d*d) - a*(a*f - q*d) + q*(a*d - q*c))
  FROM (SELECT i, b0, b1, b2, sum(e - n*p) AS g0, sum((e - n*p)*x1) AS g1, sum((e - n*p)*x2) AS g2,
               sum(w) AS h, sum(w*x1) AS a, sum(w*x2) AS q, sum(w*x1*x1) AS c, sum(w*x1*x2) AS d, sum(w*x2*x2) AS f
        FROM (SELECT *, n*p*(1 - p) AS w FROM (
                SELECT *, 1 / (1 + exp(-(b0 + b1*x1 + b2*x2))) AS p FROM cells, steps WHERE i < 12))
        GROUP BY i, b0, b1, b2)),
fit AS (SELECT b0, b1, b2 FROM steps WHERE i = 12),
scored AS (SELECT *, 1 / (1 + exp(-(b0 + b1*x1 + b2*x2))) AS p FROM cells, fit),
info AS (SELECT sum(w) AS h, sum(w*x1) AS a, sum(w*x2) AS q, sum(w*x1*x1) AS c, sum(w*x1*x2) AS d, sum(w*x2*x2) AS f
         FROM (SELECT *, n*p*(1 - p) AS w FROM scored)),
errors AS (SELECT sqrt((c*f - d*d) / det) AS s0, sqrt((h*f - q*q) / det) AS s1, sqrt((h*c - a*a) / det) AS s2
           FROM (SELECT *, h*(c*f - d*d) - a*(a*f - q*d) + q*(a*d - q*c) AS det FROM info)),
coefs AS (SELECT '(Intercept)' AS term, b0 AS estimate, s0 AS std_error FROM fit, errors
  UNION ALL SELECT 'tens', b1, s1 FROM fit, errors UNION ALL SELECT 'urgent', b2, s2 FROM fit, errors),
fitted AS (SELECT -2 * sum(e*ln(p) + (n - e)*ln(1 - p)) AS dev, sum(n) AS n,
                  -2 * (sum(e)*ln(sum(e)/sum(n)) + (sum(n) - sum(e))*ln(1 - sum(e)/sum(n))) AS base FROM scored)"""


def _fit(spark, folder):
    return model.fit_logit(line_features(spark, folder), formula="finished ~ tens + urgent")


@query(f"""WITH RECURSIVE {NEWTON} SELECT {sql_round('base', 4)} AS null_deviance, (n - 1)::BIGINT AS null_df,
  {sql_round('dev', 4)} AS deviance, (n - 3)::BIGINT AS residual_df, {sql_round('(dev + 6)', 4)} AS aic FROM fitted""")
def logit_fit(spark, folder):
    return rounded(model.fit_summary(_fit(spark, folder)), 4, "null_deviance", "deviance", "aic")


@query(f"""WITH RECURSIVE {NEWTON} SELECT term, {sql_round('estimate', 6)} AS estimate, {sql_round('std_error', 6)} AS std_error,
  {sql_round('(estimate / std_error)', 4)} AS z FROM coefs""")
def coef_table(spark, folder):
    found = model.coef_table(_fit(spark, folder)).drop("p_value")
    return rounded(rounded(found, 6, "estimate", "std_error"), 4, "z")


@query(f"""WITH RECURSIVE {NEWTON} SELECT {sql_round('(base - dev)', 4)} AS chi_square, 2::BIGINT AS df,
  {sql_round('exp(-(base - dev) / 2)', 5)} AS p_value FROM fitted""")
def deviance_test(spark, folder):
    """With two degrees of freedom the tail is an exponential, which SQL can state."""
    return rounded(rounded(model.deviance_test(_fit(spark, folder)), 4, "chi_square"), 5, "p_value")


@query(f"""WITH RECURSIVE {NEWTON} SELECT term, {sql_round('(estimate - 1.959963984540054::DOUBLE * std_error)', 6)} AS low,
  {sql_round('(estimate + 1.959963984540054::DOUBLE * std_error)', 6)} AS high FROM coefs""")
def conf_int(spark, folder):
    return rounded(model.conf_int(_fit(spark, folder)), 6, "low", "high")


# One 0/1 feature: the ends of a profile interval by bisection, each step with Newton steps of the other coefficient.
ONE_FEATURE = """
sides AS (SELECT (CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END)::DOUBLE AS x,
                 sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::DOUBLE AS e, count(*)::DOUBLE AS n
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1),
known AS (SELECT max(ln(e / (n - e))) FILTER (x = 0) AS b0,
                 max(ln(e / (n - e))) FILTER (x = 1) - max(ln(e / (n - e))) FILTER (x = 0) AS b1,
                 -2 * sum(e*ln(e / n) + (n - e)*ln(1 - e / n)) AS dev,
                 sqrt(max(1 / e + 1 / (n - e)) FILTER (x = 0)) AS s0, sqrt(sum(1 / e + 1 / (n - e))) AS s1 FROM sides),
ends AS (SELECT unnest(['(Intercept)', '(Intercept)', 'urgent', 'urgent']) AS term, unnest([-1, 1, -1, 1]) AS side),
search AS (
  SELECT 0 AS i, term, side, CASE WHEN term = 'urgent' THEN b1 ELSE b0 END AS a,
         CASE WHEN term = 'urgent' THEN b1 + side * 6 * s1 ELSE b0 + side * 6 * s0 END AS b,
         CASE WHEN term = 'urgent' THEN b0 ELSE b1 END AS free, 0 AS k FROM ends, known
  UNION ALL
  -- 12 Newton steps of the free coefficient for every halving of the interval.
  SELECT i + 1, term, side,
         CASE WHEN k = 12 AND d - dev < 3.841458820694124 THEN (a + b) / 2 ELSE a END,
         CASE WHEN k = 12 AND d - dev >= 3.841458820694124 THEN (a + b) / 2 ELSE b END,
         CASE WHEN k = 12 THEN free ELSE free + g / w END, CASE WHEN k = 12 THEN 0 ELSE k + 1 END
  FROM (SELECT i, term, side, a, b, free, k, sum(z * (e - n*p)) AS g, sum(z * z * n*p*(1 - p)) AS w,
               -2 * sum(e*ln(p) + (n - e)*ln(1 - p)) AS d
        FROM (SELECT *, CASE WHEN term = 'urgent' THEN 1 ELSE x END AS z,
                     1 / (1 + exp(-(CASE WHEN term = 'urgent' THEN free + (a + b) / 2 * x ELSE (a + b) / 2 + free * x END))) AS p
              FROM search, sides WHERE i < 13 * 45)
        GROUP BY i, term, side, a, b, free, k), known)"""


@query(f"""WITH RECURSIVE {ONE_FEATURE}
SELECT term, {sql_round("max((a + b) / 2) FILTER (side = -1)", 4)} AS low, {sql_round("max((a + b) / 2) FILTER (side = 1)", 4)} AS high
FROM search WHERE i = 13 * 45 GROUP BY term""")
def conf_int_profile(spark, folder):
    """Profile-likelihood intervals of a model with a single feature."""
    rows = line_features(spark, folder)
    fit = model.fit_logit(rows, formula="finished ~ urgent")
    return rounded(model.conf_int(fit, df=rows, method="profile"), 4, "low", "high")


@query(f"""WITH RECURSIVE {NEWTON} SELECT {sql_round('x1', 1)} AS tens, x2::INTEGER AS urgent, {sql_round('p', 6)} AS probability,
  n::BIGINT AS rows FROM scored""")
def score(spark, folder):
    """Fitted probabilities, one row per combination of feature values."""
    rows = line_features(spark, folder)
    scored = model.score(model.fit_logit(rows, formula="finished ~ tens + urgent"), rows)
    cells = scored.groupBy("tens", "urgent").agg(F.avg("probability").alias("probability"), F.count(F.lit(1)).alias("rows"))
    return rounded(rounded(cells, 1, "tens"), 6, "probability")


@query(f"""WITH cells AS (SELECT p_type, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::DOUBLE AS e, count(*)::DOUBLE AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY p_type),
base AS (SELECT e, n FROM cells WHERE p_type = (SELECT min(p_type) FROM cells))
SELECT '(Intercept)' AS term, {sql_round('ln(e / (n - e))', 6)} AS estimate, {sql_round('sqrt(1 / e + 1 / (n - e))', 6)} AS std_error FROM base
UNION ALL SELECT 'p_type_' || c.p_type, {sql_round('(ln(c.e / (c.n - c.e)) - ln(b.e / (b.n - b.e)))', 6)},
  {sql_round('sqrt(1 / c.e + 1 / (c.n - c.e) + 1 / b.e + 1 / (b.n - b.e))', 6)}
FROM cells c, base b WHERE c.p_type > (SELECT min(p_type) FROM cells)""")
def logit_factor(spark, folder):
    """A model on one category, whose coefficients are differences of log odds."""
    fit = model.fit_logit(line_features(spark, folder), formula="finished ~ p_type")
    return rounded(model.coef_table(fit).select("term", "estimate", "std_error"), 6, "estimate", "std_error")


@query(f"""WITH RECURSIVE {NEWTON} SELECT term, {sql_round('estimate', 6)} AS estimate, {sql_round('std_error', 6)} AS std_error FROM coefs""")
def logit_all_columns(spark, folder):
    """All columns of a frame as features but the excluded one."""
    rows = line_features(spark, folder).select("finished", "tens", "urgent", "p_type")
    found = model.coef_table(model.fit_logit(rows, "finished", exclude=["p_type"]))
    return rounded(found.select("term", "estimate", "std_error"), 6, "estimate", "std_error")


# Deviance of the model on ``tens`` alone, by Newton steps with two coefficients.
NEWTON_TENS = """
lines AS (SELECT x1, sum(e) AS e, sum(n) AS n FROM cells GROUP BY x1),
walk AS (
  SELECT 0 AS i, 0::DOUBLE AS b0, 0::DOUBLE AS b1
  UNION ALL
  SELECT i + 1, b0 + (c*g0 - a*g1) / (h*c - a*a), b1 + (h*g1 - a*g0) / (h*c - a*a)
  FROM (SELECT i, b0, b1, sum(e - n*p) AS g0, sum((e - n*p)*x1) AS g1, sum(w) AS h, sum(w*x1) AS a, sum(w*x1*x1) AS c
        FROM (SELECT *, n*p*(1 - p) AS w FROM (SELECT *, 1 / (1 + exp(-(b0 + b1*x1))) AS p FROM lines, walk WHERE i < 12))
        GROUP BY i, b0, b1)),
alone AS (
  SELECT (SELECT dev + 6 FROM fitted) AS complete,
         (SELECT -2 * sum(e*ln(p) + (n - e)*ln(1 - p)) + 4 FROM (
            SELECT *, 1 / (1 + exp(-(b0 + b1*x1))) AS p FROM lines, walk WHERE i = 12)) AS tens,
         (SELECT -2 * sum(e*ln(e / n) + (n - e)*ln(1 - e / n)) + 4 FROM (
            SELECT x2, sum(e) AS e, sum(n) AS n FROM cells GROUP BY x2)) AS urgent,
         (SELECT base + 2 FROM fitted) AS none)"""


@query(f"""WITH RECURSIVE {NEWTON}, {NEWTON_TENS}
SELECT 0::BIGINT AS step, '' AS move, NULL::VARCHAR AS term, {sql_round("complete", 4)} AS aic FROM alone
UNION ALL SELECT 1, '-', CASE WHEN tens < urgent THEN 'urgent' ELSE 'tens' END, {sql_round('least(tens, urgent)', 4)}
  FROM alone WHERE least(tens, urgent) < complete
UNION ALL SELECT 2, '-', CASE WHEN tens < urgent THEN 'tens' ELSE 'urgent' END, {sql_round('none', 4)}
  FROM alone WHERE least(tens, urgent) < complete AND none < least(tens, urgent)""")
def stepwise(spark, folder):
    """Backward selection by AIC, down to the intercept if need be."""
    path = model.stepwise(line_features(spark, folder), "finished", ["tens", "urgent"]).steps
    return rounded(path.drop("fits"), 4, "aic")


@query(f"""WITH cells AS (SELECT p_type, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::DOUBLE AS e, count(*)::DOUBLE AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY p_type),
aics AS (SELECT -2 * sum(e*ln(e / n) + (n - e)*ln(1 - e / n)) + 2 * count(*) AS complete,
                -2 * (sum(e)*ln(sum(e)/sum(n)) + (sum(n) - sum(e))*ln(1 - sum(e)/sum(n))) + 2 AS none FROM cells)
SELECT 0::BIGINT AS step, '' AS move, NULL::VARCHAR AS term, {sql_round('complete', 4)} AS aic FROM aics
UNION ALL SELECT 1, '-', 'p_type', {sql_round('none', 4)} FROM aics WHERE none < complete""")
def stepwise_factors(spark, folder):
    """Backward selection with a whole category as one term; with one category the AIC is known in closed form."""
    path = model.stepwise(line_features(spark, folder), "finished", ["p_type"]).steps
    return rounded(path.drop("fits"), 4, "aic")


def _tree_sql(source, low, high, digits=6):
    """Two leaves of a planted rule; ``low`` and ``high`` are SQL for the text of their conditions."""
    return f"""WITH rows AS ({source})
SELECT leaf::BIGINT AS leaf, CASE WHEN leaf = 0 THEN {low} ELSE {high} END AS rule, leaf::INTEGER AS predicted,
  sum(e)::BIGINT AS events, count(*)::BIGINT AS total, {sql_round('(sum(e)::DOUBLE / count(*)::DOUBLE)', digits)} AS rate
FROM rows GROUP BY leaf"""


def _levels_sql(source, leaf):
    return (f"(SELECT 'p_type IN (' || string_agg(chr(39) || p_type || chr(39), ', ' ORDER BY p_type) || ')' "
            f"FROM (SELECT DISTINCT p_type FROM ({source}) WHERE leaf = {leaf}))")


TYPED_PARTS = """SELECT p_type, CASE WHEN length(p_type) % 2 = 0 THEN 1 ELSE 0 END AS leaf,
  CASE WHEN (length(p_type) % 2 = 0) <> (l_orderkey % 40 = 0) THEN 1 ELSE 0 END AS e
  FROM lineitem JOIN part ON l_partkey = p_partkey"""
PLANTED = """SELECT p_type, CASE WHEN length(p_type) % 2 = 0 THEN 1 ELSE 0 END AS leaf,
  CASE WHEN length(p_type) % 2 = 0 THEN 1 ELSE 0 END AS e FROM lineitem JOIN part ON l_partkey = p_partkey"""


def planted(spark, folder):
    """Line items whose event is a set of part types, and the same with every fortieth order turned round."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus"
    )
    joined = lines.join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    inside = F.length("p_type") % 2 == 0
    return joined.select(
        flag(inside).alias("pure"), flag(inside != (F.col("l_orderkey") % 40 == 0)).alias("noisy"), "p_type",
        "p_size", "l_quantity", "l_discount", "l_returnflag", "l_linestatus",
    )


@query(_tree_sql(PLANTED, _levels_sql(PLANTED, 0), _levels_sql(PLANTED, 1)))
def tree_subset(spark, folder):
    """A category is split into two sets of levels at once."""
    rows = planted(spark, folder)
    return rounded(tree.fit_tree(rows, "pure", exclude=["noisy"], max_depth=1, folds=0).rules, 6, "rate")


@query(_tree_sql(TYPED_PARTS, _levels_sql(TYPED_PARTS, 0), _levels_sql(TYPED_PARTS, 1)))
def tree_all_columns(spark, folder):
    """All columns, any depth, with noise that pruning takes away."""
    rows = planted(spark, folder)
    return rounded(tree.fit_tree(rows, "noisy", exclude=["pure"], folds=0).rules, 6, "rate")


@query("""WITH rows AS (SELECT l_quantity, l_returnflag, CASE WHEN l_quantity > 25 OR l_returnflag = 'R' THEN 1 ELSE 0 END AS e FROM lineitem),
leaves AS (SELECT CASE WHEN l_quantity > 25.5 THEN 2 WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS leaf, e FROM rows)
SELECT leaf::BIGINT AS leaf, ['l_quantity <= 25.5 and l_returnflag IN (''A'', ''N'')', 'l_quantity <= 25.5 and l_returnflag IN (''R'')', 'l_quantity > 25.5'][leaf + 1] AS rule,
  CASE WHEN leaf = 0 THEN 0 ELSE 1 END::INTEGER AS predicted, sum(e)::BIGINT AS events, count(*)::BIGINT AS total,
  sum(e)::DOUBLE / count(*)::DOUBLE AS rate FROM leaves GROUP BY leaf""")
def tree_rules(spark, folder):
    """A tree must recover the two conditions from which its event was made."""
    lines = table(spark, folder, "lineitem").select("l_quantity", "l_returnflag", "l_linestatus")
    made = lines.withColumn("e", flag((F.col("l_quantity") > 25) | (F.col("l_returnflag") == "R")))
    return tree.fit_tree(made, "e", ["l_quantity", "l_returnflag", "l_linestatus"], max_depth=3, folds=0).rules


# Every cut of every number, by running sums over its values: (feature, threshold, counts on the left, gain).
ALL_CUTS = """
present AS (SELECT feature, v, e FROM rows UNPIVOT (v FOR feature IN ({columns}))),
vals AS (SELECT feature, v, sum(e)::DOUBLE AS e, count(*)::DOUBLE AS n FROM present GROUP BY feature, v),
run AS (SELECT feature, v + (lead(v) OVER w - v) / 2 AS cut, sum(e) OVER w AS e, sum(n) OVER w AS n,
               sum(e) OVER (PARTITION BY feature) AS ae, sum(n) OVER (PARTITION BY feature) AS an
        FROM vals WINDOW w AS (PARTITION BY feature ORDER BY v)),
cuts AS (SELECT *, (e*e + (n - e)*(n - e)) / n + ((ae - e)*(ae - e) + (an - n - ae + e)*(an - n - ae + e)) / (an - n)
                   - (ae*ae + (an - ae)*(an - ae)) / an AS gain
         FROM run WHERE cut IS NOT NULL AND n >= 7 AND an - n >= 7),
best AS (SELECT * FROM cuts ORDER BY gain DESC, feature, cut LIMIT 1)"""
FINISHED_LINES = """rows AS (SELECT l_discount::DOUBLE AS a, l_extendedprice::DOUBLE AS b, l_quantity::DOUBLE AS c,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query(f"""WITH {FINISHED_LINES}, {ALL_CUTS.format(columns='a, b, c')},
sides AS (SELECT CASE WHEN (CASE feature WHEN 'a' THEN a WHEN 'b' THEN b ELSE c END) <= cut THEN 0 ELSE 1 END AS leaf, rows.e FROM rows, best)
SELECT leaf::BIGINT AS leaf, CASE WHEN 2 * sum(e) > count(*) THEN 1 ELSE 0 END::INTEGER AS predicted,
  sum(e)::BIGINT AS events, count(*)::BIGINT AS total FROM sides GROUP BY leaf""")
def tree_best_cut(spark, folder):
    """One split where nothing is planted: the best of all cuts between the values of three numbers."""
    orders = table(spark, folder, "orders").select("o_orderkey", flag(F.col("o_orderstatus") == "F").alias("e"))
    lines = table(spark, folder, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = lines.select(F.col("l_discount").alias("a"), F.col("l_extendedprice").alias("b"), F.col("l_quantity").alias("c"), "e")
    return tree.fit_tree(rows, "e", ["a", "b", "c"], max_depth=1, cp=-1.0, folds=0).rules.drop("rule", "rate")


GAPPED = """rows AS (SELECT CASE WHEN l_orderkey % 7 > 0 THEN l_quantity::DOUBLE END AS a, l_extendedprice::DOUBLE AS b,
  CASE WHEN (l_quantity > 30) <> (l_partkey % 5 = 0) THEN 1 ELSE 0 END AS e FROM lineitem)"""
AGREEING = f"""{GAPPED}, {ALL_CUTS.format(columns='a')},
sided AS (SELECT b, CASE WHEN a <= cut THEN 1 ELSE 0 END AS side FROM rows, best WHERE a IS NOT NULL),
others AS (SELECT b, sum(side) AS s, count(*) AS n FROM sided GROUP BY b),
along AS (SELECT b + (lead(b) OVER w - b) / 2 AS cut, sum(s) OVER w AS s, sum(n) OVER w AS n,
                 sum(s) OVER () AS al, sum(n) OVER () AS an FROM others WINDOW w AS (ORDER BY b)),
scored AS (SELECT *, 2 * s - n + an - al AS same FROM along WHERE cut IS NOT NULL AND n >= 2 AND an - n >= 2),
other AS (SELECT cut AS other_cut, greatest(same, an - same) AS agreeing, same < an - same AS turned, al, an
          FROM scored ORDER BY agreeing DESC, cut LIMIT 1)"""


def gapped(spark, folder):
    """Line items whose quantity is missing in every seventh order; the price goes along with it."""
    return table(spark, folder, "lineitem").select(
        F.when(F.col("l_orderkey") % 7 > 0, F.col("l_quantity")).alias("a"), F.col("l_extendedprice").alias("b"),
        flag((F.col("l_quantity") > 30) != (F.col("l_partkey") % 5 == 0)).alias("e"),
    )


@query(f"""WITH {AGREEING}, placed AS (
  SELECT rows.e AS e, coalesce(a <= cut, CASE WHEN agreeing > greatest(other.al, other.an - other.al) THEN (b <= other_cut) <> turned ELSE 2 * other.al >= other.an END) AS go_left
  FROM rows, best, other)
SELECT CASE WHEN go_left THEN 0 ELSE 1 END::BIGINT AS leaf, CASE WHEN 2 * sum(e) > count(*) THEN 1 ELSE 0 END::INTEGER AS predicted,
  sum(e)::BIGINT AS events, count(*)::BIGINT AS total FROM placed GROUP BY 1, go_left""")
def tree_missing(spark, folder):
    """One split of a number with missing values: those rows go by the best surrogate, and none is lost."""
    return tree.fit_tree(gapped(spark, folder), "e", ["a", "b"], max_depth=1, folds=0).rules.drop("rule", "rate")


@query(f"WITH {AGREEING} SELECT 1::BIGINT AS node, 1::INTEGER AS place, agreeing::BIGINT AS agreeing FROM other WHERE agreeing > greatest(al, an - al)")
def tree_surrogates(spark, folder):
    found = tree.fit_tree(gapped(spark, folder), "e", ["a", "b"], max_depth=1, folds=0)
    return found.surrogates.select("node", "place", "agreeing")
