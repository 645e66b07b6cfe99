"""Catalogue: event rates of category levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventrate.operators import levels, rank
from eventrate.plans.registry import flag, query, sql_rate, sql_unpivot, table
from eventrate.runtime import materialise

PART_COLUMNS = ["p_brand", "p_name", "p_type"]


def returned_by_part(spark, folder):
    """Returned and all line items per part, joined to the part's categories.

    Lines are summed per part first, so a part with very many lines adds one row to the join.
    """
    lines = (
        table(spark, folder, "lineitem").groupBy("l_partkey")
        .agg(F.sum(flag(F.col("l_returnflag") == "R")).alias("returned"), F.count(F.lit(1)).alias("lines"))
    )
    return lines.join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))


RETURNED_ROWS = """
rows AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS e, p_brand, p_name, p_type
         FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def counts_cte(columns, source="rows"):
    return f"""
long AS ({sql_unpivot(source, columns, 'e')}),
counts AS (SELECT var_name, col_num, level, sum(e)::BIGINT AS events, count(*)::BIGINT AS total
           FROM long GROUP BY var_name, col_num, level),
rates AS (SELECT *, {sql_rate('events', 'total')} AS rate,
                 (count(*) OVER (PARTITION BY var_name))::BIGINT AS total_levels
          FROM counts WHERE events > 0)"""


@query(f"WITH {RETURNED_ROWS}, {counts_cte(PART_COLUMNS)} SELECT * FROM rates")
def level_event_rate(spark, folder):
    counts = levels.level_counts(returned_by_part(spark, folder), "returned", PART_COLUMNS, "lines")
    return levels.level_event_rate(None, "returned", PART_COLUMNS, counts=counts)


@query("""
SELECT 'o_orderpriority' AS var_name, 1::BIGINT AS col_num, o_orderpriority AS level,
       count(*) FILTER (o_orderstatus = 'F')::BIGINT AS events, count(*)::BIGINT AS total,
       count(*) FILTER (o_orderstatus = 'F')::DOUBLE / count(*)::DOUBLE AS rate,
       (count(*) OVER ())::BIGINT AS total_levels
FROM orders GROUP BY o_orderpriority HAVING count(*) FILTER (o_orderstatus = 'F') > 0""")
def category_event_rate(spark, folder):
    """Unrounded event rate of a single category."""
    orders = table(spark, folder, "orders").withColumn("e", flag(F.col("o_orderstatus") == "F"))
    return levels.level_event_rate(orders, "e", ["o_orderpriority"], digits=None)


def big_purchases(spark, folder):
    big = (F.col("event_type") == "purchase") & (F.col("value") > 150)
    return table(spark, folder, "events").select("event_id", "user_id", "event_type", flag(big).alias("e"))


BIG_PURCHASE_ROWS = """
rows AS (SELECT event_id, user_id, event_type,
                CASE WHEN event_type = 'purchase' AND value > 150 THEN 1 ELSE 0 END AS e FROM events)"""


@query(f"""WITH {BIG_PURCHASE_ROWS}, {counts_cte(['user_id'])}
SELECT var_name, col_num, level, '0' AS imputed_lvl FROM counts WHERE events = 0""")
def zero_event_levels(spark, folder):
    return levels.zero_event_levels(big_purchases(spark, folder), "e", ["user_id"])


def finished_by_nation(spark, folder):
    """Finished and all orders per customer, with the nation unknown for every tenth customer."""
    per_customer = (
        table(spark, folder, "orders").groupBy("o_custkey")
        .agg(F.sum(flag(F.col("o_orderstatus") == "F")).alias("e"), F.count(F.lit(1)).alias("n"))
    )
    customers = table(spark, folder, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_nationkey")).alias("c_nationkey")
    )
    return per_customer.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "e", "n")


NATION_ROWS = """
rows AS (SELECT CASE WHEN c_custkey % 10 <> 0 THEN c_nationkey END AS c_nationkey,
                CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS e
         FROM orders JOIN customer ON o_custkey = c_custkey)"""

RECEIVER_CTE = """
gaps AS (SELECT a.var_name, a.level, round((n.rate - a.rate) * 1000)::BIGINT AS gap
         FROM rates a JOIN rates n ON a.var_name = n.var_name AND n.level IS NULL WHERE a.level IS NOT NULL),
receivers AS (SELECT var_name, level AS receiver FROM (
    SELECT *, row_number() OVER (PARTITION BY var_name ORDER BY abs(gap), gap < 0, level) AS place FROM gaps)
    WHERE place = 1)"""


@query(f"""WITH {NATION_ROWS}, {counts_cte(['c_nationkey'])}, {RECEIVER_CTE}
SELECT coalesce(c_nationkey, (SELECT receiver::INTEGER FROM receivers)) AS c_nationkey,
       sum(e)::BIGINT AS events, count(*)::BIGINT AS total FROM rows GROUP BY 1""")
def null_level_impute(spark, folder):
    rows = materialise(finished_by_nation(spark, folder), "nations")
    counts = levels.level_counts(rows, "e", ["c_nationkey"], "n")
    done = levels.impute_null_level(rows, levels.level_event_rate(None, "e", ["c_nationkey"], counts=counts))
    return done.data.groupBy("c_nationkey").agg(
        F.sum("e").cast("bigint").alias("events"), F.sum("n").cast("bigint").alias("total")
    )


@query(f"""WITH {NATION_ROWS}, {counts_cte(['c_nationkey'])}
SELECT var_name, col_num, level, events, total, rate, (total_levels - 1)::BIGINT AS total_levels
FROM rates WHERE level IS NOT NULL""")
def null_level_rates(spark, folder):
    """Rates after NULL imputation: the receiving level keeps its counts."""
    rows = materialise(finished_by_nation(spark, folder), "nations")
    counts = levels.level_counts(rows, "e", ["c_nationkey"], "n")
    return levels.impute_null_level(
        rows, levels.level_event_rate(None, "e", ["c_nationkey"], counts=counts)
    ).rates


GROUP_COLUMNS = [*PART_COLUMNS, "l_linestatus"]

GROUP_ROWS = """
rows AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS e, p_brand, p_name, p_type, l_linestatus
         FROM lineitem JOIN part ON l_partkey = p_partkey)"""

CONDENSE_CTE = """
known AS (SELECT * FROM rates WHERE level IS NOT NULL),
tiles AS (SELECT *, ntile(3) OVER (PARTITION BY var_name ORDER BY round(rate * 1000), level) AS tile
          FROM known WHERE total_levels > 3),
decode3 AS (SELECT var_name, col_num, level, CAST(tile AS VARCHAR) AS imputed_lvl FROM tiles),
groups AS (
  SELECT var_name, col_num, CAST(tile AS VARCHAR) AS level, sum(events)::BIGINT AS events,
         sum(total)::BIGINT AS total, sum(events)::DOUBLE / sum(total)::DOUBLE AS rate,
         3::BIGINT AS total_levels, true AS condensed
  FROM tiles GROUP BY var_name, col_num, tile
  UNION ALL
  SELECT var_name, col_num, level, events, total, rate, total_levels, false FROM known WHERE total_levels <= 3)"""

CLUB_CTE = """
placed AS (SELECT *, row_number() OVER (PARTITION BY var_name ORDER BY level) AS place FROM groups),
pairs AS (SELECT *,
    max(rate) FILTER (place = 1) OVER w AS r1, max(rate) FILTER (place = 2) OVER w AS r2,
    max(rate) FILTER (place = 3) OVER w AS r3, max(level) FILTER (place = 1) OVER w AS l1,
    max(level) FILTER (place = 2) OVER w AS l2
  FROM placed WINDOW w AS (PARTITION BY var_name)),
near AS (SELECT *, coalesce((r1 - r2) * (r1 - r2) < 0.0004::DOUBLE, false) AS x,
                coalesce((r2 - r3) * (r2 - r3) < 0.0004::DOUBLE, false) AS y FROM pairs),
moved AS (SELECT *, CASE WHEN place = 2 AND x THEN l1 WHEN place = 3 AND x AND y THEN l1
                         WHEN place = 3 AND NOT x AND y THEN l2 ELSE level END AS into_level FROM near),
final AS (SELECT var_name, col_num, into_level AS level, sum(events)::BIGINT AS events,
                 sum(total)::BIGINT AS total, sum(events)::DOUBLE / sum(total)::DOUBLE AS rate,
                 (count(*) OVER (PARTITION BY var_name))::BIGINT AS total_levels
          FROM moved GROUP BY var_name, col_num, into_level),
decoded AS (
  SELECT d.var_name, d.col_num, d.level, coalesce(m.into_level, d.imputed_lvl) AS imputed_lvl
  FROM decode3 d LEFT JOIN moved m ON m.var_name = d.var_name AND m.condensed AND m.level = d.imputed_lvl
  UNION ALL
  SELECT var_name, col_num, level, into_level FROM moved WHERE NOT condensed AND into_level <> level)"""


def group_rates(spark, folder):
    lines = (
        table(spark, folder, "lineitem").groupBy("l_partkey", "l_linestatus")
        .agg(F.sum(flag(F.col("l_returnflag") == "R")).alias("returned"), F.count(F.lit(1)).alias("lines"))
    )
    rows = lines.join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    counts = materialise(levels.level_counts(rows, "returned", GROUP_COLUMNS, "lines"), "levels")
    return levels.level_event_rate(None, "returned", GROUP_COLUMNS, counts=counts)


@query(f"WITH {GROUP_ROWS}, {counts_cte(GROUP_COLUMNS)}, {CONDENSE_CTE} SELECT * FROM groups")
def condense_levels(spark, folder):
    return levels.condense_levels(group_rates(spark, folder)).groups


@query(f"WITH {GROUP_ROWS}, {counts_cte(GROUP_COLUMNS)}, {CONDENSE_CTE} SELECT * FROM decode3")
def condense_decode(spark, folder):
    return levels.condense_levels(group_rates(spark, folder)).decode


@query(f"WITH {GROUP_ROWS}, {counts_cte(GROUP_COLUMNS)}, {CONDENSE_CTE}, {CLUB_CTE} SELECT * FROM final")
def club_levels(spark, folder):
    return levels.club_levels(*levels.condense_levels(group_rates(spark, folder))).rates


@query(f"WITH {GROUP_ROWS}, {counts_cte(GROUP_COLUMNS)}, {CONDENSE_CTE}, {CLUB_CTE} SELECT * FROM decoded")
def club_decode(spark, folder):
    return levels.club_levels(*levels.condense_levels(group_rates(spark, folder))).decode


@query(f"""WITH {GROUP_ROWS}, {counts_cte(GROUP_COLUMNS)}, {CONDENSE_CTE}
SELECT var_name, level, rate, lag(rate) OVER (PARTITION BY var_name ORDER BY level) - rate AS difference
FROM groups""")
def neighbour_difference(spark, folder):
    groups = levels.condense_levels(group_rates(spark, folder)).groups.select("var_name", "level", "rate")
    return rank.lag_difference(groups, "var_name", "level", "rate")


EVENT_COLUMNS = ["user_id", "event_type"]
REDUCE_SQL = f"""WITH {BIG_PURCHASE_ROWS}, {counts_cte(EVENT_COLUMNS)}, {CONDENSE_CTE}, {CLUB_CTE},
decode AS (SELECT * FROM decoded UNION ALL
           SELECT var_name, col_num, level, '0' FROM counts WHERE events = 0)"""


def reduced(spark, folder):
    return levels.reduce_levels(big_purchases(spark, folder), "e", EVENT_COLUMNS)


@query(f"{REDUCE_SQL} SELECT * FROM decode")
def decode_table(spark, folder):
    return reduced(spark, folder).decode


@query(f"""{REDUCE_SQL}
SELECT coalesce(u.imputed_lvl, CAST(r.user_id AS VARCHAR)) AS user_id,
       coalesce(t.imputed_lvl, r.event_type) AS event_type, sum(e)::BIGINT AS events, count(*)::BIGINT AS total
FROM rows r
LEFT JOIN decode u ON u.var_name = 'user_id' AND u.level IS NOT DISTINCT FROM CAST(r.user_id AS VARCHAR)
LEFT JOIN decode t ON t.var_name = 'event_type' AND t.level IS NOT DISTINCT FROM r.event_type
GROUP BY 1, 2""")
def recode_counts(spark, folder):
    data = reduced(spark, folder).data
    return data.groupBy(*EVENT_COLUMNS).agg(
        F.sum("e").cast("bigint").alias("events"), F.count(F.lit(1)).alias("total")
    )


@query(f"""{REDUCE_SQL}
SELECT r.event_id, coalesce(u.imputed_lvl, CAST(r.user_id AS VARCHAR)) AS user_id FROM rows r
LEFT JOIN decode u ON u.var_name = 'user_id' AND u.level IS NOT DISTINCT FROM CAST(r.user_id AS VARCHAR)""")
def apply_decode(spark, folder):
    """Rows recoded by a decode table that was built beforehand."""
    done = reduced(spark, folder)
    return levels.apply_decode(big_purchases(spark, folder), done.decode, ["user_id"]).select("event_id", "user_id")


# --- set membership of rows by level ---------------------------------------------------


@query("""SELECT event_id, user_id FROM events WHERE user_id IN
  (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 150)""")
def rows_in_event_levels(spark, folder):
    """Semi join: rows whose level has an event somewhere."""
    rows = big_purchases(spark, folder)
    hit = rows.where("e = 1").select(F.col("user_id").alias("level")).distinct()
    return levels.rows_in_levels(rows, "user_id", hit).select("event_id", "user_id")


@query("""SELECT event_id, user_id FROM events WHERE user_id NOT IN
  (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 150)""")
def rows_in_zero_levels(spark, folder):
    """Anti join: rows whose level never has an event."""
    rows = big_purchases(spark, folder)
    hit = rows.where("e = 1").select(F.col("user_id").alias("level")).distinct()
    return levels.rows_in_levels(rows, "user_id", hit, keep=False).select("event_id", "user_id")
