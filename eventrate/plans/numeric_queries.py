"""Catalogue: ranks, tiles, numeric bins, imputation and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventrate.operators import bins, features, rank
from eventrate.plans.registry import flag, query, rounded, sql_rate, sql_round, table

# --- ranks and tiles -------------------------------------------------------------------


@query("SELECT o_orderkey, ntile(10) OVER (ORDER BY o_totalprice, o_orderkey)::BIGINT AS tile FROM orders")
def ntile(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    tiled = rank.ntile(orders, "o_totalprice", 10, "o_orderkey")
    return tiled.select("o_orderkey", F.col("tile").cast("bigint").alias("tile"))


@query("""SELECT event_id, CASE WHEN value IS NOT NULL THEN ntile(4) OVER (PARTITION BY value IS NULL ORDER BY value, event_id)
  END::BIGINT AS tile FROM (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events)""")
def ntile_with_nulls(spark, folder):
    tiled = rank.ntile(gappy_events(spark, folder), "value", 4, "event_id")
    return tiled.select("event_id", F.col("tile").cast("bigint").alias("tile"))


@query("""SELECT tile, count(*)::BIGINT AS rows, min(l_quantity) AS low, max(l_quantity) AS high FROM (
  SELECT l_quantity, ntile(10) OVER (ORDER BY l_quantity)::BIGINT AS tile FROM lineitem) GROUP BY tile""")
def ntile_without_key(spark, folder):
    """Tiles of a table without any unique key, ties split by row position."""
    lines = table(spark, folder, "lineitem").select("l_quantity")
    tiled = rank.ntile(lines, "l_quantity", 10, None)
    return tiled.groupBy(F.col("tile").cast("bigint").alias("tile")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high")
    )


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey)::BIGINT AS position FROM orders")
def global_rank(spark, folder):
    orders = table(spark, folder, "orders").select("o_totalprice", "o_orderkey")
    return rank.global_rank(orders, ["o_totalprice", "o_orderkey"]).select("o_orderkey", "position")


@query("""SELECT p_brand, n, row_number() OVER (ORDER BY p_brand)::BIGINT AS serial FROM (
  SELECT p_brand, count(*)::BIGINT AS n FROM part GROUP BY p_brand)""")
def serial_number(spark, folder):
    report = table(spark, folder, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return rank.global_rank(report, ["p_brand"], "serial")


# --- bins ------------------------------------------------------------------------------


def finished_orders(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", "o_totalprice", flag(F.col("o_orderstatus") == "F").alias("e")
    )


def bins_cte(source, columns, key, tiles, digits=2):
    """Bin table in SQL; ``columns`` maps each column to its type, ``tiles`` to its bins."""
    parts = []
    for i, (c, t) in enumerate(columns.items(), 1):
        j = tiles[c] if isinstance(tiles, dict) else tiles
        parts.append(f"""
SELECT b.bin::BIGINT AS bin, coalesce(f.events, 0)::BIGINT AS events, '{c}' AS var_name, f.total, {sql_rate('f.events', 'f.total', digits)} AS rate,
       {i}::BIGINT AS col_num, '{t}' AS data_type, f.max, f.min, f.mean, {j + 1}::BIGINT AS levels
FROM (SELECT unnest(list_concat(range(1, {j + 1}), [NULL])) AS bin) b LEFT JOIN (
  SELECT bin, sum(e)::BIGINT AS events, count(*)::BIGINT AS total, {sql_round(f'max({c})', digits)} AS max,
         {sql_round(f'min({c})', digits)} AS min, {sql_round(f'avg({c})', digits)} AS mean
  FROM (SELECT {c}, e, CASE WHEN {c} IS NOT NULL
          THEN ntile({j}) OVER (PARTITION BY {c} IS NULL ORDER BY {c}, {key}) END AS bin FROM {source})
  GROUP BY bin) f ON f.bin IS NOT DISTINCT FROM b.bin""")
    return " UNION ALL ".join(parts)


ORDER_ROWS = """rows AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS e FROM orders)"""


@query(f"WITH {ORDER_ROWS} {bins_cte('rows', {'o_totalprice': 'double'}, 'o_orderkey', 10)}")
def bin_event_table(spark, folder):
    return bins.bin_event_table(finished_orders(spark, folder), "e", ["o_totalprice"], key="o_orderkey")


@query(f"""WITH {ORDER_ROWS}, t AS ({bins_cte('rows', {'o_totalprice': 'double'}, 'o_orderkey', 10)})
SELECT bin, rate FROM t WHERE bin IS NOT NULL""")
def rate_series(spark, folder):
    return bins.rate_series(bin_event_table(spark, folder), "o_totalprice")


@query(f"WITH {ORDER_ROWS} {bins_cte('rows', {'o_totalprice': 'double'}, 'o_orderkey', 2, 5)}")
def half_split(spark, folder):
    """Two halves with unrounded rate and range; rounding follows only for the comparison."""
    halves = bins.bin_event_table(
        finished_orders(spark, folder), "e", ["o_totalprice"], bins=2, adaptive=False, key="o_orderkey", digits=None
    )
    return rounded(halves, 5, "rate", "max", "min", "mean")


def gappy_events(spark, folder):
    """Events with the value missing for every seventh one."""
    return table(spark, folder, "events").select(
        "event_id", "user_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
        flag(F.col("event_type") == "purchase").alias("e"),
    )


GAPPY_ROWS = """rows AS (SELECT event_id, user_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value,
  CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS e FROM events)"""
GAPPY_BINS = bins_cte("rows", {"value": "double", "user_id": "bigint"}, "event_id", 10)


@query(f"WITH {GAPPY_ROWS} {GAPPY_BINS}")
def bin_event_table_nulls(spark, folder):
    """Two columns at once, one of them with a NULL bin."""
    return bins.bin_event_table(
        gappy_events(spark, folder), "e", ["value", "user_id"], adaptive=False, key="event_id"
    )


@query(f"""WITH {GAPPY_ROWS}, main AS ({bins_cte('rows', {'value': 'double'}, 'event_id', 10)}),
ratios AS (SELECT event_id, e, CASE WHEN user_id <> 0 THEN {sql_round('(value / user_id::DOUBLE)', 2)} END AS ratio FROM rows),
present AS (SELECT * FROM ratios WHERE ratio IS NOT NULL)
SELECT * FROM main UNION ALL ({bins_cte('present', {'ratio': 'double'}, 'event_id', 4)})""")
def derived_feature_bins(spark, folder):
    """Fixed bins of a derived ratio, appended to the main bin table."""
    rows = gappy_events(spark, folder)
    main = bins.bin_event_table(rows, "e", ["value"], adaptive=False, key="event_id")
    ratios = features.safe_ratio(rows, "value", "user_id", name="ratio")
    kept = ratios.where(F.col("ratio").isNotNull())
    return main.unionByName(bins.bin_event_table(kept, "e", ["ratio"], bins=4, adaptive=False, key="event_id"))


def _adaptive_sql(columns):
    parts = []
    for c, e in columns.items():
        first = " UNION ALL ".join(
            f"SELECT {j} AS j, max(x) AS top FROM (SELECT x, ntile({j}) OVER (ORDER BY x) AS t FROM r) WHERE t = 1"
            for j in range(1, 11)
        )
        parts.append(f"""SELECT '{c}' AS var_name, coalesce((WITH r AS (SELECT {e} AS x FROM lineitem)
          SELECT max(j) FROM ({first}) WHERE floor(abs(top) * 100 + 0.5) <> 0), 1)::BIGINT AS bins""")
    return " UNION ALL ".join(parts)


@query(_adaptive_sql({"discount_over": "greatest(l_discount - 0.03::DOUBLE, 0)", "l_tax": "l_tax", "l_quantity": "l_quantity"}))
def adaptive_bins(spark, folder):
    over = F.greatest(F.col("l_discount") - F.lit(0.03), F.lit(0.0))
    lines = table(spark, folder, "lineitem").select(over.alias("discount_over"), "l_tax", "l_quantity")
    found = bins.choose_bins(lines, lines.columns)
    return spark.createDataFrame(list(found.items()), "var_name string, bins bigint")


# --- imputation and outliers -----------------------------------------------------------

FILL_CTE = f"""{GAPPY_ROWS}, t AS ({bins_cte('rows', {'value': 'double'}, 'event_id', 10)}),
gaps AS (SELECT b.bin, b.mean, round((n.rate - b.rate) * 100)::BIGINT AS gap
         FROM t b, t n WHERE n.bin IS NULL AND b.bin IS NOT NULL AND n.rate IS NOT NULL),
best AS (SELECT min(abs(gap)) AS d FROM gaps),
fill AS (SELECT coalesce((SELECT avg(mean) FROM gaps, best WHERE gap = d),
                         (SELECT mean FROM gaps, best WHERE gap = -d ORDER BY bin LIMIT 1)) AS v)"""


@query(f"WITH {FILL_CTE} SELECT event_id, {sql_round('coalesce(value, (SELECT v FROM fill))', 6)} AS value FROM rows")
def bin_null_impute(spark, folder):
    rows = gappy_events(spark, folder)
    found = bins.bin_event_table(rows, "e", ["value"], adaptive=False, key="event_id")
    return rounded(bins.impute_null_by_bin(rows, found).select("event_id", "value"), 6, "value")


@query(f"""WITH {GAPPY_ROWS} SELECT event_id, {sql_round('coalesce(value, (SELECT quantile_cont(value, 0.5) FROM rows))', 6)}
  AS value FROM rows""")
def median_impute(spark, folder):
    done = bins.impute_median(gappy_events(spark, folder), "value")
    return rounded(done.select("event_id", "value"), 6, "value")


WHISKER_CTE = """
ranked AS (SELECT value AS x, row_number() OVER (ORDER BY value) AS r, count(*) OVER () AS n FROM events),
depth AS (SELECT max(((n + 3) // 2) / 2) AS d, max(n) AS n FROM ranked),
hinges AS (SELECT
    (max(x) FILTER (r = floor(d)) + max(x) FILTER (r = ceil(d))) / 2 AS lo,
    (max(x) FILTER (r = depth.n + 1 - ceil(d)) + max(x) FILTER (r = depth.n + 1 - floor(d))) / 2 AS hi
  FROM ranked, depth),
whisk AS (SELECT max(lo) AS lower_hinge, max(hi) AS upper_hinge, min(x) AS lower_whisker, max(x) AS upper_whisker
  FROM ranked, hinges WHERE x >= lo - 1.5::DOUBLE * (hi - lo) AND x <= hi + 1.5::DOUBLE * (hi - lo))"""


@query(f"WITH {WHISKER_CTE} SELECT 'value' AS var_name, * FROM whisk")
def whiskers(spark, folder):
    return bins.whiskers(table(spark, folder, "events"), ["value"])


@query(f"""WITH {WHISKER_CTE} SELECT event_id, CASE WHEN lower_whisker = upper_whisker THEN value
  ELSE greatest(least(value, upper_whisker), lower_whisker) END AS value FROM events, whisk""")
def winsorise(spark, folder):
    return bins.winsorise(table(spark, folder, "events").select("event_id", "value"), ["value"])
