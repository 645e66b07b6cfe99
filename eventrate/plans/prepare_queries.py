"""Catalogue: cleaning, profiling, screening, features and record files."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventrate.operators import clean, features, profile
from eventrate.plans.registry import flag, query, rounded, sql_rate, sql_round, table
from eventrate.runtime import scratch_path
from eventrate.sources import records, reports

# --- profiling -------------------------------------------------------------------------


def labelled(spark, folder, texts=True):
    """Documents with their labels where there are any; without ``texts``, digests of these take part in the join."""
    docs = table(spark, folder, "documents")
    docs = docs if texts else profile.digest_texts(docs, ["text"])
    return docs.join(table(spark, folder, "labels"), "doc_id", "left")


LABELLED = "FROM documents LEFT JOIN labels USING (doc_id)"
LABELLED_TYPES = {
    "doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint",
    "quality": "int", "toxic": "int",
}


def _report_sql():
    parts = []
    for c, t in LABELLED_TYPES.items():
        number = t != "string"
        spread = [f"min({c})::DOUBLE", f"max({c})::DOUBLE", sql_round(f"avg({c})", 6)] + [
            sql_round(f"quantile_cont({c}::DOUBLE, {p})", 6) for p in profile.QUANTILES.values()
        ]
        names = ["min", "max", "mean", *profile.QUANTILES]
        numbers = ", ".join(f'{e if number else "NULL::DOUBLE"} AS "{n}"' for e, n in zip(spread, names))
        parts.append(
            f"""SELECT '{c}' AS var_name, '{t}' AS datatype, '{"numeric" if number else "text"}' AS kind,
            count(*)::BIGINT AS records,
            (count(DISTINCT {c}) + CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END)::BIGINT AS "unique",
            count({c})::BIGINT AS available, {sql_rate(f'count({c})', 'count(*)', 2)} AS available_pct,
            (count(*) - count({c}))::BIGINT AS missing,
            {sql_rate(f'(count(*) - count({c}))', 'count(*)', 2)} AS missing_pct, {numbers} {LABELLED}"""
        )
    return " UNION ALL ".join(parts)


@query(_report_sql())
def quality_report(spark, folder):
    return rounded(profile.quality_report(labelled(spark, folder, texts=False), keep=True), 6, "mean", *profile.QUANTILES)


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS var_name, (count(*) - count({c}))::BIGINT AS missing {LABELLED}" for c in LABELLED_TYPES))
def null_counts(spark, folder):
    return profile.null_counts(labelled(spark, folder, texts=False))


QUANTILE_PROBS = [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS var_name, {p}::DOUBLE AS prob, {sql_round(f'quantile_cont({c}::DOUBLE, {p})', 4)} AS value FROM lineitem"
    for c in ("l_quantity", "l_extendedprice", "l_discount") for p in QUANTILE_PROBS))
def quantiles(spark, folder):
    """Exact quantiles of several columns of the largest table."""
    from eventrate.operators.rank import quantile_values

    columns = ["l_quantity", "l_extendedprice", "l_discount"]
    found = quantile_values(table(spark, folder, "lineitem"), columns, QUANTILE_PROBS)
    rows = [(c, p, v) for c in columns for p, v in zip(QUANTILE_PROBS, found[c])]
    return rounded(spark.createDataFrame(rows, "var_name string, prob double, value double"), 4, "value")


def _summary_sql():
    parts = []
    for c in ("o_totalprice", "o_orderkey", "o_custkey"):
        items = {"min": f"min({c})", "q1": f"quantile_cont({c}::DOUBLE, 0.25)", "median": f"quantile_cont({c}::DOUBLE, 0.5)",
                 "mean": f"avg({c})", "q3": f"quantile_cont({c}::DOUBLE, 0.75)", "max": f"max({c})",
                 "missing": f"count(*) - count({c})"}
        parts += [
            f"SELECT '{c}' AS var_name, '{i}' AS item, NULL::VARCHAR AS level, {sql_round(f'({e})::DOUBLE', 4)} AS value FROM orders"
            for i, e in items.items()
        ]
    for c in ("o_orderpriority", "o_orderstatus", "o_orderdate"):
        parts.append(f"""SELECT '{c}', 'level', level, rows::DOUBLE FROM (
          SELECT CASE WHEN place <= 3 THEN v ELSE '(Other)' END AS level, sum(rows) AS rows FROM (
            SELECT v, count(*) AS rows, row_number() OVER (ORDER BY count(*) DESC, v) AS place
            FROM (SELECT CAST({c} AS VARCHAR) AS v FROM orders) GROUP BY v) GROUP BY 1)""")
    return " UNION ALL ".join(parts)


@query(_summary_sql())
def summarise(spark, folder):
    """All columns of a table, dates among them."""
    return rounded(profile.summarise(table(spark, folder, "orders"), top=3), 4, "value")


@query("SELECT o_orderpriority, count(*)::BIGINT AS rows FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1")
def freq(spark, folder):
    return profile.freq(table(spark, folder, "orders"), "o_orderpriority")


@query("""SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END::INTEGER AS event, count(*)::BIGINT AS rows,
  count(*)::DOUBLE / (SELECT count(*) FROM orders)::DOUBLE AS share FROM orders GROUP BY 1""")
def class_share(spark, folder):
    orders = clean.encode_event(table(spark, folder, "orders"), "o_orderstatus", "F", "event")
    return profile.class_share(orders, "event")


@query("""SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F')::BIGINT AS "F",
  count(*) FILTER (l_linestatus = 'O')::BIGINT AS "O" FROM lineitem GROUP BY l_returnflag""")
def crosstab(spark, folder):
    return profile.crosstab(table(spark, folder, "lineitem"), "l_returnflag", "l_linestatus")


@query("SELECT DISTINCT p_name FROM part")
def distinct_levels(spark, folder):
    return profile.distinct_levels(table(spark, folder, "part"), "p_name")


@query("SELECT p_brand, p_name, p_type FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def first_rows(spark, folder):
    part = table(spark, folder, "part")
    return part.orderBy(F.desc("p_retailprice"), "p_partkey").limit(20).select("p_brand", "p_name", "p_type")


CORR_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(
    f"SELECT '{a}' AS var_1, '{b}' AS var_2, "
    + (sql_round(f"corr({a}, {b})", 6) if a != b else "1.0::DOUBLE") + " AS corr FROM lineitem"
    + ("" if a != b else " GROUP BY ()")
    for a in CORR_COLUMNS for b in CORR_COLUMNS))
def corr_matrix(spark, folder):
    return rounded(profile.corr_matrix(table(spark, folder, "lineitem"), CORR_COLUMNS), 6, "corr")


# --- dropping weak columns -------------------------------------------------------------


@query(f"SELECT doc_id, text, lang, source, n_chars {LABELLED}")
def drop_sparse(spark, folder):
    rows = labelled(spark, folder)
    return profile.drop_sparse(rows, profile.missing_shares(rows), 0.26)


@query("SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def drop_high_cardinality(spark, folder):
    customer = table(spark, folder, "customer")
    return profile.drop_high_cardinality(customer, ["c_custkey", "c_name", "c_mktsegment"], 0.3, keep=["c_custkey"])


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def drop_constant(spark, folder):
    orders = clean.add_columns(
        table(spark, folder, "orders").select("o_orderkey", "o_orderstatus"), one=1, nothing=F.lit(None).cast("string")
    )
    return profile.drop_constant(orders, ["o_orderstatus", "one", "nothing"])


def decisions(before, after):
    """What a screening step decided: one row per column of ``before``."""
    rows = [(c, c not in after.columns) for c in before.columns]
    return before.sparkSession.createDataFrame(rows, "var_name string, dropped boolean")


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS var_name, {sql_rate(f'(count(*) - count({c}))', 'count(*)', 2)} > 0.26 AS dropped {LABELLED}"
    for c in LABELLED_TYPES))
def sparse_decisions(spark, folder):
    return decisions(labelled(spark, folder), drop_sparse(spark, folder))


CUSTOMER_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
SCREENED = ["c_name", "c_nationkey", "c_mktsegment"]


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS var_name, "
    + (f"count(DISTINCT {c}) + CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END > 0.3 * count(*)" if c in SCREENED else "count(*) < 0")
    + " AS dropped FROM customer" for c in CUSTOMER_COLUMNS))
def cardinality_decisions(spark, folder):
    customer = table(spark, folder, "customer").select(*CUSTOMER_COLUMNS)
    return decisions(customer, profile.drop_high_cardinality(customer, SCREENED, 0.3))


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS var_name, min(v) IS NOT DISTINCT FROM max(v) AS dropped FROM (SELECT {e} AS v FROM orders)"
    for c, e in (("o_orderstatus", "o_orderstatus"), ("closed", "o_orderstatus IN ('F', 'O', 'P')"), ("late", "CASE WHEN o_totalprice < 0 THEN 1 END"))))
def constant_decisions(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderstatus", F.col("o_orderstatus").isin("F", "O", "P").alias("closed"),
        F.when(F.col("o_totalprice") < 0, 1).alias("late"),
    )
    return decisions(orders, profile.drop_constant(orders, orders.columns))


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part")
def drop_columns(spark, folder):
    return table(spark, folder, "part").drop("p_retailprice")


@query(f"""SELECT * FROM ({' UNION ALL '.join(
    f"SELECT '{c}' AS var_name, (count(*) - count({c}))::BIGINT AS missing {LABELLED}" for c in LABELLED_TYPES)})
  WHERE var_name NOT IN ('text', 'source')""")
def drop_vars(spark, folder):
    """Report left after variables were dropped from table and report."""
    rows = labelled(spark, folder)
    return clean.drop_vars(rows, profile.null_counts(rows), ["text", "source"]).report


@query("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS var_name, {'false' if c == 'text' else 'true'} AS in_table, count(*) > count({c}) AS in_report {LABELLED}"
    for c in LABELLED_TYPES) + ") WHERE in_table OR in_report")
def check_aligned(spark, folder):
    """Variables of a table without its text against a report of the incomplete variables."""
    rows = labelled(spark, folder)
    return clean.alignment(rows.drop("text"), profile.null_counts(rows).where("missing > 0"))


# --- cleaning --------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'P') THEN 'Y' WHEN o_orderstatus = 'O' THEN 'N'
  ELSE o_orderstatus END AS event FROM orders""")
def canonicalise(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    renamed = clean.rename_matching(orders, "status$", "event")
    return clean.canonicalise(renamed, "event", {"F": "Y", "P": "Y", "O": "N"})


@query("SELECT event_id, CASE WHEN event_type NOT IN ('error', 'signup') THEN event_type END AS event_type FROM events")
def null_values(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type")
    return clean.null_values(events, "event_type", ["error", "signup"])


@query("SELECT event_id, CASE WHEN value < 5 THEN NULL ELSE value END AS value FROM events")
def null_where(spark, folder):
    events = table(spark, folder, "events").select("event_id", "value")
    return clean.null_where(events, "value", F.col("value") < 5)


@query("SELECT event_id, value FROM events WHERE value >= 5")
def require_target(spark, folder):
    return clean.require_target(null_where(spark, folder), "value")


@query("""SELECT event_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END::INTEGER AS event, user_id
  FROM events WHERE event_type NOT IN ('error', 'signup')""")
def encode_event(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type", "user_id")
    known = clean.keep_present(clean.null_values(events, "event_type", ["error", "signup"]), ["event_type"])
    return clean.encode_event(known, "event_type", "purchase", "event").drop("event_type")


@query("""SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END::INTEGER AS event, o_orderpriority, o_orderkey,
  o_custkey, o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate FROM orders""")
def order_columns(spark, folder):
    """Target, categories, numbers, and the date behind them."""
    orders = clean.encode_event(table(spark, folder, "orders"), "o_orderstatus", "F", "event")
    ordered = clean.order_columns(orders.drop("o_orderstatus"), "event")
    return clean.to_text(ordered, ["o_orderdate"])


def _kind_sql(column, type_name, source):
    if type_name == "string":
        return f"SELECT '{column}' AS var_name, 'categorical' AS kind {source} GROUP BY ()"
    if type_name not in ("int", "bigint"):
        return f"SELECT '{column}' AS var_name, '{'numeric' if type_name == 'double' else 'other'}' AS kind {source} GROUP BY ()"
    levels = f"count(DISTINCT {column}) + CASE WHEN count(*) > count({column}) THEN 1 ELSE 0 END"
    return f"SELECT '{column}' AS var_name, CASE WHEN {levels} < 20 THEN 'categorical' ELSE 'numeric' END AS kind {source}"


def _kinds(spark, found):
    rows = [(c, kind) for kind, columns in found._asdict().items() for c in columns]
    return spark.createDataFrame(rows, "var_name string, kind string")


@query(" UNION ALL ".join(_kind_sql(c, t, LABELLED) for c, t in LABELLED_TYPES.items()))
def split_variables(spark, folder):
    return _kinds(spark, clean.split_variables(labelled(spark, folder)))


ORDER_TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
               "o_orderdate": "timestamp", "o_orderpriority": "string"}


@query(" UNION ALL ".join(_kind_sql(c, t, "FROM orders") for c, t in ORDER_TYPES.items()))
def split_order_variables(spark, folder):
    """Variables of a table with a date, which is neither category nor number."""
    return _kinds(spark, clean.split_variables(table(spark, folder, "orders")))


@query("""SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, TRY_CAST(left(o_orderpriority, 1) AS DOUBLE) AS rank,
  TRY_CAST(o_orderstatus AS DOUBLE) AS status, 'orders' AS origin FROM orders""")
def casts(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", F.substring("o_orderpriority", 1, 1).alias("rank"), F.col("o_orderstatus").alias("status")
    )
    return clean.add_columns(clean.to_number(clean.to_text(orders, ["o_custkey"]), ["rank", "status"]), origin="orders")


# --- features --------------------------------------------------------------------------


@query(f"""SELECT p_partkey, CASE WHEN p_size <> 10 THEN {sql_round('(p_retailprice / (p_size - 10)::DOUBLE)', 2)}
  ELSE 0::DOUBLE END AS zero_ratio,
  CASE WHEN p_size <> 10 THEN {sql_round('(p_retailprice / (p_size - 10)::DOUBLE)', 2)} END AS null_ratio FROM part""")
def safe_ratio(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_retailprice", (F.col("p_size") - 10).alias("size"))
    zero = features.safe_ratio(part, "p_retailprice", "size", 0.0, name="zero_ratio")
    return features.safe_ratio(zero, "p_retailprice", "size", name="null_ratio").select(
        "p_partkey", "zero_ratio", "null_ratio"
    )


@query("""SELECT band, count(*)::BIGINT AS rows FROM (SELECT CASE WHEN l_quantity <= 4 THEN 'Low' WHEN l_quantity <= 22
  THEN 'Med' WHEN l_quantity <= 45 THEN 'High' ELSE 'V_High' END AS band FROM lineitem) GROUP BY band""")
def threshold_label(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_quantity")
    banded = features.threshold_label(lines, "l_quantity", [4, 22, 45], ["Low", "Med", "High", "V_High"], "band")
    return profile.freq(banded, "band")


@query("""SELECT size_band, count(*)::BIGINT AS rows FROM (SELECT CASE WHEN p_size > 0 AND p_size <= 10 THEN 1
  WHEN p_size > 10 AND p_size <= 25 THEN 2 WHEN p_size > 25 AND p_size <= 40 THEN 3 END::INTEGER AS size_band FROM part)
  GROUP BY size_band""")
def interval_cut(spark, folder):
    part = table(spark, folder, "part").select("p_size")
    cut = features.interval_cut(part, "p_size", [0, 10, 25, 40], [1, 2, 3], "size_band")
    return cut.groupBy("size_band").agg(F.count(F.lit(1)).alias("rows"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END::INTEGER AS urgent,
  CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END::INTEGER AS high FROM orders""")
def dummies(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return features.dummies(orders, "o_orderpriority", {"1-URGENT": "urgent", "2-HIGH": "high"})


@query("""SELECT kind, count(*)::BIGINT AS rows, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS events
  FROM (SELECT l_returnflag, CASE WHEN l_quantity <= 25 AND l_linestatus = 'O' THEN 'low open'
    WHEN l_quantity <= 25 AND l_linestatus = 'F' THEN 'low filled' ELSE 'high' END AS kind FROM lineitem) GROUP BY kind""")
def interaction(spark, folder):
    lines = table(spark, folder, "lineitem")
    low, status = F.col("l_quantity") <= 25, F.col("l_linestatus")
    kinds = features.interaction(lines, [(low & (status == "O"), "low open"), (low & (status == "F"), "low filled")],
                                 "high", "kind")
    return kinds.groupBy("kind").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(flag(F.col("l_returnflag") == "R")).alias("events")
    )


# --- files -----------------------------------------------------------------------------


@query("SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS c_mktsegment, c_nationkey FROM customer")
def csv_round_trip(spark, folder):
    """Customers written with a null token, read back with types found from the texts."""
    path = scratch_path(spark, "customers")
    out = table(spark, folder, "customer").select(
        "c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "UNKNOWN").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
        "c_nationkey",
    )
    reports.write_report(out, path)
    return records.read_records(spark, path, infer=True, types={"c_custkey": "bigint"})


@query("""SELECT row_number() OVER (ORDER BY n DESC, p_brand)::BIGINT AS position, p_brand AS Brand_name, n AS No__of_parts
  FROM (SELECT p_brand, count(*)::BIGINT AS n FROM part GROUP BY p_brand)""")
def report_round_trip(spark, folder):
    """A report written with an index column and awkward headers, read back with clean names."""
    path = scratch_path(spark, "report")
    brands = profile.freq(table(spark, folder, "part"), "p_brand").withColumn("down", -F.col("rows"))
    out = brands.select(F.col("p_brand").alias("Brand name"), F.col("rows").alias("No. of parts"), "down")
    reports.write_report(out, path, index_by=["down", "Brand name"])
    back = records.read_records(spark, path, types={"index": "bigint", "No__of_parts": "bigint"})
    return back.withColumnRenamed("index", "position").drop("down")


@query("SELECT count(*)::BIGINT AS raw_rows, count(*) FILTER (value >= 5)::BIGINT AS kept_rows FROM events")
def raw_copy(spark, folder):
    """The untouched table stays usable next to its cleaned form."""
    raw = table(spark, folder, "events").select("value")
    both = clean.null_where(raw.withColumn("kept", F.col("value")), "kept", F.col("value") < 5)
    return both.agg(F.count("value").alias("raw_rows"), F.count("kept").alias("kept_rows"))
