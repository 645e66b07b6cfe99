"""Compare catalogue queries with their SQL: python tests/check_catalogue.py [folder] [name ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v) if v is None or isinstance(v, (bool, int)) else str(v)


def differences(df, con, sql, keep=5):
    """Kinds of differences between a Spark result and SQL, as text; empty if equal."""
    rel = con.sql(sql)
    names, types = rel.columns, [str(t) for t in rel.types]
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} <> {sorted(names)}"]
    out = []
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    sql_types = dict(zip(names, types))
    for c, t in df.dtypes:
        if kinds.get(t, t) != sql_types[c]:
            out.append(f"type of {c}: {t} <> {sql_types[c]}")
    order = sorted(names)
    a = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    at = [names.index(c) for c in order]
    b = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    if len(a) != len(b):
        out.append(f"rows {len(a)} <> {len(b)}")
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        out.append(f"{len(wrong)} rows differ, first: {order} {wrong[:keep]}")
    return out


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = entry.queries()[name](spark, folder)
            sql = entry.oracle_sql().get(name)
            found = differences(df, con, sql) if sql else [] if df.count() else ["no rows"]
        except Exception as error:  # noqa: BLE001
            found, sql = [f"{type(error).__name__}: {str(error)[:900]}"], "?"
        bad += bool(found)
        print(f"{name:28s} {time.time() - start:6.2f}s {'FAIL' if found else 'ok' if sql else 'ok (rows)'}", flush=True)
        for f in found:
            print("    ", f)
    print(f"{len(names) - bad} of {len(names)} agree")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main())
