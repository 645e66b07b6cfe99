"""The registered queries: present, over whole tables, and equal to their SQL where there is some."""

import importlib

import __spark_entry__ as entry
from check_catalogue import connect, differences

from eventrate.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
ROWS = {"op1": 2, "op2": 1, "op3": 1, "op4": 1, "op5": 1, "op6": 1, "op8": 1, "op9": 1, "op10": 1}


def test_names():
    numbers = {name.split("_")[0] for name in QUERIES}
    assert numbers == {f"op{n}" for n in range(1, 11)}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())


def test_cheap_queries_return_whole_tables(spark):
    for name in ("op1_warc", "op3_rendezvous", "op5_ecoc", "op6_sentencepiece", "op9_site_templates", "op10_token_files"):
        table = "pages" if name.split("_")[0] in ("op1", "op9") else "documents"
        rows = spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
        assert QUERIES[name](spark, FOLDER).count() == rows * ROWS[name.split("_")[0]]


def test_sql(spark):
    con = connect(FOLDER)
    for name, sql in ORACLE_SQL.items():
        assert differences(QUERIES[name](spark, FOLDER), con, sql) == []


def test_other_errors_are_not_hidden(monkeypatch):
    assert entry._optional("eventrate.llm.absent") is None
    assert entry._optional("eventrate.llm.queries", "eventrate.llm") is importlib.import_module("eventrate.llm.queries")
