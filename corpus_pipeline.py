"""Corpus pipeline: language, repeated lines, near duplicates, benchmark passages, token ids."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventrate.llm import ecoc, fuzzy_lines, pieces, superminhash, templates
from eventrate.llm.queries import PIECES, table
from eventrate.llm.shipping import ship
from eventrate.llm.tables import without
from eventrate.runtime import LIMITS, materialise, passing_tables, scratch_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language.  Those without a letter, in which no language can be told, go."""
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    told = ecoc.identify(docs.select(others, "text"), ecoc.learn(docs), keep=["row", "text"])
    return told.where(F.col("lang_pred") != ecoc.UNKNOWN).select(
        *["text" if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    )


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go, and so do documents of which nothing is left."""
    done = fuzzy_lines.dedup_lines(docs.select(F.struct("*").alias("row"), "doc_id", "text"))
    counted = F.when(F.col("lines_dropped") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("row.n_chars"))
    new = {"text": F.col("text"), "n_chars": counted}
    return done.where("lines_dropped = 0 or lines_left > 0").select(
        *[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns]
    )


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id: five-word shingles, 80 % Jaccard.

    A document is an id with a text: rows of one id with other texts are documents of their own, and of rows that
    agree in both one stays.
    """
    once = single_rows(docs)
    named = once.select(F.xxhash64("doc_id", "text").alias("node"), F.struct("*").alias("row"))
    with passing_tables() as keep:
        found = materialise(superminhash.near_duplicates(named.select("node", "row.text"), key="node"), "groups")
        several = found.where("not kept").select("component_id").distinct()
        members = materialise(found.join(several, "component_id").select("node", "component_id"), "members")
        few = members.count() <= LIMITS.broadcast_rows
        places = named.select("node", "row.doc_id").join(F.broadcast(members) if few else members, "node")
        first = places.groupBy("component_id").agg(F.min(F.struct("doc_id", "node")).alias("first"))
        gone = members.join(first, "component_id").where("node <> first.node").select("node")
        left = without(named, gone, keep=keep)
    return left.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def single_rows(docs: DataFrame) -> DataFrame:
    """One row, the least, of rows that agree in id and text."""
    marked = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    again = materialise(marked.groupBy("id", "hash").count().where("count > 1").select("id", "hash"), "repeated")
    if again.isEmpty():
        return docs
    few = again.count() <= LIMITS.broadcast_rows
    again = again.select(F.col("id").alias("_id"), F.col("hash").alias("_hash"))
    same = F.col("id").eqNullSafe(F.col("_id")) & F.col("hash").eqNullSafe(F.col("_hash"))
    known = F.broadcast(again) if few else again
    repeated = marked.join(known, same, "left_semi").groupBy("id", "hash").agg(F.min("row").alias("row"))
    return marked.join(known, same, "left_anti").select("row.*").unionByName(repeated.select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark, as it is or with other parameters, go."""
    marked = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    with passing_tables() as keep:
        found = templates.contaminated(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"), forms=templates.FORMS)
        left = without(marked, found.select(F.col("doc").alias("id"), F.col("body").alias("hash")), keep=keep)
    return left.select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return pieces.encode_documents(docs, public_tokenizers.path(PIECES))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: SimHash, SuperMinHash, classifiers and segmentation have no SQL; tests compare with plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again by the next."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
