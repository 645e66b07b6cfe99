"""One query per operator with production parameters, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventrate.llm import (
    ecoc,
    fuzzy_lines,
    mtree,
    phrases,
    pieces,
    rendezvous,
    resampling,
    site_templates,
    superminhash,
    templates,
    token_files,
    turns,
    warc,
)
from eventrate.llm.shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(run)
    def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return run(spark, sf_dir)

    QUERIES[run.__name__] = shipped
    return shipped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SHARDS = 24
END_ID = 2
PIECES = "piece_bpe_32k.model"
CRAWL_DATE = "2024-01-01T00:00:00Z"


@query
def op3_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards of equal weight, and the shard of each document if there were 25."""
    return rendezvous.shard_documents(table(spark, sf_dir, "documents"), [1.0] * SHARDS, grown=[1.0])


ORACLE_SQL["op3_rendezvous"] = rendezvous.sql(SHARDS)


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written to files of frequency ranks and read back."""
    return token_files.round_trip(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID
    )


@query
def op2_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents by 2-word shingles at 80 %."""
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"), superminhash.Settings(words=2))


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and plain-text records of all pages, taken as stored responses."""
    made = warc.derivatives(warc.responses(table(spark, sf_dir, "pages"), CRAWL_DATE))
    return made.select(
        "record_id", "type", "target_uri", "date", F.col("headers")["WARC-Refers-To"].alias("refers_to"),
        F.col("headers")["WARC-Block-Digest"].alias("block_digest"), F.col("headers")["Content-Type"].alias("content_type"),
        F.octet_length("block").alias("content_length"), F.col("block").cast("string").alias("block"),
    )


@query
def op4_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whether they hold a benchmark passage, and which items."""
    judged = templates.judge_documents(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    )
    return judged.select("doc_id", "contaminated", "items")


@query
def op5_ecoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from those not held out."""
    docs = table(spark, sf_dir, "documents").withColumn(
        "held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    )
    model = ecoc.learn(docs.where(~F.col("held_out")).select("text", "lang"))
    return ecoc.identify(docs, model, keep=["doc_id", "held_out"])


@query
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, and whether they decode to the text."""
    return pieces.encode_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), keep=["doc_id"]
    )


@query
def op7_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best vectors by inner product for every vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return mtree.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)


@query
def op8_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that repeat another one."""
    done = fuzzy_lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "text", "lines_dropped", "lines_left")


@query
def op9_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return site_templates.extract(table(spark, sf_dir, "pages"))


@query
def op12_auction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations after damage: their faults, the cheapest repair and its digest."""
    original = table(spark, sf_dir, "conversations")
    found = turns.summarise(turns.repair(turns.damage(original)))
    ids = original.select("conv_id").distinct()
    joined = ids.join(found.withColumnRenamed("conv_id", "own"), F.col("conv_id").eqNullSafe(F.col("own")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return joined.select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


@query
def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighed towards the benchmark, a tenth of those of 20 words drawn."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL["op13_resampling"] = resampling.sql()


@query
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages of 20 words that occurred before."""
    done = phrases.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
