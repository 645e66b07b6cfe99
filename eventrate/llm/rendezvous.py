"""Sharding by rendezvous hashing of record keys over weighted shards.

Every shard draws a score from (key, shard) alone and the lowest score wins, so adding a shard
moves only the records that the new shard wins, and a weight gives a shard its share of the keys.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventrate.runtime import materialise

HEX_DIGITS = 13  # 52 bits of the digest: exact in a double
ROWS_PER_PART = 1_000_000


def score(key: Column, shard: int, weight: float) -> Column:
    """Exponential draw of (key, shard) with rate ``weight``; the lowest draw wins."""
    digest = F.md5(F.concat(key, F.lit(f"#{shard}")))
    drawn = F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("bigint")
    return -F.log((drawn + F.lit(0.5)) / F.lit(float(16**HEX_DIGITS))) / F.lit(float(weight))


def draws(key: Column, weights: Sequence[float]) -> Column:
    """Draw and number of every shard, in order of the numbers."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.array(*[
        F.struct(score(text, i, w).alias("draw"), F.lit(i).alias("shard")) for i, w in enumerate(weights)
    ])


def winner(drawn: Column) -> Column:
    """Number of the winning shard; ties (none in practice) go to the lower number."""
    return F.array_min(drawn)["shard"]


def shard_documents(
    docs: DataFrame, weights: Sequence[float], grown: Sequence[float] = (), key: str = "doc_id", text: str = "text",
    rows_per_part: int = ROWS_PER_PART,
) -> DataFrame:
    """Shard, slot and size of every document, and its shard once there are ``grown`` weights.

    ``weights`` are those of shards 0, 1, ...; ``grown`` continues the list by the shards to be
    added.  ``size`` is the UTF-8 bytes of the text plus 8.  Slots number the rows of a shard from 0
    without gaps: rows are dealt evenly to parts of about ``rows_per_part``, each part is numbered
    on its own by (key, CRC, size) and starts where the part before it ends, so neither a hot key nor
    a large shard meets in one task.

    A NULL text counts as empty, a NULL key as the empty key.  Rows with one key share a shard and have
    slots of their own.  An empty table gives no rows; other columns of the input are not read.
    """
    if not weights or min([*weights, *grown]) <= 0:
        raise ValueError("weights must be positive and not empty")
    body = F.coalesce(F.col(text), F.lit(""))
    drawn = docs.select(F.col(key), F.col(text), draws(F.col(key), [*weights, *grown]).alias("_draws"))
    narrow = drawn.select(
        F.col(key),
        (F.octet_length(body).cast("bigint") + F.lit(8)).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        winner(F.slice("_draws", 1, len(weights))).alias("shard"),
        (winner(F.col("_draws")) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.monotonically_increasing_id().alias("_row"),
    )
    # Stored, because row numbers must not change between the count and the numbering.
    stored = materialise(narrow, "shards")
    parts = max(1, math.ceil(stored.count() / rows_per_part))
    dealt = stored.withColumn("_part", F.pmod(F.col("_row"), F.lit(parts)))
    sizes = dealt.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_part").orderBy(key, "text_crc32", "size")
    numbered = dealt.withColumn("_place", F.row_number().over(inside)).join(starts, ["shard", "_part"])
    return numbered.select(
        key, "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("_start") + F.col("_place") - 1).cast("bigint").alias("slot"), "grown_shard",
    )


def sql(shards: int) -> str:
    """DuckDB SQL of equal weights and one shard more, for tables of one part."""
    draw = f"-ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '#' || i), 1, {HEX_DIGITS}))::BIGINT + 0.5) / {16**HEX_DIGITS}.0)"
    return f"""
WITH crc_table AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)),
                          lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS n))),
drawn AS (
  SELECT doc_id, coalesce(text, '') AS body, list_transform(range({shards + 1}), lambda i: {draw}) AS d FROM documents),
bytes AS (
  SELECT doc_id, body, d, hex(encode(body)) AS h FROM drawn),
summed AS (
  SELECT doc_id, octet_length(encode(body)) + 8 AS size, d,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2),
               lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM bytes, crc_table),
placed AS (
  SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32,
         (list_position(d[1:{shards}], list_min(d[1:{shards}])) - 1)::INTEGER AS shard,
         (list_position(d, list_min(d)) - 1)::INTEGER AS grown_shard
  FROM summed)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, grown_shard
FROM placed"""
