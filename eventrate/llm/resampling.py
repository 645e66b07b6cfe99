"""Importance resampling towards a target: hashed n-gram counts from an Aho-Corasick dictionary of words.

A dictionary (pyahocorasick) holds words between delimiters; each carries the CRC-32 and length of its bytes.  One scan
of a text emits these payloads word by word.  The CRC of a run of words follows from the payloads of its parts
alone, so n-grams are never written out: their CRCs modulo ``buckets`` are the features.  The dictionary of a worker
holds the words that it met first, up to ``DICTIONARY_BYTES``; other words get their payload one by one, so nothing
depends on what it holds.

Words are runs of bytes other than ASCII delimiters, with A-Z lower-cased.  A document without words has no features and
weight 0.  NULL texts count as empty, NULL ids as ``''`` in the draw and as the smallest id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventrate.llm.flat import slices, starts_of
from eventrate.operators import rank
from eventrate.runtime import materialise

DICTIONARY_BYTES = 8 << 20
BATCH_BYTES = 1 << 20
#: Letters and digits stay, A-Z are lower-cased, other ASCII becomes the delimiter; bytes from 0x80 on belong to words.
DELIMITER = 0x20
FORM = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else DELIMITER
    for c in range(256)
)
POLYNOMIAL = 0xEDB88320


@dataclass(frozen=True)
class Settings:
    """Runs of ``lowest`` to ``highest`` words in ``buckets``; ``percent`` of documents of ``least_words`` are drawn."""

    lowest: int = 1
    highest: int = 1
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: int = 2024


# --- CRC-32 of joined strings ----------------------------------------------------------


def _shift_tables() -> np.ndarray:
    """For each power 2**k of zero bytes behind a string, the change of its CRC, byte by byte: tables [k][byte][value]."""

    def apply(columns: list[int], value: int) -> int:
        out = 0
        for bit, column in enumerate(columns):
            if value >> bit & 1:
                out ^= column
        return out

    one_bit = [POLYNOMIAL, *(1 << b for b in range(31))]
    columns = one_bit
    for _ in range(3):  # 1 bit, squared three times: one byte
        columns = [apply(columns, c) for c in columns]
    tables = []
    for _ in range(32):
        tables.append([[apply(columns, v << 8 * byte) for v in range(256)] for byte in range(4)])
        columns = [apply(columns, c) for c in columns]
    return np.array(tables, np.uint32)


_tables: list[np.ndarray] = []


def joined_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings in a row from the CRC of each and the length of the second."""
    if not _tables:
        _tables.append(_shift_tables())
    out = first.copy()
    for k in range(int(length.max(initial=0)).bit_length()):
        some = np.flatnonzero(length >> k & 1)
        part = out[some]
        table = _tables[0][k]
        out[some] = (
            table[0][part & 0xFF] ^ table[1][part >> 8 & 0xFF] ^ table[2][part >> 16 & 0xFF] ^ table[3][part >> 24]
        )
    return out ^ second


# --- the dictionary --------------------------------------------------------------------


class Dictionary:
    """Automaton of delimited words with payloads; learns words until it is full."""

    def __init__(self, most_bytes: int = DICTIONARY_BYTES) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.room = most_bytes
        self.known = 0

    def payloads(self, formed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, CRC and length of every word of a text in formed bytes that starts and ends with a delimiter."""
        raw = np.frombuffer(formed, np.uint8) != DELIMITER
        first = np.flatnonzero(raw[1:] & ~raw[:-1]) + 1
        last = np.flatnonzero(raw[:-1] & ~raw[1:]) + 1  # the delimiter behind each word
        # One character per byte, so that places are those of bytes.
        text = formed.decode("latin-1")
        carried = np.zeros(len(last), np.uint64)
        missing = np.arange(len(last))
        if self.known:
            found = list(self.automaton.iter(text))
            ends = np.fromiter((e for e, _ in found), np.int64, len(found))
            at = np.searchsorted(last, ends)
            carried[at] = np.fromiter((v for _, v in found), np.uint64, len(found))
            unseen = np.ones(len(last), bool)
            unseen[at] = False
            missing = np.flatnonzero(unseen)
        if len(missing):
            words = [formed[a:b] for a, b in zip(first[missing].tolist(), last[missing].tolist())]
            payload = {w: zlib.crc32(w) << 32 | min(len(w), 0xFFFFFFFF) for w in set(words)}
            carried[missing] = [payload[w] for w in words]
            if self.room > 0 and len(missing) * 20 > len(last):
                self._learn(payload)
        return first, (carried >> np.uint64(32)).astype(np.uint32), (carried & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def _learn(self, payload: dict[bytes, int]) -> None:
        for word, carried in sorted(payload.items()):
            if self.room <= 0:
                break
            self.automaton.add_word(f" {word.decode('latin-1')} ", carried)
            self.room -= len(word) + 2
            self.known += 1
        self.automaton.make_automaton()


_dictionaries: list[Dictionary] = []


def features(texts: list[bytes], lowest: int, highest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features, text after text, the features of each text, and its words."""
    if not _dictionaries:
        _dictionaries.append(Dictionary())
    formed = b" ".join([b"", *texts, b""]).translate(FORM)
    first, crc, length = _dictionaries[0].payloads(formed)
    ends = np.cumsum([len(t) + 1 for t in texts])
    words = np.diff(np.searchsorted(first, ends), prepend=0)
    owner = np.repeat(np.arange(len(texts)), words)
    blank = np.full(len(crc), zlib.crc32(b" "), np.uint32)
    runs, owners = [], []
    current = crc  # CRC of the run of n words that starts at each word
    for n in range(1, highest + 1):
        if n > 1:
            if len(current) < 2:
                break
            spaced = joined_crc(current[:-1], blank[: len(current) - 1], np.ones(len(current) - 1, np.int64))
            current = joined_crc(spaced, crc[n - 1:], length[n - 1:])
        if n >= lowest:
            inside = owner[: len(current)] == owner[n - 1:]
            runs.append(current[inside])
            owners.append(owner[: len(current)][inside])
    if not runs:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64), words
    flat, whose = np.concatenate(runs), np.concatenate(owners)
    if len(runs) > 1:
        order = np.argsort(whose, kind="stable")
        flat, whose = flat[order], whose[order]
    return (flat % np.uint32(buckets)).astype(np.int64), np.bincount(whose, minlength=len(texts)), words


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[bytes]]]:
    texts = [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]
    for a, b in slices([len(t) for t in texts], BATCH_BYTES):
        yield a, b, texts[a:b]


# --- Spark jobs ------------------------------------------------------------------------


def bucket_counts(docs: DataFrame, settings: Settings) -> DataFrame:
    """``bucket`` and the features in it, ``n``, over all texts; summed in each task first."""
    low, high, buckets = settings.lowest, settings.highest, settings.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, texts in _texts(batch, 0):
                total += np.bincount(features(texts, low, high, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    counted = docs.select("text").mapInArrow(run, "bucket bigint, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, settings: Settings) -> DataFrame:
    """``bucket`` and ``gain`` in thousandths of a nat, for all buckets."""
    buckets = float(settings.buckets)
    raw, target = materialise(raw, "counts"), materialise(target, "counts")
    every = raw.sparkSession.range(settings.buckets).withColumnRenamed("id", "bucket")
    sides = every.join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(
        target.withColumnRenamed("n", "t"), "bucket", "left"
    ).fillna(0, ["s", "t"])
    totals = sides.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    s, t, all_s, all_t = (F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t"))
    # One row of totals beside at most ``buckets`` rows.
    ratio = (t + 1.0) * (all_s + buckets) / ((s + 1.0) * (all_t + buckets))
    return sides.join(F.broadcast(totals)).select("bucket", F.floor(1000.0 * F.log(ratio)).cast("bigint").alias("gain"))


def weigh(docs: DataFrame, gains: list[int], settings: Settings) -> DataFrame:
    """``doc_id``, ``n_features``, ``n_words`` and ``weight``, the sum of the gains of all features of a document."""
    low, high, buckets = settings.lowest, settings.highest, settings.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = np.array(gains, np.int64)
        for batch in batches:
            for a, b, texts in _texts(batch, 1):
                found, counts, words = features(texts, low, high, buckets)
                sums, at = starts_of(gain[found]), starts_of(counts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(counts), pa.array(words), pa.array(sums[at[1:]] - sums[at[:-1]])],
                    ["doc_id", "n_features", "n_words", "weight"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_features bigint, n_words bigint, weight bigint")


def resample(docs: DataFrame, target: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Every document with its ``weight``, its ``score`` with Gumbel noise, and its ``rank`` if it is drawn.

    ``docs`` has ``doc_id`` and ``text``, ``target`` has ``text``; other columns are left out.  Drawn are the highest
    scores, ties to the smaller id, of documents of ``least_words`` words.  Rows of one id and score are ordered by features.
    """
    scored = materialise(scores(docs, target, settings), "scored")
    eligible = scored.where(F.col("n_words") >= settings.least_words)
    drawn = settings.percent * eligible.count() // 100
    if not drawn:
        return scored.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("bigint").alias("rank"))
    order = eligible.select(
        (-F.col("score")).alias("down"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "doc_id", "n_features", "weight", "score"
    )
    placed = rank.global_rank(order, ["down", "id", "n_features", "weight"], "rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    left_out = scored.where(F.col("n_words") < settings.least_words).withColumn("rank", F.lit(None).cast("bigint"))
    return placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).select(*columns, "rank").unionByName(
        left_out.select(*columns, "rank")
    )


def scores(docs: DataFrame, target: DataFrame, settings: Settings) -> DataFrame:
    """``weigh``'s rows with ``score``: the weight plus Gumbel noise drawn from the id."""
    gains = bucket_gains(bucket_counts(docs, settings), bucket_counts(target, settings), settings)
    # As many numbers as there are buckets, a parameter.
    table = [r.gain for r in gains.orderBy("bucket").collect()]
    key = F.concat(F.lit(f"{settings.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")
    return weigh(docs, table, settings).withColumn("score", F.col("weight") + noise)


def sql(settings: Settings = Settings()) -> str:
    """DuckDB SQL of ``resample`` for runs of one word."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    m = settings.buckets
    return f"""
WITH crc_table AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)),
                          lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS n))),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, {words} AS words FROM documents),
tokens AS (SELECT r, unnest(words) AS w FROM docs),
wanted AS (SELECT unnest({words}) AS w FROM benchmark),
vocabulary AS (SELECT DISTINCT w, hex(encode(w)) AS h FROM (SELECT w FROM tokens UNION ALL SELECT w FROM wanted)),
hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2),
                  lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {m} AS bucket
  FROM vocabulary, crc_table),
own AS (SELECT bucket, count(*) AS n FROM tokens JOIN hashed USING (w) GROUP BY bucket),
sought AS (SELECT bucket, count(*) AS n FROM wanted JOIN hashed USING (w) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(sought.n, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM own) + {m})::DOUBLE
                / ((own.n + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM sought) + {m})::DOUBLE)))::BIGINT AS gain
  FROM own LEFT JOIN sought USING (bucket)),
weights AS (SELECT r, sum(gain)::BIGINT AS weight FROM tokens JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((
           ('0x' || substr(sha256('{settings.seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (r)),
placed AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) AS place, count(*) OVER () AS eligible
  FROM scored WHERE n_features >= {settings.least_words})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {settings.percent} * eligible // 100 THEN place END AS rank FROM placed
UNION ALL
SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_features < {settings.least_words}"""
