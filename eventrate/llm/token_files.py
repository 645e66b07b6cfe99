"""Token ids of whole documents in binary files: frequency ranks in a byte-aligned code.

A file starts with ``MAGIC``, the size of the vocabulary and the id of every rank; the more frequent
an id is in the whole corpus, the lower its rank.  Blocks of whole documents follow: counts, document ids
with NULL flags, lengths, control bytes and data bytes.  A rank takes 1 to 4 data bytes, least
significant first, and two bits of a control byte that hold that number less 1, so that a block is
decoded by looking control bytes up in a table of 256 rows.  All numbers are little-endian.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventrate.llm.files import new_file, qualified
from eventrate.llm.flat import slices, starts_of
from eventrate.llm.word_ids import encoder
from eventrate.runtime import discard, materialise, scratch_path

MAGIC = b"RANKVB1\n"
SUFFIX = ".ranks"
BLOCK_IDS = 1 << 18
FILE_IDS = 1 << 24
BATCH_BYTES = 1 << 21
BYTES_OF_CONTROL = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


# --- the code --------------------------------------------------------------------------


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of ranks."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    size = 1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF).astype(np.uint8)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = size - 1
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    used = np.arange(4) < size[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    size = BYTES_OF_CONTROL[np.frombuffer(control, np.uint8)].ravel()[:count]
    out = np.zeros((count, 4), np.uint8)
    out[np.arange(4) < size[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").ravel()


def pack_block(doc_ids: list[int | None], lengths: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = pack(ranks)
    return b"".join([
        struct.pack("<4Q", len(doc_ids), len(ranks), len(control), len(data)),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        lengths.astype("<u8").tobytes(), control, data,
    ])


def read_blocks(content: bytes) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """Document ids, lengths and token ids of each block of a file."""
    if content[: len(MAGIC)] != MAGIC:
        raise ValueError("not a file of ranks")
    (size,) = struct.unpack_from("<Q", content, len(MAGIC))
    at = len(MAGIC) + 8
    id_of_rank = np.frombuffer(content, "<u4", size, at)
    at += 4 * size
    while at < len(content):
        docs, ids, control, data = struct.unpack_from("<4Q", content, at)
        at += 32
        doc_ids = np.frombuffer(content, "<i8", docs, at).tolist()
        null = np.frombuffer(content, np.uint8, docs, at + 8 * docs)
        lengths = np.frombuffer(content, "<u8", docs, at + 9 * docs).astype(np.int64)
        at += 17 * docs
        ranks = unpack(content[at:at + control], content[at + control:at + control + data], ids)
        at += control + data
        yield [None if n else d for d, n in zip(doc_ids, null)], lengths, id_of_rank[ranks]


# --- Spark jobs ------------------------------------------------------------------------


def encode_documents(docs: DataFrame, vocabulary: str, end_id: int, key: str, text: str) -> DataFrame:
    """Compressed ids of every document, and for each task a row with the ``counts`` of all ids in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        words, squeeze = encoder(vocabulary), zstandard.ZstdCompressor(level=1)
        size = max(words.size, end_id + 1)
        kind = "<u2" if size <= 1 << 16 else "<u4"
        total = np.zeros(size, np.int64)
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for a, b in slices([len(t) for t in texts], BATCH_BYTES):
                ids, counts = words.encode(texts[a:b])
                at = starts_of(counts)
                total += np.bincount(ids, minlength=size)
                total[end_id] += b - a
                # All ids at once, an end id behind those of each document.
                ended = np.full(len(ids) + b - a, end_id, kind)
                ended[np.arange(len(ids)) + np.repeat(np.arange(b - a), counts)] = ids
                ends = at + np.arange(b - a + 1)
                packed = [squeeze.compress(ended[ends[i]:ends[i + 1]].tobytes()) for i in range(b - a)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(counts + 1), pa.array(packed, pa.binary()),
                     pa.nulls(b - a, pa.binary())], ["doc", "n", "packed", "counts"],
                )
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
             pa.array([squeeze.compress(total.astype("<i8").tobytes())], pa.binary())], ["doc", "n", "packed", "counts"],
        )

    return docs.select(F.col(key).cast("bigint"), F.col(text)).mapInArrow(run, "doc bigint, n bigint, packed binary, counts binary")


def _ids(packed: pa.Array, kind: str) -> list[np.ndarray]:
    import zstandard

    loose = zstandard.ZstdDecompressor()
    return [np.frombuffer(loose.decompress(p), kind) for p in packed.to_pylist()]


def count_ids(stored: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in all documents, from what the tasks counted; one number per id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for counts in _ids(batch.column(0), "<i8"):
                total += counts
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "times"])

    counted = stored.where("counts is not null").select("counts").mapInArrow(run, "id bigint, times bigint").groupBy("id").agg(F.sum("times"))
    total = np.zeros(size, np.int64)
    for i, times in counted.collect():
        total[i] = times
    return total


def write_files(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int, key: str = "doc_id", text: str = "text",
    file_ids: int = FILE_IDS,
) -> bool:
    """Encode all documents, rank the ids by frequency, write files in ascending key order.

    ``vocabulary`` is the path of a tokenizer file that splits words at white space; special tokens are not
    added, ``end_id`` ends each document.  The table of ranks has one entry per id of the vocabulary.
    Ids are counted while they are encoded.  A task writes one file of about ``file_ids`` ids under a name of its own and moves it into place, so a
    repeated task replaces a file by an equal one.  NULL and empty texts have the end id alone; NULL keys
    come first; rows with one key stand together, ordered by their ids.  An empty table gives no file and False.
    """
    folder = qualified(docs.sparkSession, folder)
    stored = materialise(encode_documents(docs, vocabulary, end_id, key, text), "ids")
    total = stored.agg(F.sum("n")).first()[0] or 0
    if not total:
        return False
    size = max(encoder(vocabulary).size, end_id + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    id_of_rank = np.argsort(-count_ids(stored, size), kind="stable")
    rank_of_id = np.empty(size, np.uint32)
    rank_of_id[id_of_rank] = np.arange(size)
    head = MAGIC + struct.pack("<Q", size) + id_of_rank.astype("<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        rows = 0
        with new_file(folder, f"{place:06d}{SUFFIX}") as out:
            out.write(head)
            for batch in batches:
                doc_ids, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for a, b in slices(counts, BLOCK_IDS):
                    ids = _ids(batch.column(2).slice(a, b - a), kind)
                    out.write(pack_block(doc_ids[a:b], np.array(counts[a:b]), rank_of_id[np.concatenate(ids)]))
                    rows += b - a
        yield pa.RecordBatch.from_arrays([pa.array([place]), pa.array([rows])], ["file", "docs"])

    ordered = (
        stored.where("packed is not null").select("doc", "n", "packed").repartitionByRange(math.ceil(total / file_ids), "doc", F.crc32("packed"))
        .sortWithinPartitions("doc", F.crc32("packed"))
    )
    ordered.mapInArrow(run, "file bigint, docs bigint").agg(F.sum("docs")).first()
    discard(stored)
    return True


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of written files: ``doc``, ``file``, ``place`` in the file, ``n_tokens`` and ``ids``.

    ``ids`` holds 32-bit little-endian numbers; places count the ids before the document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                done = 0
                for doc_ids, lengths, ids in read_blocks(content):
                    at = starts_of(lengths)
                    raw = ids.astype("<u4").tobytes()
                    yield pa.RecordBatch.from_arrays([
                        pa.array(doc_ids, pa.int64()), pa.array([name] * len(doc_ids)), pa.array(done + at[:-1]),
                        pa.array(lengths), pa.array([raw[4 * a:4 * b] for a, b in zip(at, at[1:])], pa.binary()),
                    ], ["doc", "file", "place", "n_tokens", "ids"])
                    done += int(at[-1])

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder)
    return files.select("path", "content").mapInArrow(
        run, "doc bigint, file string, place bigint, n_tokens bigint, ids binary"
    )


def round_trip(
    docs: DataFrame, vocabulary: str, end_id: int, key: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS,
) -> DataFrame:
    """Write all documents and read them back: key, start, n_tokens and a checksum of the ids."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "token-files")
    kind = docs.select(key).dtypes[0][1]
    if not write_files(docs, folder, vocabulary, end_id, key, text, file_ids):
        return spark.createDataFrame([], f"{key} {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
    read = read_files(spark, folder).select("doc", "file", "place", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    read = materialise(read, "read")
    totals = read.groupBy("file").agg(F.sum("n_tokens").alias("_ids"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    starts = totals.select("file", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_start"))
    return read.join(starts, "file").select(
        F.col("doc").cast(kind).alias(key), (F.col("_start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"
    )
