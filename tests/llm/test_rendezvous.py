import zlib
from collections import Counter

import pytest

from eventrate.llm.rendezvous import shard_documents

FOLDER = "/root/testdata/sf0.001"


def placed(df, weights, grown=(), **options):
    return shard_documents(df, weights, grown, **options).collect()


def slots_are_gapless(rows):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    return all(sorted(s) == list(range(len(s))) for s in by.values())


def test_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = placed(docs, [1.0] * 24, [1.0])
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts) and slots_are_gapless(rows)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)


def test_growth_and_weights(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'t' AS text")
    three = {r.doc_id: r for r in placed(docs, [1.0, 1.0, 2.0], [1.0])}
    four = {r.doc_id: r.shard for r in placed(docs, [1.0, 1.0, 2.0, 1.0])}
    assert all(r.grown_shard == four[d] and four[d] in (r.shard, 3) for d, r in three.items())
    share = Counter(r.shard for r in three.values())
    assert abs(share[2] / 20_000 - 0.5) < 0.02 and abs(share[0] / 20_000 - 0.25) < 0.02
    assert abs(Counter(four.values())[3] / 20_000 - 0.2) < 0.02


def test_many_parts_are_numbered_as_one(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "cast(id AS string) AS text").repartition(5)
    whole, parts = (placed(docs, [1.0] * 4, rows_per_part=n) for n in (10_000, 100))
    assert slots_are_gapless(parts) and len(parts) == 3000
    assert {r.doc_id: r.shard for r in whole} == {r.doc_id: r.shard for r in parts}


def test_edges(spark):
    docs = spark.createDataFrame(
        [(None, "a", 1), (None, None, 1), (5, "", 1), (5, "", 1), (6, None, 1), (7, "é" * 100_000, 1)],
        "doc_id bigint, text string, shard int",
    )
    rows = placed(docs, [1.0, 1.0], [1.0])
    assert len(rows) == 6 and slots_are_gapless(rows)
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows if r.doc_id in (5, 6)} == {(5, 8, 0), (6, 8, 0)}
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    assert next(r.size for r in rows if r.doc_id == 7) == 200_008
    assert placed(docs.limit(0), [1.0]) == []
    assert {r.grown_shard for r in placed(docs, [1.0])} == {None}
    with pytest.raises(ValueError):
        shard_documents(docs, [1.0, 0.0])
