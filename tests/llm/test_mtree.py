import numpy as np
import pytest

from eventrate.llm.mtree import Settings, top_k

FOLDER = "/root/testdata/sf0.01"
SMALL = Settings(subtree=40, page=8, routing=64, seeds=50, round_queries=30)


def brute(rows, queries, k):
    """By comparing every query with every row."""
    told = [
        (i, np.floor(64.0 * np.array(v, float)).astype(int)) for i, v in rows
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for q, x in told:
        if q in queries:
            scores = sorted((-int(x @ y), i) for i, y in told if i != q and len(y) == len(x))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("settings", [Settings(), SMALL])
def test_embeddings(spark, settings):
    df = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    got = sorted(tuple(r) for r in top_k(df, df.where("vec_id % 20 = 0"), 20, settings).collect())
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert got == brute(rows, {i for i, _ in rows if i % 20 == 0}, 20)


def test_ties_copies_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    same = [1.0, 2.0, 3.0]
    rows = [(i, same) for i in range(100)] + [(100 + i, rng.normal(size=3).tolist()) for i in range(200)]
    rows += [
        (400, None), (401, []), (402, [1.0, None, 2.0]), (403, [1.0, float("nan"), 2.0]), (404, [float("inf"), 0.0, 0.0]),
        (None, same), (405, [0.0, 0.0, 0.0]), (406, [1.0, 2.0]), (407, [3.0, -2.0]), (408, [5.0]),
        (409, [1e9, -1e9, 1e9]),
    ]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<double>, v int, rank int")
    wanted = {0, 20, 40, 120, 140, 400, 405, 406, 407, 408, 409}
    queries = df.where(df.vec_id.isin(*wanted))
    assert sorted(tuple(r) for r in top_k(df, queries, 7, SMALL).collect()) == brute(rows, wanted, 7)
    repeated = top_k(df.unionByName(df), queries.unionByName(queries), 7, SMALL)
    assert sorted(tuple(r) for r in repeated.collect()) == brute(rows, wanted, 7)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert top_k(df, df, 20).collect() == []
    one = spark.createDataFrame([(0, [1.0])], "vec_id bigint, embedding array<float>")
    assert top_k(one, one, 20).collect() == [] and top_k(one, df, 20).collect() == []
