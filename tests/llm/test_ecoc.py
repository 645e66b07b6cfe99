import numpy as np
import pytest
from pyspark.sql import functions as F

from eventrate.llm.ecoc import Settings, codewords, identify, learn

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("count", [2, 3, 4, 5, 9, 40])
def test_codewords_differ(count):
    code = codewords(count, Settings()).astype(int)
    apart = (code.shape[1] - code @ code.T) // 2
    assert (np.abs(code.sum(0)) < count).all()
    assert apart[~np.eye(count, dtype=bool)].min() >= max(1, code.shape[1] // 4)
    assert len({tuple(c) for c in code.T} | {tuple(-c) for c in code.T}) == 2 * code.shape[1] or count > 5


def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = learn(docs.where(~held))
    got = identify(docs.where(held), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)
    # A wrong bit or two does not matter: the codes correct them.
    flipped = identify(docs.where(held), learn(docs.where(~held), Settings(bucket_bits=10))).collect()
    assert np.mean([r.lang == r.lang_pred for r in flipped]) > 0.97


def test_labels_of_the_rows_themselves_are_not_read(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = learn(docs)
    wrong = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("zz"))
    one = {r.doc_id: r.lang_pred for r in identify(docs, model).collect()}
    assert one == {r.doc_id: r.lang_pred for r in identify(wrong, model).collect()}


def test_edges(spark):
    told = [("en", "the house and the street with the people"), ("de", "das haus und die strasse mit den leuten"),
            (None, "unlabelled"), ("xx", None), ("xx", "12 %"), ("xx", "")]
    learned = spark.createDataFrame(told * 3, "lang string, text string")
    rows = [(1, None), (2, ""), (3, "123 %%% \n"), (4, "the street"), (4, "the street"), (None, "das haus"), (6, "die " * 30_000), (7, "é")]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id bigint, text string, score string")
    got = identify(df, learn(learned))
    assert got.columns == ["doc_id", "text", "lang_pred", "score", "ambiguous"]
    found = [(r.doc_id, r.lang_pred) for r in got.collect()]
    assert found[:7] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "de"), (6, "de")]
    assert found[7][1] in ("en", "de")
    assert identify(df.limit(0), learn(learned)).collect() == []
    nothing = identify(df, learn(learned.limit(0))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    only = identify(df, learn(learned.where("lang = 'en'"))).collect()
    assert {(r.lang_pred, r.score) for r in only} == {("und", 0.0), ("en", 1.0)}


def test_ambiguity(spark):
    # The same words in both languages leave no evidence.
    learned = spark.createDataFrame([("a", "same words"), ("b", "same words")], "lang string, text string")
    df = spark.createDataFrame([(1, "same words")], "doc_id bigint, text string")
    (row,) = identify(df, learn(learned)).collect()
    assert row.ambiguous and row.lang_pred == "a" and abs(row.score - 0.5) < 1e-9
