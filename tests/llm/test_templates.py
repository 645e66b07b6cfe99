from llm import brute
from pyspark.sql import functions as F

from eventrate.llm import templates
from eventrate.llm.templates import Settings, contaminated, judge_documents

FOLDER = "/root/testdata/sf0.001"
ITEM = (
    "A train leaves Boston at 9 and travels 120 km to Albany. If Maria boards in Boston and pays 15 dollars, "
    "how many km does Maria travel in 3 hours on the way home?"
)
SWAPPED = (
    "A train leaves Denver at 7 and travels 340 km to Austin. If Peter boards in Denver and pays 22 dollars, "
    "how many km does Peter travel in 5 hours on the way home?"
)
MIXED_UP = SWAPPED.replace("does Peter", "does Susan").replace("boards in Denver", "boards in Dallas")


def found(df):
    return {(r.doc, r.item): (round(r.percent, 6), r.verbatim) for r in df.collect()}


def rounded(want):
    return {k: (round(p, 6), v) for k, (p, v) in want.items()}


def test_documents_by_sliding(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    pairs = [(r.doc_id, r.text) for r in docs.where("n_chars < 4000").collect()]
    want = brute.contaminated(pairs, [(r.item_id, r.text) for r in items.collect()])
    assert found(contaminated(docs.where("n_chars < 4000"), items)) == rounded(want) != {}


def test_other_parameters(spark):
    docs = [
        (1, f"before this. {ITEM} and after"), (2, f"Intro,\n{SWAPPED}"), (3, MIXED_UP), (4, ITEM.lower()),
        (5, "A train leaves from nowhere and nothing else is like it in any of these words."),
        (6, ITEM[: len(ITEM) // 2]), (7, ITEM[: len(ITEM) // 4]), (8, f"{ITEM} {SWAPPED}"),
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame([(70, ITEM)], "item_id bigint, text string")
    got = found(contaminated(df, items))
    assert got == rounded(brute.contaminated(docs, [(70, ITEM)]))
    assert got[(1, 70)] == (100.0, True) and got[(2, 70)][1] is False and got[(2, 70)][0] > 90
    assert (3, 70) not in got and (5, 70) not in got and (7, 70) not in got and (8, 70) in got


def test_short_and_odd_items(spark):
    docs = [
        (1, "say alpha beta gamma delta epsilon now"), (2, None), (2, ""), (None, "alpha beta gamma delta epsilon"),
        (3, "alpha beta gamma"), (4, "1 2 3 4 5 6 7 8 9"), (5, "word " * 20_000), (1, "say alpha beta gamma delta epsilon now"),
    ]
    items = [(10, "Alpha beta gamma delta epsilon."), (11, "alpha beta"), (12, None), (13, ""), (14, "1 2 3 4 5 6 7 8 9"),
             (None, "alpha beta gamma delta epsilon")]
    df = spark.createDataFrame([(d, t, "x", True) for d, t in docs], "doc_id bigint, text string, items string, body boolean")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = judge_documents(df, bench)
    assert got.columns == ["doc_id", "text", "body", "contaminated", "items"]
    rows = got.collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.contaminated == (r.text is not None and "alpha beta gamma delta epsilon" in r.text)
        assert [i.item for i in r["items"]] == ([None, 10] if r.contaminated else [])
    assert judge_documents(df.limit(0), bench).collect() == []
    assert not any(r.contaminated for r in judge_documents(df, bench.limit(0)).collect())


def test_joins_alike_without_broadcast(spark):
    from eventrate.runtime import Limits

    docs = spark.createDataFrame([(i, ITEM if i % 3 else "clean text") for i in range(30)], "doc_id bigint, text string")
    items = spark.createDataFrame([(70, ITEM)], "item_id bigint, text string")
    few = Limits(broadcast_rows=0)
    assert judge_documents(docs, items).where("contaminated").count() == 20
    assert judge_documents(docs, items, Settings(), limits=few).where("contaminated").count() == 20


def test_columns_of_any_name(spark):
    names = ("_hash", "_doc", "_items", "_row", "_key", "_body", "body")
    docs = spark.createDataFrame([(1, ITEM), (2, "nothing of the kind")], "doc_id bigint, text string").withColumns({c: F.lit("own") for c in names})
    items = spark.createDataFrame([(7, ITEM)], "item_id bigint, text string")
    got = sorted(templates.judge_documents(docs, items).collect())
    assert [(r.doc_id, r.contaminated) for r in got] == [(1, True), (2, False)]
    assert all(r[c] == "own" for r in got for c in names)


def test_every_window_has_a_pair_that_its_documents_hold(spark):
    """What the first pass looks for is in every text that the join would match."""
    items = spark.createDataFrame([(i, t) for i, t in enumerate([
        ITEM, "Tom has 3 cups and Anna buys 12 kg of the red sand for 5 days", "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15",
        "one two three four five six", "Who Wrote The Famous Novel About Captain Ahab And The White Whale", "a b c d e",
    ])], "item_id bigint, text string")
    windows = templates.item_windows(items, "item_id", "text", templates.Settings(), templates.FORMS)
    rows = windows.collect()
    assert rows and all(r.pairs for r in rows)
    words = items.select("item_id", templates.raw_words(F.col("text")).alias("w")).collect()
    hashed = {
        (r.item_id, k): spark.range(1).select(F.xxhash64(F.lit(r.w[k]), F.lit(r.w[k + 1]))).first()[0]
        for r in words[:2] for k in range(len(r.w) - 1)
    }
    for r in rows:
        if r.item < 2:
            own = {hashed[r.item, r.item_at + k] for k in range(r.width - 1)}
            assert set(r.pairs) <= own
