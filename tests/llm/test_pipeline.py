import public_tokenizers
import pytest
from llm import brute
from pyspark.sql import functions as F

import corpus_pipeline
from eventrate.llm.pieces import codec

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder with the shorter documents, odd rows among them, and the whole benchmark."""
    folder = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("n_chars < 2500")
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    item = bench.orderBy(F.desc(F.length("text"))).first().text
    text = docs.orderBy(F.desc("n_chars")).first().text
    odd = [
        (900001, None, None, "s", None), (900002, "", "en", None, 0), (900003, "12 %% 34", "en", "s", 8),
        (900004, f"the thing and that of the other\n{item}", "en", "s", 1), (900005, text, "en", "s", len(text)),
        (900006, text + " and and the last of it", "en", "s", 1),
    ]
    every = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    every.write.parquet(f"{folder}/documents.parquet")
    bench.write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_run_by_plain_python(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    told = {d: t for d, t in rows.items() if t and any(c.isalpha() for c in t)}
    lined = dict(brute.dedup_lines(sorted(told.items())))
    lined = {d: t for d, t in lined.items() if t == told[d] or any(c.isalnum() for c in t)}
    groups = brute.near_duplicates(sorted(lined.items()), 5)
    kept = {d: lined[d] for d, _, g in groups if d == g or not brute.shingles(lined[d], 5)}
    bad = {d for d, _ in brute.contaminated(sorted(kept.items()), items)}
    want = {d: t for d, t in kept.items() if d not in bad}

    got = corpus_pipeline.run(spark, small)
    assert got.columns == [*docs.columns, "n_tokens", "ids", "round_trip"]
    found = got.collect()
    assert {r.doc_id: r.text for r in found} == want and len(found) == len(want)
    assert {900001, 900002, 900003, 900004, 900005} & set(want) == set() and len(bad) > 0
    own = codec(public_tokenizers.path("piece_bpe_32k.model"))
    for r in found:
        assert r.n_chars == len(r.text) and r.round_trip
        assert r["ids"] == own.encode([r.text])[0].tolist()


def test_stages_keep_the_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(40).withColumn("lang_pred", F.lit("own"))
    docs = docs.withColumns({c: F.lit(7) for c in ("body", "items", "lines_left", "node", "kept", "key")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns, name
        assert stage(spark, docs.limit(0), small).collect() == [], name
    assert len(corpus_pipeline.STAGES) == 5


def test_repeated_ids_lose_no_other_text(spark):
    """Rows of one id: a copy goes, another text stays, an exact repeat is one document."""
    one = " ".join(f"a{i} thing" for i in range(60))
    other = " ".join(f"b{i} of it" for i in range(60))
    rows = [(1, one), (2, one), (2, other), (3, other + " end"), (4, "short"), (4, "short"), (None, one), (5, None), (5, None)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    got = sorted(((r.doc_id, r.text) for r in stage(spark, docs, FOLDER).collect()), key=repr)
    # NULL comes before every id, so its copy of the text stays.
    assert got == sorted([(None, one), (2, other), (4, "short"), (5, None)], key=repr)


def test_stages_stand_any_column_names(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(30)
    docs = docs.withColumns({c: F.lit("own") for c in (
        "row", "id", "hash", "node", "_row", "_key", "_hash", "_text", "_lines", "_kept", "_drop", "_dropped", "_left", "_text_hash", "_doc", "_body", "_items",
    )})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, small)
        assert got.columns == docs.columns, name
        assert all(r._text == r._hash == r.node == "own" for r in got.collect()), name
