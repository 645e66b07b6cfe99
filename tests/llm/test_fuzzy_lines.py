import random
import re

import pytest
from llm import brute
from pyspark.sql import functions as F

from eventrate.llm import fuzzy_lines
from eventrate.llm.fuzzy_lines import dedup_lines, occurrences
from eventrate.runtime import Limits

FOLDER = "/root/testdata/sf0.001"


def key(row):
    return (row[0] is not None, row[0] or 0, row[1] or "")


def left(df, **options):
    return sorted(((r.doc_id, r.text) for r in dedup_lines(df, **options).collect()), key=key)


def test_simhash(spark):
    texts = ["one two three four five six", "a a a a b b c", "Über straße 12 x y z", "word " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc: r.simhash for r in occurrences(df, "doc_id", "text").collect()}
    assert got == {i: brute.simhash(brute.norm(t)) for i, t in enumerate(texts)}


def test_documents_by_comparing_all_lines(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 120")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert left(docs) == sorted(brute.dedup_lines(rows), key=key)


@pytest.mark.parametrize("limits", [Limits(), Limits(broadcast_rows=0)])
def test_near_lines(spark, limits):
    base = "the quick brown fox jumps over the lazy dog near the old river bank while many people watch it run " * 3
    typo = base.replace("lazy", "lazzy", 1)
    docs = [
        (1, f"{base}\nonly here one two three four"), (2, f"ZERO line of text here\n{typo}"), (3, base.upper()),
        (4, "short\nshort\nother"), (5, "Short!"), (6, None), (7, ""), (8, "***\n***\n\n"), (None, "short"),
        (9, base), (9, base), (10, base + "\r\n" + typo), (11, "x y z w v " * 2000),
    ]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id bigint, text string, line int, lines_left int")
    got = dedup_lines(df, limits=limits)
    assert got.columns == ["doc_id", "text", "line", "lines_dropped", "lines_left"]
    rows = got.collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=key) == sorted(brute.dedup_lines(docs), key=key)
    counts = {r.doc_id: (r.lines_dropped, r.lines_left) for r in rows}
    assert counts[6] == counts[7] == counts[8] == (0, 0) and counts[4] == (2, 1) and counts[5] == (1, 0)


def test_chain_is_one_group(spark):
    words = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(12):
        docs.append((i, " ".join([f"z{j}" for j in range(i)] + words[i:])))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert left(df) == sorted(brute.dedup_lines(docs), key=key)


def test_recall_against_edit_similarity_alone(spark):
    """Lines of 6 to 40 words with up to three letters changed inside words, against all pairs of lines."""
    draw = random.Random(11)
    words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(2, 9))) for _ in range(900)]

    def edited(line, times):
        letters = list(line)
        for _ in range(times):
            at = draw.choice([i for i, c in enumerate(letters) if c != " "])
            letters[at] = draw.choice("abcdefghijklmnopqrstuvwxyz")
        return "".join(letters)

    docs = []
    for n in (6, 8, 10, 16, 24, 40):
        for _ in range(3):
            line = " ".join(draw.choices(words, k=n))
            docs += [line, *(edited(line, t) for t in (1, 1, 2, 3))]
    draw.shuffle(docs)
    docs = list(enumerate(docs))
    got = dict(left(spark.createDataFrame(docs, "doc_id bigint, text string")))
    want = dict(brute.dedup_lines(docs, met=False))
    gone, sought = ({d for d, t in x.items() if not t} for x in (got, want))
    assert gone <= sought and len(gone) >= 0.9 * len(sought) > 50


def test_empty_table(spark):
    assert left(spark.createDataFrame([], "doc_id bigint, text string")) == []


def test_columns_of_any_name(spark):
    names = ("_text", "_hash", "_lines", "_kept", "_drop", "_row", "_key", "_said", "_doc", "_body")
    docs = spark.createDataFrame([(1, "the same line here again\nother"), (2, "the same line here again")], "doc_id bigint, text string")
    got = fuzzy_lines.dedup_lines(docs.withColumns({c: F.lit("own") for c in names})).orderBy("doc_id").collect()
    assert [(r.text, r.lines_dropped) for r in got] == [("the same line here again\nother", 0), ("", 1)]
    assert all(r[c] == "own" for r in got for c in names)


def test_cost_of_lines(spark):
    """Texts are not split at the scan, nor their hash taken, once for each line or word; code is short enough to be compiled."""
    docs = spark.createDataFrame([(1, "a b\nc")], "doc_id bigint, text string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        planned = occurrences(docs, "doc_id", "text")._jdf.queryExecution()
        plan = planned.optimizedPlan().toString()
        code = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(planned, "codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("regexp_replace") == 1 and plan.count("xxhash64(text") == 1
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) < 8000


def test_long_lines_against_edit_distance(spark):
    """Long lines with words put in, taken out and changed, near the limit of 90 %: linked as the edit distance of all says."""
    draw = random.Random(3)
    words = ["".join(draw.choices("abcdefghij", k=draw.randint(2, 9))) for _ in range(300)]
    lines = []
    for rate in (0.01, 0.04, 0.07, 0.09, 0.11, 0.14) * 4:
        one = draw.choices(words, k=draw.randint(5, 200))
        two = []
        for w in one:
            kind = draw.random() / rate
            two += [w] if kind > 1 else [] if kind < 0.3 else [w, draw.choice(words)] if kind < 0.6 else [draw.choice(words)]
        lines.append((" ".join(one), " ".join(two) or "x"))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(t for pair in lines for t in pair)], "doc_id bigint, text string")
    found = occurrences(docs, "doc_id", "text")
    classes = found.groupBy("node").agg(F.min(F.struct("doc", "body", "line")).alias("first"))
    node = {r.doc: r.node for r in found.collect()}
    pairs = spark.createDataFrame([(node[2 * i], node[2 * i + 1]) for i in range(len(lines))], "a bigint, b bigint")
    got = fuzzy_lines.confirm(pairs, classes, docs, fuzzy_lines.Settings(), "doc_id", "text", Limits())
    linked = {(r.a, r.b) for r in got.collect()}
    want = {
        (node[2 * i], node[2 * i + 1]) for i, (one, two) in enumerate(lines)
        if brute.edit_distance(one, two) <= max(len(one), len(two)) * 10 // 100
    }
    assert linked == want and 3 < len(want) < len(lines) - 3


def test_lines_with_a_common_passage(spark, monkeypatch):
    """Lines that share all but their heads meet in one large bucket: texts are read once for all rounds."""
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefghijklmnop", k=draw.randint(3, 9))) for _ in range(400)]
    passage = " ".join(draw.choices(words, k=27))
    heads = [" ".join(draw.choices(words, k=9)) for _ in range(12)]
    docs = list(enumerate(f"{h} {passage}" for h in [*heads, heads[10] + "x", heads[7].replace("a", "q", 1)]))
    labels, store = [], fuzzy_lines.materialise
    monkeypatch.setattr(fuzzy_lines, "materialise", lambda df, label: labels.append(label) or store(df, label))
    got = left(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert got == sorted(brute.dedup_lines(docs), key=key) and [d for d, t in got if not t] == [12, 13]
    assert labels.count("forms") == 1
