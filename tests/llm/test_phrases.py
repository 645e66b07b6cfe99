import hashlib
import random

import pytest
from pyspark.sql import functions as F

from eventrate.llm import phrases, queries

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string"


def by_windows(rows, width=20):
    """Every window of every text against every other, in plain Python: (doc_id, words, removed, digest of the kept)."""
    def place(doc, start):
        return (-(1 << 63) if doc is None else doc, start)

    split = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in split:
        for i in range(len(w) - width + 1):
            key = tuple(w[i:i + width])
            first[key] = min(place(d, i), first.get(key, place(d, i)))
    out = []
    for d, w in split:
        gone = bytearray(len(w))
        for i in range(len(w) - width + 1):
            if place(d, i) > first[tuple(w[i:i + width])]:
                gone[i:i + width] = b"\1" * width
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def digests(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()), key=repr)


def test_query_against_all_windows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = by_windows([(r.doc_id, r.text) for r in docs.collect()])
    got = queries.QUERIES["op11_phrases"](spark, FOLDER)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert sum(r[2] for r in want) > 0


def _odd_rows():
    draw = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    line = " ".join(draw.choices(words, k=25))
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, line), (6, f"{line}\n{line}"), (7, line), (7, line)]
    rows += [(8, f"before {line} after"), (None, f"null {line}"), (None, f"null {line}"), (9, "a " * 120), (9, "a " * 50)]
    rows += [(10 + i, " ".join(draw.choices(words[:4], k=draw.randint(15, 60)))) for i in range(60)]
    rows += [(100 + i, f"x{i} {line} y{i}") for i in range(30)]
    rows += [(200, "é\x85à " * 30), (201, "é\x85à\x0b" * 25), (202, "Z" * 300_000 + " " + line), (203, "퟿ b " * 20)]
    return rows


@pytest.mark.parametrize("settings", [
    phrases.Settings(), phrases.Settings(crowd=3), phrases.Settings(width=5, gram=2, crowd=5), phrases.Settings(width=3, gram=3),
])
def test_odd_rows(spark, settings):
    rows = _odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert digests(phrases.remove_repeats(docs, settings)) == by_windows(rows, settings.width)


def test_many_automata_and_shards(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_BYTES", 500)
    rows = _odd_rows()
    # The bound of an automaton is read in the worker; locate() is tried with pieces of its own.
    assert digests(phrases.remove_repeats(spark.createDataFrame(rows, SCHEMA))) == by_windows(rows)


def test_same_without_broadcast(spark):
    from eventrate.runtime import Limits

    rows = _odd_rows()
    got = phrases.remove_repeats(spark.createDataFrame(rows, SCHEMA), limits=Limits(broadcast_rows=0))
    assert digests(got) == by_windows(rows)


def test_ranges_and_text(spark):
    line = " ".join(f"w{i}" for i in range(22))
    docs = spark.createDataFrame([(1, line), (2, f"p q {line} r"), (3, "short")], SCHEMA)
    got = {r.doc_id: r for r in phrases.remove_repeats(docs).collect()}
    assert got[1].removed == [] and got[1].kept == line
    assert [(x.first, x.last) for x in got[2].removed] == [(2, 24)] and got[2].kept == "p q r"
    assert got[3].kept == "short"


def test_clashing_columns_and_empty_table(spark):
    names = ("id", "hash", "starts", "anchor", "words", "shard", "kept", "removed", "n")
    docs = spark.createDataFrame(_odd_rows()[:12], SCHEMA).withColumns({c: F.lit("x") for c in names})
    assert digests(phrases.remove_repeats(docs)) == by_windows(_odd_rows()[:12])
    assert phrases.remove_repeats(docs.limit(0)).collect() == []


def test_locate_confirms_words():
    words = " ".join(f"w{i}" for i in range(4))
    rows = [(words, 5, 2, 1), (f"v {words}", 3, 7, 1), ("a b c d", 9, 0, 2), ("q r s t", 1, 0, 1)]
    assert list(phrases.locate(rows, 4)) == [(0, [0], [3], [8]), (1, [1], [3], [8]), (2, [0], [9], [0])]


def test_equal_windows_have_equal_anchors():
    draw = random.Random(3)
    settings = phrases.Settings(width=6, gram=2)
    texts = [" ".join(draw.choices("abc", k=draw.randint(0, 40))).encode() for _ in range(50)]
    seen, windows = {}, 0
    for text, start, size, anchor in zip(*(x.tolist() for x in phrases.segments(texts, settings))):
        own = texts[text].split()
        for at in range(start, start + size):
            windows += 1
            assert seen.setdefault(tuple(own[at:at + 6]), anchor) == anchor
    assert windows == sum(max(0, len(t.split()) - 5) for t in texts)
