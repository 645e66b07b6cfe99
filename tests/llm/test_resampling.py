import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from eventrate.llm import resampling

SCHEMA = "doc_id bigint, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def runs(text, low, high):
    own = words(text)
    return [" ".join(own[i:i + n]) for n in range(low, high + 1) for i in range(len(own) - n + 1)]


def by_hand(docs, target, settings):
    def counts(texts):
        return Counter(b for t in texts for b in buckets(t))

    def buckets(text):
        return [zlib.crc32(r.encode()) % settings.buckets for r in runs(text, settings.lowest, settings.highest)]

    own, wanted, m = counts(t for _, t in docs), counts(target), settings.buckets
    total, sought = sum(own.values()), sum(wanted.values())
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * (total + m) / ((own[b] + 1) * (sought + m)))) for b in own}
    out = []
    for doc, text in docs:
        h = int(hashlib.sha256(f"{settings.seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        found = buckets(text)
        weight = sum(gain[b] for b in found)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(found), weight, weight + noise, None, len(words(text))])
    able = [r for r in out if r[5] >= settings.least_words]
    able.sort(key=lambda r: (-r[3], -(1 << 63) if r[0] is None else r[0], r[1], r[2]))
    for place, r in enumerate(able[: settings.percent * len(able) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in out), key=repr)


ROWS = [
    (1, None), (2, ""), (3, "--- ..."), (4, "Tom has 3 apples, TOM has"), (4, "Tom has 3 apples, TOM has"), (None, "é\x85à É 12é tom"),
    (5, "x" * 400_000), (6, "many words " * 5_000), (7, "a-b_c\x00d\x7fe"), (8, "has tom 3"), (-9, "apples " * 21),
] + [(100 + i, " ".join(f"w{j % (i + 2)}" for j in range(i))) for i in range(60)]
TARGET = ["Tom has apples", None, "", "w1 w2 w3 é\x85à"]


@pytest.mark.parametrize("settings", [
    resampling.Settings(), resampling.Settings(highest=3, buckets=97, least_words=3, percent=55),
    resampling.Settings(lowest=2, highest=2, buckets=1000, least_words=0, percent=100, seed=1),
])
def test_against_plain_python(spark, settings):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("x") for c in ("rank", "id", "down", "n_words", "bucket", "score")})
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = resampling.resample(docs.repartition(4), target, settings)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == by_hand(ROWS, TARGET, settings)


def test_empty_tables(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    assert resampling.resample(docs.limit(0), target).collect() == []
    got = resampling.resample(docs, target.limit(0)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == by_hand(ROWS, [], resampling.Settings())


def test_dictionary_changes_nothing():
    texts = [f"{t or ''} tail".encode() for _, t in ROWS]
    formed = b" ".join([b"", *texts, b""]).translate(resampling.FORM)
    small, large = resampling.Dictionary(30), resampling.Dictionary()
    want = [zlib.crc32(w) for w in formed.split()]
    for _ in range(3):
        for one in (small, large):
            first, crc, length = one.payloads(formed)
            assert crc.tolist() == want and length.tolist() == [len(w) for w in formed.split()]
    assert 0 < small.known < large.known
