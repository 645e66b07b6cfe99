import numpy as np
import pytest
from llm import brute

from eventrate.llm.superminhash import Settings, alone_upto, near_duplicates, shingle_sets, signatures

FOLDER = "/root/testdata/sf0.001"


def rows(df):
    return sorted((r[0], r[1], r[2]) for r in df.collect())


def test_shingles_follow_the_definition():
    texts = ["", " \t", "One", "a b", "A B\x0ba  b\nc", "é É x", "a\xa0b c", "x" * 50_000, "a b " * 3000]
    for width in (1, 2, 5):
        _, counts = shingle_sets([t.encode() for t in texts], width)
        assert counts.tolist() == [len(brute.shingles(t, width)) for t in texts]


def test_signatures_are_the_sequential_algorithm():
    """The element-by-element form of the algorithm, fed with the same random numbers."""
    from eventrate.llm.flat import U64, mix
    from eventrate.llm.superminhash import GOLDEN

    registers, rng = 16, np.random.default_rng(1)
    counts = np.array([1, 2, 7, 300])
    shingles = rng.integers(0, 1 << 63, counts.sum()).astype(np.uint64)
    got = signatures(shingles, counts, registers)
    at = 0
    for s, n in enumerate(counts):
        best = [np.inf] * registers
        for element in shingles[at:at + n]:
            state, order = np.array([element]), list(range(registers))
            for rank in range(registers):
                state = state + GOLDEN
                drawn = mix(state)
                k = rank + int(mix(drawn)[0] % U64(registers - rank))
                order[rank], order[k] = order[k], order[rank]
                best[order[rank]] = min(best[order[rank]], rank + float((drawn >> U64(11))[0]) * 2.0**-53)
        assert got[s].tolist() == best
        at += n


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 1500).astype(np.uint64)
    one, two = pool[:1000], pool[500:]
    found = signatures(np.concatenate([one, two]), np.array([1000, 1000]), 256)
    assert abs((found[0] == found[1]).mean() - 1 / 3) < 0.12


def test_alone_upto():
    assert alone_upto(80) == 3 and alone_upto(50) == 0


@pytest.mark.parametrize("width", [2, 5])
def test_all_documents_against_all_pairs(spark, width):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = rows(near_duplicates(docs, Settings(words=width)))
    assert got == brute.near_duplicates([(r.doc_id, r.text) for r in docs.collect()], width)


def test_chains_copies_and_neighbours_at_the_limit(spark):
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(40):  # each differs a little from the one before: a chain, not a star
        docs.append((100 + i, " ".join(base[i:i + 40])))
    docs += [(i, "one two three four five") for i in range(10)]  # copies
    docs += [(20, "a b c d e"), (21, "a b c d e f"), (22, "a b c d"), (23, "a b c")]  # 4/5 links, 3/4 and 2/3 do not
    # Many that share most words but not enough: one bucket, no link.
    common = " ".join(f"c{i}" for i in range(30))
    docs += [(200 + i, f"{common} " + " ".join(f"u{i}x{j}" for j in range(8))) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert rows(near_duplicates(df, Settings(words=2))) == brute.near_duplicates(docs, 2)


def test_edges(spark):
    docs = [
        (None, "p q r s t u"), (1, None), (2, ""), (3, " \n"), (4, "p q r s t u"), (4, "p q r s t u"), (5, "P Q r s t u"),
        (6, "p"), (7, "P"), (8, "long " * 20_000),
    ]
    df = spark.createDataFrame([(d, t, 9, "x", 5) for d, t in docs], "doc_id bigint, text string, n int, kept string, node int")
    got = near_duplicates(df, Settings(words=2)).collect()
    assert len(got) == len(docs)
    found = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in got}
    assert found[(None, 5)] == (None, True)
    assert found[(1, 0)] == (1, True) and found[(2, 0)] == (2, True) and found[(3, 0)] == (3, True)
    assert found[(4, 5)] == (4, True) and found[(5, 5)] == (4, False)
    assert found[(6, 1)] == (6, True) and found[(7, 1)] == (6, False) and found[(8, 1)] == (8, True)
    assert near_duplicates(df.limit(0)).collect() == []
