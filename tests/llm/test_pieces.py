import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as pb

from eventrate.llm.flat import text_slices
from eventrate.llm.pieces import codec, decode_documents, encode_documents

PATH = public_tokenizers.path("piece_bpe_32k.model")
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    found = pb.ModelProto()
    with open(PATH, "rb") as f:
        found.ParseFromString(f.read())
    return found


def best(text, model):
    """Segmentation of the whole text of highest score, by trying all pieces at all positions; ties: longest last piece."""
    pieces = {p.piece: (p.score, i) for i, p in enumerate(model.pieces) if p.type == 1}
    spelled = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
    unknown = min(s for s, _ in pieces.values()) - 10
    marked = ("\u2581" + text.replace(" ", "\u2581")) if text else ""
    path = [(0.0, [])] + [(float("-inf"), None)] * len(marked)
    for end in range(1, len(marked) + 1):
        for start in range(max(0, end - 16), end):
            piece = marked[start:end]
            if piece in pieces:
                value, ids = pieces[piece][0], [pieces[piece][1]]
            elif end - start == 1:
                value, ids = unknown, [spelled[b] for b in piece.encode()]
            else:
                continue
            if path[start][0] + value > path[end][0]:
                path[end] = (path[start][0] + value, path[start][1] + ids)
    return path[-1][1]


def lists(texts):
    ids, counts = codec(PATH).encode(texts)
    at = np.concatenate([[0], np.cumsum(counts)])
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])]


def test_documents_by_trying_all_pieces(spark, model):
    texts = [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").where("n_chars < 1500").collect()]
    assert lists(texts) == [best(t, model) for t in texts]


def test_bytes_for_unknown_characters(model):
    texts = ["☃", "a ☃ b", "𒀀x", "\n\n", "a\tb", "", "  ", " a   b ", "日本語のテキスト"]
    assert lists(texts) == [best(t, model) for t in texts]
    # One character without a piece is where the library's segmentation can be compared exactly.
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert lists(["☃", "𒀀"]) == library.encode(["☃", "𒀀"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_round_trip(texts):
    texts = [t.encode("utf-8", "ignore").decode().replace("▁", "") for t in texts]
    own = codec(PATH)
    assert own.decode(*own.encode(texts)) == texts


def test_table(spark):
    rows = [(1, None), (2, ""), (3, " a  b "), (3, " a  b "), (None, "x"), (5, "y▁z"), (6, "word" * 20_000), (7, "a " * 20_000)]
    df = spark.createDataFrame([(d, t, "old") for d, t in rows], "doc_id bigint, text string, ids string")
    got = encode_documents(df, PATH)
    assert got.columns == ["doc_id", "text", "n_tokens", "ids", "round_trip"]
    found = got.collect()
    assert [(r.doc_id, r.text) for r in found] == rows
    assert [r.round_trip for r in found] == [d != 5 for d, _ in rows]
    assert all(r.n_tokens == len(r.ids) for r in found) and [r.n_tokens for r in found[:2]] == [0, 0]
    back = {r.doc_id: r.text for r in decode_documents(got.drop("text"), PATH).collect()}
    assert back[3] == " a  b " and back[6] == "word" * 20_000 and back[5] == "y z"
    assert encode_documents(df.limit(0), PATH).collect() == []


def test_texts_are_sent_once_and_decoded_slice_by_slice(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    plan = encode_documents(df, PATH)._jdf.queryExecution().analyzed().toString()
    assert "_read" not in plan
    assert "_read" in encode_documents(df, PATH, keep=["doc_id"])._jdf.queryExecution().analyzed().toString()
    texts = ["ab" * 5000, None, "", "é" * 5000] * 500
    column = pa.array(texts)
    tracemalloc.start()
    found = []
    for a, b, part in text_slices(column, 100_000):
        found += [(t is None, hash(t or "")) for t in texts[a:b]]
        assert part == [t or "" for t in texts[a:b]]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == len(texts) and peak < 2_000_000 < column.nbytes
