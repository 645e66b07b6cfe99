import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from eventrate.llm import token_files
from eventrate.llm.word_ids import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Hello, WORLD! it's 12 o'clock -- don't", "", " ", "a<|endoftext|>b <|startoftext|>", "é́ ÀÉ ß µ ª ²½", "J̌ ǰ Σας ΟΔΟΣ",
    "日本語 テスト 🎉🎉 x", "a\x85b\xa0c\x1cd e", "''s 'll ...' 's'S", "x" * 3000, "İstanbul ǅ ﬁ", "\x00\x01 a",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def words():
    return WordEncoder(PATH, cached=50)


def same(words, library, texts):
    ids, counts = words.encode([t.encode() for t in texts])
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_words_are_encoded_as_whole_texts(words, library):
    for _ in range(3):  # with an empty, a full and a cleared cache
        same(words, library, TEXTS)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_any_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    same(_words(), _library(), texts)


_held: dict = {}


def _words():
    return _held.setdefault("words", WordEncoder(PATH))


def _library():
    return _held.setdefault("library", Tokenizer.from_file(PATH))


@given(st.lists(st.integers(0, 2**32 - 1)))
def test_code(ranks):
    control, data = token_files.pack(np.array(ranks, np.uint32))
    assert len(control) == -(-len(ranks) // 4)
    assert token_files.unpack(control, data, len(ranks)).tolist() == ranks


def test_frequent_ids_are_short(spark, tmp_path):
    df = spark.createDataFrame([(i, "the " * 50) for i in range(50)] + [(99, "rare words here")], "doc_id bigint, text string")
    assert token_files.write_files(df, str(tmp_path / "out"), PATH, 2)
    (file,) = (tmp_path / "out").glob("*.ranks")
    content = file.read_bytes()
    id_of_rank = np.frombuffer(content, "<u4", 3, len(token_files.MAGIC) + 8)
    assert id_of_rank[0] == Tokenizer.from_file(PATH).encode("the", add_special_tokens=False).ids[0]
    assert id_of_rank[1] == 2


@pytest.mark.parametrize("file_ids", [10, 1 << 24])
def test_round_trip(spark, library, file_ids):
    docs = [(7 * i % 13 - 3, t) for i, t in enumerate(TEXTS)] + [(50, None), (51, "twice"), (51, "twice"), (None, "none")]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id bigint, text string, start int, n int").repartition(4)
    got = token_files.round_trip(df, PATH, 2, file_ids=file_ids).orderBy("start").collect()
    want, start = [], 0
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert token_files.round_trip(df, PATH, 2).collect() == []


def test_odd_words_among_plain_ones():
    """Words that the pattern alone cannot place are told in one look over all new words, whatever stands beside them."""
    import public_tokenizers

    from eventrate.llm.word_ids import WordEncoder

    path = public_tokenizers.path("word_bpe_49k.json")
    own = WordEncoder(path, cached=20)
    texts = ["plain <|x|> café ’tis < |pipe a\u0085b c d Straße İx", "", "x<| y", "—", "again plain — ’tis x<|", "< | <| don't 12,5 A-Z"]
    for part in (texts, texts[::-1], [t + " new" for t in texts]):
        ids, counts = own.encode([t.encode() for t in part])
        want = [own.library.encode(t, add_special_tokens=False).ids for t in part]
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
