"""Removal of passages that occurred before: recurring phrases are confirmed, compiled into automata and located.

A phrase is a window of ``width`` words.  Every window has an anchor, the run of ``gram`` words in it whose hash is
least, so equal windows have equal anchors; only windows whose anchor occurs twice can recur.  Neighbouring windows
with the same anchor form a segment.  Segments are the documents' stream: equal ones are counted and kept once with
their first place, and the shards are dealt by anchor.  In a shard, phrases met twice are confirmed word by word and
compiled into Aho-Corasick automata (pyahocorasick, one character a word), through which all segments of the shard are
streamed; that locates every occurrence of every phrase, and tells where it was first.

An anchor with more than ``crowd`` occurrences (a phrase that many documents share, in ever other contexts) is not a
shard key: its windows are segments of their own, dealt by their whole text.

Words are what stands between spaces and U+0009 to U+000D, unchanged.  Places are ordered by id, then word; a NULL id is
the smallest (as the least 64-bit number is), and rows of one id count as one document: windows that start at the same
word of both are neither earlier.  NULL texts have no words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventrate.llm.flat import U64, mix, slices, starts_of
from eventrate.llm.superminhash import BASE, BASE_INVERSE, BLANK, GOLDEN, powers
from eventrate.runtime import LIMITS, Limits, discard, materialise

BATCH_BYTES = 1 << 20
SHARD_BYTES = 16 << 20  # segment texts of a task, about
AUTOMATON_WORDS = 400_000  # words of the segments behind one automaton
WORDS_A_LETTER = 5
SIGNS, BETWEEN = 3, "\0\0\0"  # characters of a letter, and what stands between phases
BYTE_HASH = mix(np.arange(256, dtype=np.uint64) + GOLDEN)
ID = "coalesce({}, -9223372036854775808L)"


@dataclass(frozen=True)
class Settings:
    """Phrases of ``width`` words, anchors of ``gram``; ``crowd`` is the most occurrences of a shard key."""

    width: int = 20
    gram: int = 6
    crowd: int = 20_000


# --- windows of texts ------------------------------------------------------------------


def word_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and how many words each has."""
    raw = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    blank = BLANK[raw]
    first = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    last = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_HASH[raw] * powers(BASE, len(raw)), out=sums[1:])
    hashes = mix((sums[last] - sums[first]) * powers(BASE_INVERSE, len(raw))[first])
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(first, ends), prepend=0)


def segments(texts: Sequence[bytes], settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first window, number of windows and anchor of every segment, text after text.

    A segment is a run of windows of one text whose anchor stands at the same place.
    """
    width, gram = settings.width, settings.gram
    hashes, counts = word_hashes(texts)
    if len(hashes) < width:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    grams = np.zeros(len(hashes) - gram + 1, np.uint64)
    for k in range(gram):
        grams = mix(grams * U64(3) + hashes[k:len(grams) + k] + U64(gram))
    inside = width - gram + 1
    least = np.lib.stride_tricks.sliding_window_view(grams, inside).argmin(axis=1)
    at = np.arange(len(least)) + least
    owner = np.repeat(np.arange(len(texts)), counts)
    whole = np.flatnonzero(owner[: len(least)] == owner[width - 1:])
    if not len(whole):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    # Equal places mean one anchor; windows across a border of texts part the segments by themselves.
    cut = np.append(True, (np.diff(at[whole]) != 0) | (np.diff(whole) != 1))
    first = whole[cut]
    size = np.diff(np.append(np.flatnonzero(cut), len(whole)))
    text = owner[first]
    return text, first - starts_of(counts)[text], size, grams[at[first]]


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[bytes]]]:
    texts = [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]
    for a, b in slices([len(t) for t in texts], BATCH_BYTES):
        yield a, b, texts[a:b]


# --- Spark jobs ------------------------------------------------------------------------


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", "text", F.expr(ID.format("cast(doc_id as bigint)")).alias("id"), F.xxhash64("text").alias("hash")
    )


def anchors(docs: DataFrame, settings: Settings) -> DataFrame:
    """``anchor``, ``id``, ``hash`` and ``start`` of every segment of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, texts in _slices(batch, 2):
                text, start, _, anchor = segments(texts, settings)
                row = pa.array(text + a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), batch.column(0).take(row), batch.column(1).take(row), pa.array(start)],
                    ["anchor", "id", "hash", "start"],
                )

    return docs.select("id", "hash", "text").mapInArrow(run, "anchor bigint, id bigint, hash bigint, start bigint")


def _small(df: DataFrame, limits: Limits) -> DataFrame:
    """Marked for broadcast if its rows are few, at 32 bytes each within the limit of bytes."""
    return F.broadcast(df) if df.count() <= min(limits.broadcast_rows, limits.broadcast_bytes // 32) else df


def recurring_segments(docs: DataFrame, settings: Settings, limits: Limits = LIMITS) -> DataFrame:
    """Segments whose anchor recurs, stored: ``shard`` key, ``id``, ``hash``, ``start`` and the ``words`` in a row."""
    seen = materialise(anchors(docs, settings), "anchors")
    twice = materialise(seen.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "recurring")
    hits = seen.join(_small(twice, limits), "anchor").groupBy("id", "hash").agg(
        F.collect_set(F.struct("start", (F.col("n") > settings.crowd).alias("crowded"))).alias("hits")
    )
    # A document's hits are fewer than its words.  Documents without any end here.
    found = docs.join(hits, ["id", "hash"])
    width = settings.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column(0), batch.column(1)
            for a, b, texts in _slices(batch, 2):
                wanted = [{h["start"]: h["crowded"] for h in x} for x in batch.column(3).slice(a, b - a).to_pylist()]
                split = [t.split() for t in texts]
                rows, keys, starts, bodies = [], [], [], []
                for text, start, size, anchor in zip(*(x.tolist() for x in segments(texts, settings))):
                    crowded = wanted[text].get(start)
                    if crowded is None:
                        continue
                    step = 1 if crowded else size
                    for first in range(start, start + size, step):
                        body = b" ".join(split[text][first:first + step + width - 1])
                        own = int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little") if crowded else anchor
                        rows.append(a + text)
                        keys.append(own)
                        starts.append(first)
                        bodies.append(body)
                row = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(keys, np.uint64).view(np.int64)), ids.take(row), hashes.take(row),
                     pa.array(starts, pa.int64()), pa.array(bodies, pa.binary()).cast(pa.string())],
                    ["shard", "id", "hash", "start", "words"],
                )

    cut = found.select("id", "hash", "text", "hits").mapInArrow(
        run, "shard bigint, id bigint, hash bigint, start bigint, words string"
    )
    stored = materialise(cut, "segments")
    discard(seen, twice)
    return stored


# --- automata --------------------------------------------------------------------------


class _Words(dict):
    """A character for each word, surrogates left out."""

    def __missing__(self, word: str) -> str:
        code = len(self) + 1
        self[word] = letter = chr(code if code < 0xD800 else code + 0x800)
        return letter


class _Letters(dict):
    """Three characters for each run of words, from three alphabets.

    A node of the automaton looks for its children one by one, so they must be few, and no match begins inside a letter.
    """

    def __missing__(self, run: str) -> str:
        code = len(self)
        self[run] = letter = chr(0x1000 + (code >> 14)) + chr(0x100 + (code >> 7 & 127)) + chr(0x200 + (code & 127))
        return letter


@lru_cache(10_000)
def _starts(words: int, step: int) -> tuple[int, ...]:
    """First word of the letter at each place of a segment's phases in a row; -1 between phases."""
    return tuple(x for phase in range(step) for x in (*range(phase, words - step + 1, step), -1))[:-1]


def locate(rows: Sequence[tuple[str, int, int, int]], width: int) -> Iterator[tuple[int, list[int], list[int], list[int]]]:
    """Number of the segment, its windows that recur, and where each was first (id, start).

    ``rows`` holds the words, the first id and start, and the number of occurrences of distinct segments.  A letter of the
    automaton stands for ``step`` words in a row, so that a phrase has few; a segment is streamed in ``step`` phases,
    one for each place where a letter may begin.
    """
    import ahocorasick

    step = max(d for d in range(1, min(width, WORDS_A_LETTER) + 1) if width % d == 0)
    letters = width // step * SIGNS
    word, run = _Words(), _Letters()
    texts = []
    for words, _, _, _ in rows:
        text = "".join([word[w] for w in words.split(" ")])
        spelt = [run[text[i:i + step]] for i in range(len(text) - step + 1)]
        texts.append(BETWEEN.join(["".join(spelt[phase::step]) for phase in range(step)]))
    sizes = [words.count(" ") + 1 for words, _, _, _ in rows]
    firsts: dict[str, tuple[int, int]] = {}
    confirmed: set[str] = set()
    for text, size, (_, doc, start, n) in zip(texts, sizes, rows):
        starts = _starts(size, step)
        for place, at in enumerate(starts):
            if at < 0 or at > size - width:
                continue
            phrase, found = text[SIGNS * place:SIGNS * place + letters], (doc, start + at)
            known = firsts.get(phrase)
            if known is None:
                firsts[phrase] = found
                if n > 1:
                    confirmed.add(phrase)
            else:
                confirmed.add(phrase)
                if found < known:
                    firsts[phrase] = found
    if not confirmed:
        return
    automaton = ahocorasick.Automaton()
    for phrase in confirmed:
        automaton.add_word(phrase, firsts[phrase])
    automaton.make_automaton()
    for i, (text, size) in enumerate(zip(texts, sizes)):
        found = list(automaton.iter(text))
        if found:
            starts = _starts(size, step)
            yield i, [starts[(end + 1 - letters) // SIGNS] for end, _ in found], [p[0] for _, p in found], [p[1] for _, p in found]


VERDICT = pa.schema([
    ("words", pa.string()), ("at", pa.list_(pa.int32())), ("first_id", pa.list_(pa.int64())),
    ("first_start", pa.list_(pa.int64())),
])


def located(distinct: DataFrame, settings: Settings) -> DataFrame:
    """Recurring windows of each distinct segment and their first places; the segments of one shard key stand together."""
    width = settings.width

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        found = list(locate([(w, d, s, n) for _, w, d, s, n in rows], width))
        columns = [[rows[i][1] for i, *_ in found], *([f[k] for f in found] for k in (1, 2, 3))]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, VERDICT)], schema=VERDICT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # An automaton takes whole shard keys; a new one is begun when a key ends beyond the bound.
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= AUTOMATON_WORDS and held[-1][0] != row[0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += row[1].count(" ") + 1
        if held:
            yield solve(held)

    rows = distinct.select("shard", "words", "first.id", "first.start", "n")
    return rows.mapInArrow(run, "words string, at array<int>, first_id array<bigint>, first_start array<bigint>")


def repeated_windows(docs: DataFrame, settings: Settings = Settings(), limits: Limits = LIMITS) -> DataFrame:
    """``id``, ``hash`` and sorted ``starts`` of the windows of each document that occurred before, stored."""
    every = recurring_segments(docs, settings, limits)
    distinct = every.groupBy("shard", "words").agg(F.min(F.struct("id", "start")).alias("first"), F.count(F.lit(1)).alias("n"))
    distinct = materialise(distinct, "distinct")
    size = distinct.agg(F.coalesce(F.sum(F.octet_length("words").cast("bigint")), F.lit(0)).alias("b")).first().b
    dealt = distinct.repartition(max(1, -(-size // SHARD_BYTES)), "shard").sortWithinPartitions("shard")
    # The words name a segment; their digest does so in fewer bytes.
    piece = F.unhex(F.md5("words")).alias("piece")
    verdicts = located(dealt, settings).select(piece, "at", "first_id", "first_start")
    earlier = F.filter(
        F.arrays_zip("at", "first_id", "first_start"),
        lambda w: (F.col("id") > w["first_id"]) | (F.col("id") == w["first_id"]) & (F.col("start") + w["at"] > w["first_start"]),
    )
    repeated = every.select("id", "hash", "start", piece).join(verdicts, "piece").select(
        "id", "hash", F.transform(earlier, lambda w: F.col("start") + w["at"]).alias("found")
    ).where(F.size("found") > 0).groupBy("id", "hash").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("starts")
    )
    stored = materialise(repeated, "repeated")
    discard(every, distinct)
    return stored


def remove_repeats(docs: DataFrame, settings: Settings = Settings(), limits: Limits = LIMITS) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, the ``kept`` words joined by spaces, and the word ranges ``removed``.

    Removed is every word in a window whose words also start earlier, in a document of smaller id or before in the same
    one.  Windows are judged on the input.  One row per row of ``docs``; columns besides ``doc_id`` (an integer) and
    ``text``, whatever their names, are left out.  Equal rows get equal results; an empty table gives none.
    """
    keyed = _keyed(docs)
    found = repeated_windows(keyed, settings, limits)
    width = settings.width
    joined = keyed.join(found, ["id", "hash"], "left").select("doc_id", "text", "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in _slices(batch, 1):
                counts, gone, kept, ranges = [], [], [], []
                for text, starts in zip(texts, batch.column(2).slice(a, b - a).to_pylist()):
                    words = text.split()
                    removed = _merged(starts or (), width)
                    left, at = [], 0
                    for first, last in removed:
                        left.extend(words[at:first])
                        at = last
                    left.extend(words[at:])
                    counts.append(len(words))
                    gone.append(len(words) - len(left))
                    kept.append(b" ".join(left))
                    ranges.append([{"first": f, "last": e} for f, e in removed])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()),
                     pa.array(kept, pa.binary()).cast(pa.string()),
                     pa.array(ranges, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))],
                    ["doc_id", "n_words", "n_removed", "kept", "removed"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(
        run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string, removed array<struct<first:bigint,last:bigint>>"
    )


def _merged(starts: Sequence[int], width: int) -> list[tuple[int, int]]:
    """Ranges of words that the windows at sorted starts cover."""
    out: list[tuple[int, int]] = []
    for start in starts:
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], start + width
        else:
            out.append((start, start + width))
    return out
