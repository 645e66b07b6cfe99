"""SentencePiece encoding and decoding with an Aho-Corasick automaton and a single-pass Viterbi.

The automaton reads the bytes of a text once.  At each position the pieces that end there are met by following
output links, longest first, and each relaxes the best score of that position.  Many words advance side by
side, one byte per step, so a step is a few numpy operations; each distinct word of a batch is solved once.

Scores are those stored in the model file, and the best segmentation is the one of highest total score, as in
the library's unigram models.  A model trained as BPE is read the same way: its scores are merge ranks.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType

from eventrate.llm.flat import gather, starts_of, text_slices

SPACE = "▁"
NORMAL, USER_DEFINED, BYTE = 1, 4, 6  # kinds of piece in a model file
UNKNOWN_PENALTY = 10.0
BATCH_BYTES = 1 << 20
CELLS = 1 << 20  # words x positions solved side by side

_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of this worker process."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


class Codec:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or not spec.escape_whitespaces or spec.remove_extra_whitespaces:
            raise ValueError("only models that leave texts as they are can be decoded exactly")
        self.prefix = " " if spec.add_dummy_prefix else ""
        self.byte_id = np.full(256, -1, np.int64)
        usable = []
        surface = []
        for i, p in enumerate(model.pieces):
            surface.append(p.piece.replace(SPACE, " ").encode() if p.type in (NORMAL, USER_DEFINED) else b"")
            if p.type == BYTE:
                self.byte_id[int(p.piece[3:5], 16)] = i
                surface[-1] = bytes([int(p.piece[3:5], 16)])
            elif p.type in (NORMAL, USER_DEFINED):
                usable.append((surface[-1], i, p.score))
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte pieces, so unknown characters would be lost")
        self.unknown = min(s for _, _, s in usable) - UNKNOWN_PENALTY
        self.surface_lengths = np.array([len(s) for s in surface], np.int64)
        self.surface_starts = starts_of(self.surface_lengths)[:-1]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        # A text may be cut before spaces and around characters that no piece holds, if no piece spans such a cut.
        if any(b" " in s.lstrip(b" ") for s, _, _ in usable):
            raise ValueError("a piece has a space behind a letter")
        lone = "\n" if not any(b"\n" in s for s, _, _ in usable) else ""
        self.words = re.compile(f" *[^ {lone}]+| +" + (f"|{lone}" if lone else ""))
        self._build(usable)

    def _build(self, usable: Sequence[tuple[bytes, int, float]]) -> None:
        """Trie, failure links folded into a full table of transitions, and output links."""
        children: list[dict[int, int]] = [{}]
        ends: dict[int, tuple[int, float, int]] = {}
        for piece, i, score in usable:
            node = 0
            for byte in piece:
                nxt = children[node].get(byte)
                if nxt is None:
                    nxt = children[node][byte] = len(children)
                    children.append({})
                node = nxt
            ends[node] = (i, score, len(piece))
        count = len(children)
        self.step = np.zeros((count, 256), np.int32)
        fail = np.zeros(count, np.int32)
        self.piece = np.full(count, -1, np.int32)
        self.score = np.zeros(count)
        self.length = np.zeros(count, np.int32)
        for node, (i, score, length) in ends.items():
            self.piece[node], self.score[node], self.length[node] = i, score, length
        self.output = np.zeros(count, np.int32)  # nearest shorter piece that ends here; 0 for none
        queue = deque([0])
        while queue:
            node = queue.popleft()
            if node:
                self.step[node] = self.step[fail[node]]
                self.output[node] = fail[node] if self.piece[fail[node]] >= 0 else self.output[fail[node]]
            for byte, child in children[node].items():
                fail[child] = self.step[fail[node], byte] if node else 0
                self.step[node, byte] = child
                queue.append(child)

    def _solve(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words end to end, and how many each has."""
        order = np.argsort([-len(w) for w in words], kind="stable")
        counts = np.zeros(len(words), np.int64)
        found: list[np.ndarray] = []
        first = 0
        while first < len(order):
            width = len(words[order[first]])
            last = min(len(order), first + max(1, CELLS // (width + 1)))
            rows = order[first:last]
            ids, n = self._lanes([words[i] for i in rows], width)
            counts[rows] = n
            found.append(ids)
            first = last
        # Back from order of length to the order of the words.
        flat = np.concatenate(found) if found else np.zeros(0, np.int64)
        sorted_counts = counts[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return gather(flat, starts_of(sorted_counts)[:-1], sorted_counts, place), counts

    def _lanes(self, words: Sequence[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi over words of falling length, at most ``width`` bytes."""
        size = np.array([len(w) for w in words])
        text = np.zeros((len(words), width), np.uint8)
        text[np.arange(width) < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        best = np.full((len(words), width + 1), -np.inf)
        best[:, 0] = 0
        # Until a piece is chosen, a position is one byte behind the one before.
        back = np.ones((len(words), width + 1), np.int32)
        chosen = np.zeros((len(words), width + 1), np.int64)
        chosen[:, 1:] = self.byte_id[text]
        state = np.zeros(len(words), np.int32)
        begun = np.zeros(len(words), np.int64)  # where the character at hand begins
        live = np.searchsorted(-size, -np.arange(width), side="left")
        for t in range(width):
            n = live[t]
            byte = text[:n, t]
            begun[:n] = np.where(byte & 0xC0 == 0x80, begun[:n], t)
            state[:n] = self.step[state[:n], byte]
            row = np.arange(n)
            link = np.where(self.piece[state[:n]] >= 0, state[:n], self.output[state[:n]])
            while True:
                some = link > 0
                if not some.all():
                    row, link = row[some], link[some]
                if not len(row):
                    break
                length = self.length[link]
                value = best[row, t + 1 - length] + self.score[link]
                better = value > best[row, t + 1]
                hit, node = row[better], link[better]
                best[hit, t + 1] = value[better]
                back[hit, t + 1] = length[better]
                chosen[hit, t + 1] = self.piece[node]
                link = self.output[link]
            # A character without any piece is spelled in bytes.
            whole = np.ones(n, bool)
            if t + 1 < width:
                whole = (text[:n, t + 1] & 0xC0 != 0x80) | (size[:n] == t + 1)
            row = np.flatnonzero(whole & (best[:n, t + 1] == -np.inf))
            best[row, t + 1] = best[row, begun[row]] + self.unknown
        at = size.copy()
        steps, rows = [], []
        row = np.arange(len(words))
        while len(row):
            row = row[at[row] > 0]
            steps.append(chosen[row, at[row]])
            rows.append(row)
            at[row] -= back[row, at[row]]
        owner = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        ids = np.concatenate(steps) if steps else np.zeros(0, np.int64)
        # Steps run from the last piece of each word to its first.
        turned = np.lexsort((-np.arange(len(ids)), owner))
        return ids[turned], np.bincount(owner, minlength=len(words))

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each text has."""
        split = [self.words.findall(self.prefix + t) if t else [] for t in texts]
        number: dict[str, int] = {}
        places = np.array([number.setdefault(w, len(number)) for words in split for w in words], np.int64)
        ids, counts = self._solve([w.encode("utf-8", "replace") for w in number])
        out = gather(ids, starts_of(counts)[:-1], counts, places)
        ends = starts_of(counts[places])
        return out, np.diff(ends[starts_of(np.array([len(w) for w in split], np.int64))])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of id lists that lie end to end."""
        raw = gather(self.surface, self.surface_starts, self.surface_lengths, ids).tobytes()
        ends = starts_of(self.surface_lengths[ids])[starts_of(counts)]
        texts = (raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:]))
        return [t.removeprefix(self.prefix) for t in texts]


def encode_documents(
    docs: DataFrame, model: str, text: str = "text", keep: Sequence[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if not given) plus ``n_tokens``, ``ids`` and ``round_trip``.

    ``model`` is the path of a SentencePiece model file; ``round_trip`` tells whether decoding gives the text back.
    NULL and empty texts have no ids and count as restored.  A text with the model's own mark for a space
    (U+2581) is encoded like one with spaces and is not restored.  Rows are encoded one by one, so repeated rows and
    NULLs in other columns need no rule.  Columns of the input that are named like the added ones are replaced.
    """
    added = ["n_tokens", "ids", "round_trip"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added]
    schema = docs.select(*kept).schema.add("n_tokens", LongType()).add("ids", ArrayType(IntegerType())).add("round_trip", BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            for a, b, texts in text_slices(batch.column(at), BATCH_BYTES):
                ids, counts = own.encode([t.replace(SPACE, " ") for t in texts])
                same = [x == y for x, y in zip(own.decode(ids, counts), texts)]
                lists = pa.ListArray.from_arrays(pa.array(starts_of(counts), pa.int32()), pa.array(ids, pa.int32()))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(kept)], pa.array(counts), lists, pa.array(same)], [*kept, *added]
                )

    # A text that is kept is sent once.
    at = kept.index(text) if text in kept else len(kept)
    return docs.select(*kept, *([] if text in kept else [F.col(text).alias("_read")])).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Other columns of ``encoded`` and the ``text`` of its ``ids``; NULL for NULL ids."""
    schema = encoded.drop(text).schema.add(text, StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            column = batch.column(batch.schema.names.index(ids))
            lists = [np.array(x or [], np.int64) for x in column.to_pylist()]
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            texts = own.decode(flat, np.array([len(x) for x in lists], np.int64))
            restored = pa.array([t if ok else None for t, ok in zip(texts, column.is_valid().to_pylist())], pa.string())
            kept = [i for i, n in enumerate(batch.schema.names) if n != text]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in kept], restored], [*[batch.schema.names[i] for i in kept], text]
            )

    return encoded.mapInArrow(run, schema)
