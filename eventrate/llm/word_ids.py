"""Ids of whole texts from a word-splitting tokenizer, with each distinct word encoded once.

The tokenizer drops white space and never joins over it, so the ids of a text are those of its
words in a row.  Words seen before come from a bounded cache; new ones are encoded together.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from itertools import chain, repeat

import numpy as np
import regex

from eventrate.llm.flat import gather, starts_of

CACHED_WORDS = 250_000
#: Bytes of a word that the pattern alone cannot place: characters beyond U+00FF, whose form the normaliser may
#: change, the blanks U+0085 and U+00A0, and what may be a special token.
ODD = re.compile(rb"[\xc4-\xff]|\xc2[\x85\xa0]|<\|")
WORD_END = "</w>"

_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class WordEncoder:
    def __init__(self, path: str, cached: int = CACHED_WORDS):
        import json

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            splits = json.load(f)["pre_tokenizer"]["pretokenizers"]
        pattern = next(s["pattern"]["Regex"] for s in splits if s["type"] == "Split")
        self.pattern = regex.compile(f"\\n|{pattern}")
        vocabulary = self.library.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith(WORD_END)]] = True
        self.cached = cached
        self._clear()
        self._clear_pieces()

    def _clear(self) -> None:
        self.words: dict[bytes, int] = {}
        self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _clear_pieces(self) -> None:
        self.pieces: dict[str, int] = {}
        self.piece_lengths, self.piece_flat = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _piece_ids(self, pieces: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that are one word of the tokenizer each, and how many each has."""
        ids = np.array(self.library.encode(" ".join(pieces), add_special_tokens=False).ids, np.uint32)
        after = np.flatnonzero(self.ends[ids]) + 1
        if len(after) == len(pieces):
            return ids, np.diff(after, prepend=0)
        return self._whole_ids(pieces)

    def _whole_ids(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [e.ids for e in self.library.encode_batch(list(texts), add_special_tokens=False)]
        return np.array([i for x in lists for i in x], np.uint32), np.array([len(x) for x in lists], np.int64)

    def _split_ids(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words, from the pieces that the tokenizer's pattern cuts them into."""
        found = self.pattern.findall(b"\n".join([*words, b""]).decode().lower())
        fresh = list(set(found) - self.pieces.keys() - {"\n"})
        if fresh:
            ids, counts = self._piece_ids(fresh)
            self.pieces.update(zip(fresh, range(len(self.pieces), len(self.pieces) + len(fresh))))
            self.piece_flat = np.concatenate([self.piece_flat, ids])
            self.piece_lengths = np.concatenate([self.piece_lengths, counts])
        places = np.fromiter(map(self.pieces.get, found, repeat(-1)), np.int64, len(found))
        ends = places < 0
        own = places[~ends]
        total = starts_of(self.piece_lengths[own])
        # Pieces before the end of each word, and so the ids before it.
        upto = total[np.flatnonzero(ends) - np.arange(len(words))]
        ids = gather(self.piece_flat, starts_of(self.piece_lengths)[:-1], self.piece_lengths, own)
        return ids, np.diff(upto, prepend=0)

    def _learn(self, new: list[bytes]) -> None:
        # All words are looked through at once; nothing odd reaches over the end of a word.
        places = [m.start() for m in ODD.finditer(b"\n".join(new))]
        ends = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)) + 1)
        odd = set(np.searchsorted(ends, places, side="right").tolist())
        plain = [w for i, w in enumerate(new) if i not in odd] if odd else new
        parts = []
        if plain:
            parts.append((plain, *self._split_ids(plain)))
        if odd:
            other = [new[i] for i in sorted(odd)]
            parts.append((other, *self._whole_ids([w.decode("utf-8", "replace") for w in other])))
        for words, ids, counts in parts:
            self.words.update(zip(words, range(len(self.words), len(self.words) + len(words))))
            self.flat = np.concatenate([self.flat, ids])
            self.lengths = np.concatenate([self.lengths, counts])

    def encode(self, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each text has."""
        if len(self.words) > self.cached:
            self._clear()
        if len(self.pieces) > 2 * self.cached:
            self._clear_pieces()
        split = [text.split() for text in texts]
        flat = list(chain.from_iterable(split))
        chosen = np.fromiter(map(self.words.get, flat, repeat(-1)), np.int64, len(flat))
        unseen = np.flatnonzero(chosen < 0)
        if len(unseen):
            new = [flat[i] for i in unseen.tolist()]
            self._learn(list(set(new)))
            chosen[unseen] = np.fromiter(map(self.words.__getitem__, new), np.int64, len(new))
        ids = gather(self.flat, starts_of(self.lengths)[:-1], self.lengths, chosen)
        ends = starts_of(self.lengths[chosen])
        return ids, np.diff(ends[starts_of(np.array([len(w) for w in split], np.int64))])
