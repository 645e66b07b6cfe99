"""Numpy helpers for lists that are kept end to end in one flat array."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """First place of each list, and the end of the last."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The chosen lists of ``flat``, end to end."""
    taken = lengths[chosen]
    place = starts_of(taken)
    return flat[np.repeat(starts[chosen] - place[:-1], taken) + np.arange(place[-1])]


def slices(sizes: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours that sum to about ``most``; a larger one stands alone."""
    first, total = 0, 0
    for i, size in enumerate(sizes):
        if i > first and total + size > most:
            yield first, i
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)


def text_slices(column: pa.Array, most: int) -> Iterator[tuple[int, int, list[str]]]:
    """Ranges of neighbours of about ``most`` bytes and their texts, "" for NULL; one range is decoded at a time."""
    raw = column.cast(pa.binary())
    for a, b in slices(pc.fill_null(pc.binary_length(raw), 0).to_pylist(), most):
        yield a, b, [(t or b"").decode("utf-8", "replace") for t in raw.slice(a, b - a).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a one-to-one scramble of 64-bit words."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))
