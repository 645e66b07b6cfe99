"""Language identification by error-correcting output codes.

Each language has a codeword; for every bit a binary classifier on byte n-grams tells the languages with a 1
from those with a 0.  The codeword with the least loss wins, where the loss of a bit counts by how well its
classifier knows that language, and a small lead over the second codeword is flagged as ambiguous.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

from eventrate.llm.flat import U64, mix, starts_of, text_slices

UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
BATCH_BYTES = 1 << 19
#: ASCII signs, digits and control characters part words.
SPACE = np.uint8(32)
AS_LETTER = np.where(
    (np.arange(256) >= 128) | np.isin(np.arange(256), np.arange(ord("a"), ord("z") + 1)), np.arange(256), SPACE
).astype(np.uint8)


@dataclass(frozen=True)
class Settings:
    """``rows_per_language`` bounds the labelled documents that are learned from, picked by a hash of the text.

    n-grams of ``grams`` bytes fall into 2**``bucket_bits`` buckets.  Up to ``exhaustive`` languages all ways to part
    them are bits; more have ``bits_per_doubling`` random bits for each doubling.  A lead of less than ``ambiguous``
    over the second codeword, in probability, is flagged.
    """

    rows_per_language: int = 5_000
    grams: tuple[int, ...] = (2, 3, 4)
    bucket_bits: int = 16
    smoothing: float = 0.5
    exhaustive: int = 5
    bits_per_doubling: int = 10
    ambiguous: float = 0.5


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # buckets x bits
    trust: np.ndarray  # languages x bits, each row sums to 1
    settings: Settings


def codewords(languages: int, settings: Settings) -> np.ndarray:
    """A codeword of +1 and -1 for each language; no bit is constant and no two bits part alike."""
    if languages <= 1:
        return np.ones((languages, 0), np.int8)
    if languages <= settings.exhaustive:
        parts = np.arange((1 << languages - 1) - 1)
    else:
        bits = int(np.ceil(settings.bits_per_doubling * np.log2(languages)))
        draws = [np.random.default_rng(seed).integers(0, 2, (languages, bits)) * 2 - 1 for seed in range(32)]
        # Of the drawn codes, the one whose closest two words differ most.
        return max(draws, key=lambda c: -(c @ c.T - 2 * bits * np.eye(languages)).max()).astype(np.int8)
    rest = [(parts >> k & 1) * 2 - 1 for k in range(languages - 1)]
    return np.array([np.ones(len(parts)), *rest], np.int8)


def buckets(texts: Sequence[str], settings: Settings) -> tuple[list[np.ndarray], np.ndarray]:
    """Bucket of the n-gram that ends at each byte, for each n, and the bytes of each text.

    N-grams with a blank inside go to bucket 0, which never counts.
    """
    raw = [f" {t.lower()} ".encode("utf-8", "replace") for t in texts]
    c = AS_LETTER[np.frombuffer(b"".join(raw), np.uint8)]
    lengths = np.array([len(r) for r in raw], np.int64)
    first = starts_of(lengths)[:-1]
    since = np.arange(len(c)) - np.repeat(first, lengths)
    out = []
    for n in settings.grams:
        value = np.zeros(len(c), np.uint64)
        inner = since >= n - 1
        for back in range(n):
            own = c[: len(c) - back]
            value[back:] |= own.astype(np.uint64) << U64(8 * back)
            if 0 < back < n - 1:
                inner[back:] &= own != SPACE
        if n == 2:
            inner[1:] &= (c[1:] != SPACE) | (c[:-1] != SPACE)
        shift = U64(64 - settings.bucket_bits)
        place = (mix(value + U64(n << 56)) >> shift).astype(np.int32)
        out.append(np.where(inner, np.maximum(place, 1), 0))
    return out, lengths


def margins(texts: Sequence[str], model: Model) -> np.ndarray:
    """Evidence of each text for each bit: log odds summed over n-grams, divided by the root of their number."""
    places, lengths = buckets(texts, model.settings)
    first = starts_of(lengths)[:-1]
    total = np.zeros((len(texts), model.code.shape[1]))
    count = np.zeros(len(texts))
    for place in places:
        total += np.add.reduceat(model.weights[place], first, axis=0)
        count += np.add.reduceat((place > 0).astype(np.int64), first)
    return total / np.sqrt(np.maximum(count, 1))[:, None]


def losses(margin: np.ndarray, model: Model) -> np.ndarray:
    """Weighted logistic loss of each codeword."""
    signed = margin[:, None, :] * model.code[None]
    return (np.logaddexp(0, -signed) * model.trust[None]).sum(-1)


def learn(labelled: DataFrame, settings: Settings = Settings(), text: str = "text", lang: str = "lang") -> Model:
    """Fit codes and classifiers on labelled rows; rows without label or letter are left out.

    What comes to the driver is one row per language and bucket, and one per language and bit.
    """
    told = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")
    )
    sizes = {r[0]: r[1] for r in told.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    code = codewords(len(languages), settings)
    size = 1 << settings.bucket_bits
    model = Model(languages, code, np.zeros((size, code.shape[1]), np.float32), np.ones(code.shape), settings)
    if len(languages) < 2:
        return model
    drawn = F.pmod(F.xxhash64("text"), F.lit(1 << 20))
    share = F.create_map(*[
        F.lit(x) for k, n in sizes.items() for x in (k, min(1 << 20, (settings.rows_per_language << 20) // n + 1))
    ])
    sample = told.where(drawn < share[F.col("lang")])
    number = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(languages), size), np.int64)
        for batch in batches:
            label = [number[x] for x in batch.column(1).to_pylist()]
            for a, b, texts in text_slices(batch.column(0), BATCH_BYTES):
                places, lengths = buckets(texts, settings)
                owner = np.repeat(np.array(label[a:b]), lengths) * size
                for place in places:
                    np.add.at(seen.ravel(), owner + place, 1)
        i, j = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(seen[i, j])], ["lang", "bucket", "times"])

    counted = sample.mapInArrow(count, "lang bigint, bucket bigint, times bigint")
    counted = counted.groupBy("lang", "bucket").agg(F.sum("times").alias("times")).toArrow()
    seen = np.zeros((len(languages), size))
    seen[counted["lang"].to_numpy(), counted["bucket"].to_numpy()] = counted["times"].to_numpy()
    seen[:, 0] = 0
    share_of = (seen + settings.smoothing) / (seen.sum(1, keepdims=True) + settings.smoothing * size)
    for bit in range(code.shape[1]):
        one, zero = share_of[code[:, bit] > 0].mean(0), share_of[code[:, bit] < 0].mean(0)
        model.weights[:, bit] = np.log(one / zero)
    model.weights[0] = 0

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, rows = np.zeros(code.shape, np.int64), np.zeros(len(languages), np.int64)
        for batch in batches:
            label = np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
            for a, b, texts in text_slices(batch.column(0), BATCH_BYTES):
                np.add.at(right, label[a:b], margins(texts, model) * code[label[a:b]] > 0)
                np.add.at(rows, label[a:b], 1)
        i, j = np.indices(code.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i), pa.array(j), pa.array(right.ravel()), pa.array(rows[i])], ["lang", "bit", "hits", "docs"]
        )

    tested = sample.mapInArrow(test, "lang bigint, bit bigint, hits bigint, docs bigint")
    for i, j, hits, rows in tested.groupBy("lang", "bit").agg(F.sum("hits"), F.sum("docs")).collect():
        model.trust[i, j] = (hits + 1) / (rows + 2)
    model.trust /= model.trust.sum(1, keepdims=True)
    return model


def identify(docs: DataFrame, model: Model, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if not given) plus ``lang_pred``, ``score`` (0 to 1), ``ambiguous``.

    The score is the share of the winner when the losses of all codewords, per bit, are turned into probabilities.
    A text that is NULL or has no letter gets ``und``, score 0 and no flag, and so does every text if no
    language was learned; with one language that language wins with score 1.  Ties go to the first language by name.
    Rows are judged one by one, so repeated rows and NULLs in other columns need no rule.  Columns of the input
    that are named like the added ones are replaced.
    """
    added = ["lang_pred", "score", "ambiguous"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added]
    schema = docs.select(*kept).schema.add("lang_pred", StringType()).add("score", DoubleType()).add("ambiguous", BooleanType())
    bits = max(1, model.code.shape[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column(at), BATCH_BYTES):
                names: list[str] = [UNKNOWN] * (b - a)
                score, unsure = np.zeros(b - a), np.zeros(b - a, bool)
                told = [i for i in range(b - a) if model.languages and LETTER.search(texts[i])]
                if told:
                    loss = losses(margins([texts[i] for i in told], model), model)
                    odds = np.exp((loss.min(1, keepdims=True) - loss) * bits)
                    odds /= odds.sum(1, keepdims=True)
                    best = loss.argmin(1)
                    ranked = np.sort(odds, 1)
                    lead = ranked[:, -1] - (ranked[:, -2] if odds.shape[1] > 1 else 0)
                    score[told], unsure[told] = ranked[:, -1], lead < model.settings.ambiguous
                    for i, w in zip(told, best):
                        names[i] = model.languages[w]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(kept)], pa.array(names), pa.array(score), pa.array(unsure)], [*kept, *added]
                )

    # A text that is kept is sent once.
    at = kept.index(text) if text in kept else len(kept)
    return docs.select(*kept, *([] if text in kept else [F.col(text).alias("_read")])).mapInArrow(run, schema)
