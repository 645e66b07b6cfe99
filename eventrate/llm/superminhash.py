"""Near-duplicate documents: SuperMinHash signatures, banding, exact check, connected groups.

Each shingle of a set draws a permutation of the signature's registers; its r-th register gets rank r plus
a fraction.  A register keeps the lowest value over the set.  Ranks below r are final once every register holds
one, so most shingles stop after a few ranks.  The registers are correlated in a way that makes estimates
of the Jaccard similarity vary less than with independent permutations (Ertl, 2017).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventrate.llm.flat import U64, mix, slices, starts_of
from eventrate.llm.links import components
from eventrate.runtime import LIMITS, Limits, materialise

BATCH_BYTES = 1 << 20
PAIRED = 8  # largest bucket whose pairs are listed
TILE = 256  # sets compared at a time
BLOCK_SHINGLES = 2_000_000
GOLDEN = U64(0x9E3779B97F4A7C15)
BASE, BASE_INVERSE = U64(0x2545F4914F6CDD1D), U64(pow(0x2545F4914F6CDD1D, -1, 1 << 64))
#: Blanks that part words: space and U+0009 to U+000D.
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_lower = np.arange(256, dtype=np.uint64)
_lower[ord("A"):ord("Z") + 1] += U64(32)
BYTE_HASH = mix(_lower + GOLDEN)


@dataclass(frozen=True)
class Settings:
    """``words`` per shingle; link at ``percent`` Jaccard; ``bands`` of ``rows`` registers each.

    Two sets at 80 % miss all 32 bands of 4 with probability (1 - 0.8**4)**32 < 5e-8.
    """

    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def powers(base: np.uint64, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, out=out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all texts, and how many words each text has."""
    raw = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    blank = BLANK[raw]
    first = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    last = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    # Polynomial hashes of all prefixes; a word's is a difference, moved to the front.
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_HASH[raw] * powers(BASE, len(raw)), out=sums[1:])
    hashes = mix((sums[last] - sums[first]) * powers(BASE_INVERSE, len(raw))[first])
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(first, ends), prepend=0)


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted and end to end, and the size of each set.

    A text of fewer words than a shingle has its whole sequence as the only one.
    """
    hashes, counts = word_hashes(texts)
    at = starts_of(counts)
    sets = []
    for i, n in enumerate(counts):
        own = hashes[at[i]:at[i + 1]]
        width = min(words, n)
        if not n:
            sets.append(own)
            continue
        mixed = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            mixed = mix(mixed * U64(3) + own[k:n - width + 1 + k] + U64(width))
        sets.append(np.unique(mixed))
    return np.concatenate(sets) if sets else hashes, np.array([len(s) for s in sets], np.int64)


def signatures(shingles: np.ndarray, counts: np.ndarray, registers: int) -> np.ndarray:
    """SuperMinHash signature of each set; all sets advance rank by rank, until their registers are final."""
    out = np.full((len(counts), registers), np.inf)
    flat = out.ravel()
    owner = np.repeat(np.arange(len(counts)), counts)
    state, order = shingles, None
    for rank in range(registers):
        state = state + GOLDEN
        drawn = mix(state)
        fraction = (drawn >> U64(11)) * 2.0**-53
        swap = rank + (mix(drawn) % U64(registers - rank)).astype(np.int64)
        if order is None:
            register = swap
        else:
            row = np.arange(len(order))
            register = order[row, swap]
            order[row, swap] = order[row, rank]
        np.minimum.at(flat, owner * registers + register, rank + fraction)
        left = (out.max(axis=1) >= rank + 1)[owner]
        if not left.any():
            break
        if order is None:
            order = np.tile(np.arange(registers, dtype=np.uint8 if registers <= 256 else np.int32), (left.sum(), 1))
            order[np.arange(len(order)), swap[left]] = 0
            state, owner = state[left], owner[left]
        elif not left.all():
            state, owner, order = state[left], owner[left], order[left]
    return out


def sketch(docs: DataFrame, settings: Settings, key: str, text: str) -> DataFrame:
    """Size and digest of each document's shingle set, and the keys of its bands.

    Sets too small to differ from a set they link with have no band keys.
    """
    alone = alone_upto(settings.percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for a, b in slices([len(t) for t in texts], BATCH_BYTES):
                shingles, counts = shingle_sets(texts[a:b], settings.words)
                at = starts_of(counts)
                mixed = mix(shingles + GOLDEN)
                sums = [np.add.reduce(x[at[i]:at[i + 1]]) for x in (shingles, mixed) for i in range(b - a)]
                digests = np.array(sums, np.uint64).reshape(2, -1)
                large = np.flatnonzero(counts > alone)
                picked = np.repeat(counts > alone, counts)
                bits = signatures(shingles[picked], counts[large], settings.registers).view(np.uint64)
                bands = np.arange(1, settings.bands + 1, dtype=np.uint64)
                for k in range(settings.rows):
                    bands = mix(bands * GOLDEN + bits[:, k::settings.rows])
                keys: list = [None] * (b - a)
                for i, row in zip(large.tolist(), bands.view(np.int64)):
                    keys[i] = row
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array(counts), pa.array(digests[0].view(np.int64)),
                    pa.array(digests[1].view(np.int64)), pa.array(keys, pa.list_(pa.int64())),
                ], ["doc", "n", "d1", "d2", "bands"])

    return docs.select(F.col(key).cast("bigint"), F.col(text)).mapInArrow(
        run, "doc bigint, n bigint, d1 bigint, d2 bigint, bands array<bigint>"
    )


def alone_upto(percent: int) -> int:
    """Largest set size at which only equal sets can link: n of n + 1 stays below the limit."""
    n = 0
    while 100 * (n + 1) < percent * (n + 2):
        n += 1
    return n


def linked_pairs(pairs: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity; ``texts`` has ``node`` and ``body``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([t or b"" for t in batch.column(c).cast(pa.binary()).to_pylist()] for c in (2, 3))
            keep = np.zeros(len(x), bool)
            for a, b in slices([len(s) + len(t) for s, t in zip(x, y)], BATCH_BYTES):
                shingles, counts = shingle_sets([t for pair in zip(x[a:b], y[a:b]) for t in pair], settings.words)
                at = starts_of(counts)
                for i in range(b - a):
                    one, two = shingles[at[2 * i]:at[2 * i + 1]], shingles[at[2 * i + 1]:at[2 * i + 2]]
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    keep[a + i] = both > 0 and 100 * both >= settings.percent * (len(one) + len(two) - both)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"]
            )

    # A document in many pairs is a skewed join, which Spark splits.
    one = texts.select(F.col("node").alias("a"), F.col("body").alias("one"))
    two = texts.select(F.col("node").alias("b"), F.col("body").alias("two"))
    joined = pairs.join(two, "b").join(one, "a").select("a", "b", "one", "two")
    return joined.mapInArrow(run, "a bigint, b bigint")


def block_forest(nodes: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges that connect all linked sets of two blocks (side 0 and 1; 2 for both), found without listing pairs.

    Tiles of two times ``TILE`` sets are compared by one product of their 0/1 matrices; tiles whose sizes
    differ too much to link, or whose sets are all connected already, are skipped.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets, nodes, side = [sets[i] for i in order], nodes[order], side[order]
    size = np.array([len(s) for s in sets])
    label = np.arange(len(sets))
    edges = []
    rows = [np.flatnonzero(side != 1), np.flatnonzero(side != 0)]
    tiles = [[r[i:i + TILE] for i in range(0, len(r), TILE)] for r in rows]
    same = bool((side == 2).all())
    for k, one in enumerate(tiles[0]):
        for two in tiles[1][k if same else 0:]:
            low, high = min(size[one[-1]], size[two[-1]]), max(size[one[0]], size[two[0]])
            if 100 * low < percent * high or len(np.unique(label[np.concatenate([one, two])])) == 1:
                continue
            flat, owner = [], []
            for part in (one, two):
                flat.append(np.concatenate([sets[i] for i in part]))
                owner.append(np.repeat(np.arange(len(part)), size[part]))
            shared = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
            both = []
            for values, own, part in zip(flat, owner, (one, two)):
                at = np.searchsorted(shared, values)
                at[at == len(shared)] = 0
                held = shared[at] == values if len(shared) else np.zeros(len(values), bool)
                matrix = np.zeros((len(part), len(shared)), np.float32)
                matrix[own[held], at[held]] = 1
                both.append(matrix)
            common = np.rint(both[0] @ both[1].T).astype(np.int64)
            union = size[one][:, None] + size[two][None] - common
            i, j = np.nonzero((100 * common >= percent * union) & (label[one][:, None] != label[two][None]))
            for a, b in zip(one[i], two[j]):
                if label[a] != label[b]:
                    edges.append((min(nodes[a], nodes[b]), max(nodes[a], nodes[b])))
                    label[label == label[b]] = label[a]
    return edges


def linked_families(families: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """Edges that connect all linked members of each family (``node``, ``component``, set size ``n``).

    A family is cut into blocks of about ``BLOCK_SHINGLES`` by a hash of the node; each pair of blocks is compared
    in one task, whatever the size of the family, and gives fewer edges than it has nodes.
    """
    blocks = families.groupBy("component").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    placed = families.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = placed.join(texts, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = ["component", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second")]
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        nodes, side = group["node"].to_numpy(), group["side"].to_numpy()
        raw = [t or b"" for t in group["body"].cast(pa.binary()).to_pylist()]
        sets: list[np.ndarray] = []
        for a, b in slices([len(t) for t in raw], BATCH_BYTES):
            shingles, counts = shingle_sets(raw[a:b], settings.words)
            sets += np.split(shingles, np.cumsum(counts)[:-1])
        edges = np.array(block_forest(nodes, side, sets, settings.percent), np.int64).reshape(-1, 2)
        return pa.table({"a": edges[:, 0], "b": edges[:, 1]})

    grouped = met.select(*unit, "node", "body", side.alias("side")).groupBy("component", "first", "second")
    return grouped.applyInArrow(run, "a bigint, b bigint")


def groups_of(sets: DataFrame, docs: DataFrame, settings: Settings, key: str, text: str, limits: Limits) -> DataFrame | None:
    """``node`` and ``component`` of all nodes that are linked with another one; None if there are none.

    Nodes that share a band are candidates.  A bucket of up to ``PAIRED`` nodes gives its pairs; larger ones
    merge into families, inside which all sets are compared block by block.
    """
    members = sets.select(F.explode("bands").alias("key"), "node", "n")
    buckets = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.min("node").alias("centre"), F.max("node").alias("last")
    ).where("size > 1")
    held = materialise(members.join(buckets, "key"), "buckets")
    star = held.where(F.col("size") > PAIRED).select(F.col("node").alias("a"), F.col("centre").alias("b")).where("a <> b")
    families = components(star)
    families = materialise(families.join(sets.select("node", "n"), "node"), "families")
    # Pairs of small buckets, but for those inside one family.
    small = held.where(F.col("size") <= PAIRED).select("key", "node", "n")
    other = small.select("key", F.col("node").alias("b"), F.col("n").alias("m"))
    low, high = F.least("n", "m"), F.greatest("n", "m")
    pairs = small.withColumnRenamed("node", "a").join(other, "key").where(
        (F.col("a") < F.col("b")) & (low * 100 >= high * settings.percent)
    ).select("a", "b").distinct()
    of_a, of_b = (families.select(F.col("node").alias(c), F.col("component").alias(f"_{c}")) for c in ("a", "b"))
    outside = F.col("_a").isNull() | F.col("_b").isNull() | (F.col("_a") != F.col("_b"))
    pairs = materialise(pairs.join(of_a, "a", "left").join(of_b, "b", "left").where(outside).select("a", "b"), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(families.select("node")).distinct()
    wanted = materialise(wanted, "candidates")
    few = wanted.count()
    if not few:
        return None
    texts = docs.select(F.col(key).cast("bigint").alias("node"), F.col(text).alias("body"))
    texts = materialise(
        texts.join(F.broadcast(wanted) if few <= limits.broadcast_rows else wanted, "node", "left_semi"), "texts"
    )
    found = linked_families(families, texts, settings).unionByName(linked_pairs(pairs, texts, settings))
    return components(materialise(found.where("a <> b"), "links"))


def near_duplicates(
    docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text", limits: Limits = LIMITS,
) -> DataFrame:
    """Size of each document's shingle set, its group and whether it is the group's first.

    Two documents link if their sets of distinct shingles (A-Z lower-cased, words parted by ASCII blanks) have
    ``percent`` Jaccard similarity; a group is what links connect, named by its smallest key.  Documents with
    equal sets are one node of the search.  Texts that are NULL or have no word have an empty set and link with
    nothing.  The integer ``key`` names a document: rows that repeat a key are all returned, and a
    link of one of them counts for the key.  Rows with a NULL key are returned unlinked, with a NULL group, and
    kept.  An empty table gives no rows; other columns are not read.
    """
    sketched = materialise(sketch(docs, settings, key, text), "sketches")
    told = sketched.where("n > 0 and doc is not null")
    sets = materialise(
        told.groupBy("n", "d1", "d2").agg(F.min("doc").alias("node"), F.first("bands").alias("bands")), "sets"
    )
    groups = groups_of(sets.where("bands is not null"), docs, settings, key, text, limits)
    named = sets.select("n", "d1", "d2", "node", F.col("node").alias("component"))
    if groups is not None:
        named = named.drop("component").join(groups, "node", "left")
        named = named.withColumn("component", F.coalesce("component", "node"))
    named = named.drop("node")
    found = sketched.select("doc", "n", "d1", "d2").join(named, ["n", "d1", "d2"], "left")
    own = F.when((F.col("n") == 0) | F.col("doc").isNull(), F.col("doc")).otherwise(F.col("component"))
    return found.select(
        F.col("doc").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"),
        F.col("doc").eqNullSafe(own).alias("kept"),
    )
