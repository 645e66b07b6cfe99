"""Line dedup for near-equal lines, in DataFrame operations only.

Lines are normalised; equal ones are one class.  A class gets a 63-bit SimHash of its words, each weighted by its
letters, as the edit distance does.  The words of each quarter of a line vote on a block of bits of their own, so an edit
changes no block but that of its quarter.  Classes whose SimHash agrees on two of the four blocks meet by a join on
pairs of blocks: by the pigeonhole principle all whose edits lie in two quarters of the line do, and by chance some others.
Edit similarity decides.  Of each connected group the first occurrence stays.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventrate.llm.links import group
from eventrate.runtime import LIMITS, Limits, materialise, passing_tables

#: The SimHash counts three bits in each number, 21 bits apart, so that 21 sums hold 63 counters.
FIELD, SUMS = 21, 21
FIELDS = sum(1 << FIELD * f for f in range(3))
BLOCKS = (16, 16, 16, 15)
CHUNK, ANCHOR = 32, 12  # characters of the pieces that bound an edit distance, and of those that are sought behind one


@dataclass(frozen=True)
class Settings:
    """Lines of ``min_words`` or more link if two blocks of their SimHash are equal, at most ``bits`` of it differ, and
    the edit similarity (1 - distance / longer length, on normalised lines) is ``percent`` or more.

    Shorter lines link only if equal: one changed word is too much of them.
    """

    min_words: int = 5
    bits: int = 20
    percent: int = 90


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Lines with a letter or digit: ``doc``, ``body`` (hash of its text), ``line`` number, normalised ``norm``."""
    flat = F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}\n]+", " ")
    # Whatever stands beside an explode is worked out for each row that it makes, so the hash comes before.  An inner
    # explode would be filtered for empty lists at the scan, which means that all texts are split once more.
    split = docs.where(F.col(text).isNotNull()).select(
        F.col(key).alias("doc"), F.xxhash64(text).alias("body"), F.split(flat, "\n").alias("norms")
    ).select("doc", "body", F.posexplode_outer("norms").alias("line", "norm"))
    return split.withColumn("norm", F.trim("norm")).where("norm <> ''")


def occurrences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Every judged line with the hash of its normal form, its length, its words and their SimHash.

    The words of a line are summed where the line was read; one row per line is shuffled.
    """
    split = lines(docs, key, text).select(
        "doc", "body", "line", F.xxhash64("norm").alias("node"), F.char_length("norm").alias("chars"), F.split("norm", " ").alias("own"),
    )
    words = split.select(
        "doc", "body", "line", "node", "chars", F.size("own").alias("own"), F.posexplode_outer("own").alias("at", "word"),
    )
    # The block that a word votes on: the quarter of the line in which it stands.
    masks, first = [], 0
    for width in BLOCKS:
        masks.append(F.lit((1 << width) - 1 << first))
        first += width
    quarter = F.floor(F.col("at") * len(BLOCKS) / F.col("own")).cast("int")
    hashed = words.withColumns({
        "word": F.xxhash64("word").bitwiseAND(F.get(F.array(*masks), quarter)), "letters": F.char_length("word").cast("bigint"),
        "quarter": quarter,
    })
    place = ["doc", "body", "line", "node", "chars"]
    none = F.lit(0).cast("bigint")
    sums = [
        F.coalesce(F.try_sum(F.shiftrightunsigned("word", k).bitwiseAND(F.lit(FIELDS)) * F.col("letters")), none).alias(f"s{k}")
        for k in range(SUMS)
    ]
    voters = [F.coalesce(F.sum(F.when(F.col("quarter") == q, F.col("letters"))), none).alias(f"letters{q}") for q in range(len(BLOCKS))]
    counted = hashed.groupBy(*place).agg(F.count(F.lit(1)).alias("words"), *voters, *sums)
    mask = F.lit((1 << FIELD) - 1)
    owner = [q for q, width in enumerate(BLOCKS) for _ in range(width)]
    # As a function of one sum: the code of 63 comparisons in a row is too long for the JVM to compile.
    votes = F.array(*[
        F.struct(F.col(f"s{k}").alias("ones"), *[F.col(f"letters{owner[k + FIELD * f]}").alias(f"of{f}") for f in range(3)])
        for k in range(SUMS)
    ])

    def bits(v: Column, k: Column) -> Column:
        three = [
            F.when(F.shiftright(v["ones"], FIELD * f).bitwiseAND(mask) * 2 > v[f"of{f}"], F.lit(1 << FIELD * f)).otherwise(none)
            for f in range(3)
        ]
        return F.call_function("shiftleft", three[0].bitwiseOR(three[1]).bitwiseOR(three[2]), k)

    simhash = F.aggregate(F.transform(votes, bits), none, lambda x, y: x.bitwiseOR(y))
    return counted.select(*place, "words", simhash.alias("simhash"))


def block_keys(simhash: str) -> Column:
    """One key for each pair of blocks."""
    blocks, at = [], 0
    for width in BLOCKS:
        blocks.append(F.shiftright(simhash, at).bitwiseAND(F.lit((1 << width) - 1)))
        at += width
    pairs = combinations(range(len(BLOCKS)), 2)
    return F.array(*[F.xxhash64(F.lit(n), blocks[i], blocks[j]) for n, (i, j) in enumerate(pairs)])


def confirm(
    pairs: DataFrame, classes: DataFrame, docs: DataFrame, settings: Settings, key: str, text: str, limits: Limits,
) -> DataFrame:
    """The pairs (a, b) of line hashes whose normal forms reach the edit similarity."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return near_pairs(pairs, normal_forms(wanted, classes, docs, key, text, limits), settings)


def normal_forms(
    wanted: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, limits: Limits,
) -> DataFrame:
    """``node`` and ``norm`` of the lines ``wanted``.  Only documents that hold the first occurrence of one are read for its text."""
    places = classes.select("node", "first").join(wanted, "node", "left_semi")
    places = materialise(places.select(
        "node", F.col("first.doc").alias("_doc"), F.col("first.body").alias("_body"), F.col("first.line").alias("_line")
    ), "places")
    few = places.count() <= limits.broadcast_rows
    holders = places.select("_doc", "_body").distinct()
    own = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.xxhash64(text).alias("_hash"))
    held = F.col("_key").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_body"))
    some = own.join(F.broadcast(holders) if few else holders, held, "left_semi")
    same = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("body") == F.col("_body")) & (F.col("line") == F.col("_line"))
    found = lines(some, "_key", "_text").join(F.broadcast(places) if few else places, same)
    # Repeated rows hold the same line.
    return materialise(found.groupBy("node").agg(F.min("norm").alias("norm")), "forms")


def near_pairs(pairs: DataFrame, forms: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) whose normal forms reach the edit similarity."""
    one = forms.select(F.col("node").alias("a"), F.col("norm").alias("one"))
    two = forms.select(F.col("node").alias("b"), F.col("norm").alias("two"))
    longer = "greatest(char_length(one), char_length(two))"
    most = f"cast(floor({longer} * {100 - settings.percent} / 100) as int)"
    # Edits of pieces are never fewer than those of the whole, wherever the two lines are cut; mostly they are few enough,
    # and the whole need not be compared.  A piece ends in the second line where the letters behind it in the first one
    # are found again, near the place where it should end.
    last = f"cast(greatest(char_length(r.one) - 1, 0) / {CHUNK} as int)"
    found = f"locate(substring(r.one, (i + 1) * {CHUNK} + 1, {ANCHOR}), substring(r.two, s.at + {CHUNK // 2}, {CHUNK + ANCHOR}))"
    place = f"if(place > 0, s.at + {CHUNK // 2} - 1 + place, s.at + {CHUNK})"
    end = f"if(i = {last}, char_length(r.two) + 1, {_let(found, 'place', place)})"
    piece = (f"substring(r.one, i * {CHUNK} + 1, {CHUNK})", "substring(r.two, s.at, stop - s.at)")
    cost = f"if({piece[0]} = {piece[1]}, 0, levenshtein({piece[0]}, {piece[1]}))"
    # A bound that is beyond the limit needs no more pieces.
    step = _let(end, "stop", f"named_struct('at', stop, 'cost', s.cost + {cost})")
    bound = f"aggregate(sequence(0, {last}), named_struct('at', 1, 'cost', 0), (s, i) -> if(s.cost > r.most, s, {step}), s -> s.cost)"
    near = f"case when {bound} <= r.most then true else levenshtein(r.one, r.two, r.most) >= 0 end"
    # What both begin or end with costs no edit, and time is taken with the square of the length that is left.
    tail = "named_struct('one', substring(t.one, tail + 1), 'two', substring(t.two, tail + 1), 'most', t.most)"
    near = _let(_let(_same("t.one", "t.two"), "tail", tail), "r", near)
    head = f"named_struct('one', reverse(substring(one, head + 1)), 'two', reverse(substring(two, head + 1)), 'most', {most})"
    near = _let(_let(_same("one", "two"), "head", head), "t", near)
    return pairs.join(two, "b").join(one, "a").where(near).select("a", "b")


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body``, in which ``name`` stands for ``value``.

    A column would be put back as its expression, wherever it is named, as the filter is moved below it.
    """
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _same(one: str, two: str) -> str:
    """SQL for the number of characters that ``one`` and ``two`` begin with alike, found by halving."""
    shorter = f"least(char_length({one}), char_length({two}))"
    step = "shiftleft(1, e)"
    alike = f"at + {step} <= {shorter} and substring({one}, at + 1, {step}) = substring({two}, at + 1, {step})"
    powers = f"sequence(cast(floor(log2(greatest({shorter}, 1))) as int), 0, -1)"
    return f"aggregate({powers}, 0, (at, e) -> if({alike}, at + {step}, at))"


def repeated_lines(
    docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text", limits: Limits = LIMITS,
) -> DataFrame:
    """Lines to be dropped: ``doc``, ``body``, ``line``, and the line they repeat.

    The first occurrence of a group by (key, hash of the text, line number) stays, NULL keys first.
    """
    found = materialise(occurrences(docs, key, text), "lines")
    place = F.struct("doc", "body", "line")
    classes = materialise(
        found.groupBy("node").agg(
            F.count(F.lit(1)).alias("times"), F.min(place).alias("first"), F.max("simhash").alias("simhash"),
            F.max("words").alias("words"), F.max("chars").alias("chars"),
        ), "line-classes",
    )
    fuzzy = classes.where(F.col("words") >= settings.min_words)
    members = fuzzy.select(F.explode(block_keys("simhash")).alias("key"), "node")

    def may_link(x: str, y: str) -> Column:
        apart = F.bit_count(F.col(f"{x}simhash").bitwiseXOR(F.col(f"{y}simhash")))
        low, high = F.least(f"{x}chars", f"{y}chars"), F.greatest(f"{x}chars", f"{y}chars")
        return (apart <= settings.bits) & (low * 100 >= high * settings.percent)

    groups = group(
        members, fuzzy.select("node", "simhash", "chars"), may_link,
        lambda nodes: normal_forms(nodes, classes, docs, key, text, limits),
        lambda pairs, forms: near_pairs(pairs, forms, settings),
    )
    if groups is None:
        keepers = classes.where("times > 1").select("node", "first")
    else:
        named = classes.select("node", "times", "first").join(groups, "node", "left")
        firsts = named.where("component is not null").groupBy("component").agg(F.min("first").alias("group_first"))
        keepers = named.where("times > 1 or component is not null").join(firsts, "component", "left")
        keepers = keepers.select("node", F.coalesce("group_first", "first").alias("first"))
    repeats = found.select("doc", "body", "line", "node").join(keepers, "node")
    return repeats.where(~place.eqNullSafe(F.col("first"))).select("doc", "body", "line", "first")


def dedup_lines(
    docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text", limits: Limits = LIMITS,
    added: tuple[str, str] = ("lines_dropped", "lines_left"),
) -> DataFrame:
    """All columns of ``docs`` with repeated lines taken out of ``text``, and two ``added`` counts of lines.

    Lines are parted by \\n.  Lines without letter or digit are never dropped nor counted.  A NULL text stays NULL,
    an empty one empty, both with zero lines.  Rows equal in key and text are one document and keep the same lines;
    rows with a NULL key take part.  Lines of more than two million words are compared for equality only.
    An empty table gives no rows.  Columns of the input named like the two added ones are replaced.
    """
    with passing_tables() as keep:
        dropped = repeated_lines(docs, settings, key, text, limits).groupBy("doc", "body").agg(F.collect_set("line").alias("_drop"))
        dropped = keep(materialise(dropped, "dropped-lines"))
    seen = dropped.agg(F.count(F.lit(1)), F.sum(F.size("_drop"))).first()
    small = seen[0] <= limits.broadcast_rows and (seen[1] or 0) * 8 <= limits.broadcast_bytes
    dropped = dropped.select(F.col("doc").alias("_doc"), F.col("body").alias("_body"), "_drop")
    # The row is carried as one value, so that its columns may have any names.
    own = docs.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), F.col(text).alias("_said"), F.xxhash64(text).alias("_hash"))
    match = F.col("_key").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_body"))
    joined = own.join(F.broadcast(dropped) if small else dropped, match, "left")
    split = joined.withColumn("_lines", F.when(F.col("_drop").isNotNull(), F.split("_said", "\n")))
    # Kept numbers by difference of sets, so that a document of very many lines stays linear.
    kept = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop")))
    numbered = split.withColumn("_kept", kept)
    body = F.when(F.col("_drop").isNull(), F.col("_said")).otherwise(
        F.array_join(F.transform("_kept", lambda i: F.get("_lines", i)), "\n")
    )
    rebuilt = numbered.withColumn("_text", body)
    left = F.size(F.filter(F.split(F.col("_text"), "\n"), lambda x: x.rlike(r"[\p{L}\p{N}]")))
    plain = [c for c in docs.columns if c not in added]
    return rebuilt.select(
        *[(F.col("_text") if c == text else F.col("_row").getField(c)).alias(c) for c in plain],
        F.when(F.col("_drop").isNull(), F.lit(0)).otherwise(F.size("_drop")).alias(added[0]),
        F.when(F.col("_text").isNull(), F.lit(0)).otherwise(left).alias(added[1]),
    )
