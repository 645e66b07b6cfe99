"""Benchmark decontamination on templates, in DataFrame operations only.

Words become typed placeholders where they are parameters of a question: numbers, units after a number, and
names.  A passage of a benchmark item, or the same passage with other parameters, then has the same
template.  Windows of template words meet in a hash join, and the parameters of matched windows must map the
item's values to the document's one to one.  Windows of the words as written meet in the same join, so that a
copy is found whatever its placeholders and its letter case.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventrate.runtime import LIMITS, Limits, discard, materialise

# Words that are units when they follow a number.
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "ft", "yard", "yards", "mile", "miles",
    "meter", "meters", "metre", "metres", "kilometer", "kilometers", "kilometre", "kilometres",
    "mg", "g", "kg", "gram", "grams", "kilogram", "kilograms", "ton", "tons", "tonne", "tonnes", "ounce", "ounces", "oz",
    "pound", "pounds", "lb", "lbs",
    "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "cup", "cups",
    "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months",
    "year", "years", "ms", "s", "min", "h",
    "cent", "cents", "dollar", "dollars", "euro", "euros", "usd", "eur", "percent",
    "degree", "degrees", "mph", "kmh", "w", "kw", "kwh", "v", "hz",
)
# Number words, which are numbers like digits.
NUMBER_WORDS = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve",
    "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty",
    "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "billion",
)
MARK = "\u0001"
NUMBER, UNIT, NAME = f"{MARK}N", f"{MARK}U", f"{MARK}P"
APART = r"[\p{L}\p{M}\p{N}]"
DIGITS = r"\p{N}+(?:[.,]\p{N}+)*"
NUMBERS = rf"{DIGITS}|(?<!{APART})(?i:{'|'.join(NUMBER_WORDS)})(?!{APART})"
MEASURED = rf"({NUMBER}\s?)(?i:{'|'.join(UNITS)})(?!{APART})"
#: A capitalised word after another word, a comma or a semicolon; after a sentence end, a capital says nothing.
NAMES = r"\p{Lu}(?<=[\p{L}\p{N},;]\s\p{Lu})\p{Ll}[\p{L}\p{M}]*"
#: Every capitalised word, at the start of a sentence too; the one-to-one mapping tells names from chance.
STARTS = r"(?<![\p{L}\p{M}\p{N}])\p{Lu}\p{Ll}[\p{L}\p{M}]*"
TEMPLATE_WORD = rf"{MARK}[NUP]|[\p{{L}}\p{{M}}]+"
#: The forms of a text that meet: its template, that with names at sentence starts, and its words as written.
TEMPLATE, STARTED, RAW = "template", "started", "raw"
FORMS = (TEMPLATE, STARTED, RAW)
RAW_WORD = rf"{DIGITS}|[\p{{L}}\p{{M}}]+"


@dataclass(frozen=True)
class Settings:
    """Windows of ``window`` template words, of which ``literals`` or more are plain words.

    A document is contaminated by an item if windows with a consistent mapping cover ``percent`` of those
    of the item, or if ``run`` or more running words of it do in one place, whatever their share.  An item of fewer words than a window is one window of its own; an item with fewer words than
    ``literals`` cannot be told from chance and matches nothing.  As written, windows need one word that is no
    number to count in the share.
    """

    window: int = 8
    literals: int = 5
    percent: int = 40
    run: int = 13


def template(text: Column, names: str = NAMES) -> Column:
    """Template words of a text: lower-cased words and typed placeholders."""
    body = F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(" ")), names, NAME)
    body = F.regexp_replace(body, NUMBERS, NUMBER)
    body = F.regexp_replace(body, MEASURED, f"$1 {UNIT}")
    return F.regexp_extract_all(F.lower(body), F.lit(f"({TEMPLATE_WORD.replace('NUP', 'nup')})"))


def raw_words(text: Column) -> Column:
    """Lower-cased words and numbers as written: one for each template word."""
    return F.regexp_extract_all(F.lower(F.replace(text, F.lit(MARK), F.lit(" "))), F.lit(f"({RAW_WORD})"))


def words_of(text: Column, form: str) -> Column:
    return raw_words(text) if form == RAW else template(text, STARTS if form == STARTED else NAMES)


def is_slot(word: Column) -> Column:
    return F.startswith(word, F.lit(MARK))


def hashes(forms: list[str], width: int) -> Column:
    """Hashes of every window of ``width`` hashed words, each once for the ``forms``; none if there are fewer words.

    Words are taken one by one: in a lambda, a slice would copy the whole array for each window.
    """
    size = F.size(forms[0])
    starts = F.when(size >= width, F.sequence(F.lit(0), size - width)).otherwise(F.array().cast("array<int>"))

    def one(hashed: str, i: Column) -> Column:
        return F.xxhash64(*[F.get(hashed, i + k) for k in range(width)])

    return F.transform(starts, lambda i: F.array_distinct(F.array(*[one(f, i) for f in forms])))


def hashed_words(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def item_windows(items: DataFrame, key: str, text: str, settings: Settings, forms: tuple[str, ...]) -> DataFrame:
    """Windows of the items: ``item``, ``version``, ``form``, ``item_at``, ``hash``, ``width``, ``counts``, ``total``, ``pairs``.

    Only windows that can be told from chance count in the share; ``total`` is their number in the item.  ``pairs`` are hashes
    of neighbouring words that any text with the window holds side by side.
    """
    said = F.array(*[F.struct(F.lit(form).alias("form"), words_of(F.col("asked"), form).alias("words")) for form in forms])
    words = items.select(F.col(key).alias("item"), F.xxhash64(text).alias("version"), F.col(text).alias("asked")).distinct()
    words = words.select("item", "version", F.inline(said)).where(F.size("words") >= settings.literals).withColumns({
        "hashed": hashed_words(F.col("words")), "width": F.least(F.size("words"), F.lit(settings.window)),
    })
    every = None
    for width in range(settings.literals, settings.window + 1):
        fitting = F.col("width") == width
        found = hashes(["hashed"], width)
        every = F.when(fitting, found) if every is None else every.when(fitting, found)
    joined = words.select("item", "version", "form", "words", "width", F.posexplode(every).alias("item_at", "_all"))
    own = F.slice("words", F.col("item_at") + 1, F.col("width"))
    plain = F.size(F.filter(own, lambda w: ~is_slot(w))) >= settings.literals
    written = F.exists(own, lambda w: ~w.rlike(r"^\p{N}"))
    judged = joined.withColumns({"counts": F.when(F.col("form") == RAW, written).otherwise(plain), "own": own})
    beside = F.filter(
        F.arrays_zip(F.col("own").alias("a"), F.slice("own", F.lit(2), F.col("width")).alias("b")),
        lambda p: p["b"].isNotNull() & ((F.col("form") == RAW) | ~is_slot(p["a"]) & ~is_slot(p["b"])),
    )
    judged = judged.where((F.col("form") == RAW) | F.col("counts")).select(
        "item", "version", "form", "item_at", F.get("_all", F.lit(0)).alias("hash"), "width", "counts",
        F.transform(beside, lambda p: F.xxhash64(p["a"], p["b"])).alias("pairs"),
    )
    return judged.withColumn("total", F.count_if("counts").over(Window.partitionBy("item", "version", "form")))


def candidates(docs: DataFrame, windows: DataFrame, key: str, text: str, limits: Limits) -> DataFrame:
    """``doc`` and ``body`` of documents that may hold a window: those with the rarest of its pairs of neighbouring words.

    One pass over the texts finds the pairs of all items in them; how rare a pair is follows from what it found.
    """
    pairs = materialise(windows.select(F.explode("pairs").alias("pair")).distinct(), "pairs")
    small = pairs.count() <= limits.broadcast_rows
    words = docs.where(F.col(text).isNotNull()).select(
        F.col(key).alias("doc"), F.xxhash64(text).alias("body"), raw_words(F.col(text)).alias("words")
    )
    beside = words.select("doc", "body", F.inline(
        F.arrays_zip(F.col("words").alias("a"), F.slice("words", F.lit(2), F.greatest(F.size("words"), F.lit(1))).alias("b"))
    )).where("b is not null").select("doc", "body", F.xxhash64("a", "b").alias("pair"))
    held = materialise(beside.join(F.broadcast(pairs) if small else pairs, "pair", "left_semi"), "held-pairs")
    times = held.groupBy("pair").agg(F.count(F.lit(1)).alias("times"))
    wanted = windows.select("item", "version", "form", "item_at", F.explode("pairs").alias("pair"))
    ranked = wanted.join(times, "pair", "left").groupBy("item", "version", "form", "item_at").agg(
        F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "pair")).alias("rarest")
    )
    # A window with a pair that no text holds is in none.
    rarest = materialise(ranked.where("rarest.times > 0").select(F.col("rarest.pair").alias("pair")).distinct(), "rarest-pairs")
    found = held.join(F.broadcast(rarest) if small else rarest, "pair", "left_semi").select("doc", "body").distinct()
    found = materialise(found, "candidates")
    discard(pairs, held, rarest)
    return found


def matches(
    docs: DataFrame, items: DataFrame, settings: Settings, key: str, text: str, item_key: str, item_text: str,
    limits: Limits, forms: tuple[str, ...],
) -> DataFrame:
    """Windows of documents that have the words of an item's window in one of the ``forms``."""
    found = materialise(item_windows(items, item_key, item_text, settings, forms), "item-windows")
    seen = found.groupBy("width").count().collect()  # one row per width
    small = sum(n for _, n in seen) <= limits.broadcast_rows
    some = candidates(docs, found, key, text, limits).select(F.col("doc").alias("_doc"), F.col("body").alias("_body"))
    few = some.count() <= limits.broadcast_rows
    names = [f"_{form}" for form in forms]
    own = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.xxhash64(text).alias("body"), F.col(text).alias("_text"))
    same = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("body") == F.col("_body"))
    words = own.join(F.broadcast(some) if few else some, same, "left_semi").select(
        "doc", "body", *[hashed_words(words_of(F.col("_text"), form)).alias(n) for form, n in zip(forms, names)],
    )
    widths = [width for width, _ in seen] or [settings.window]
    # A window without placeholders is the same in every form and goes into the join once.
    every = [
        words.select("doc", "body", F.lit(width).alias("width"), F.posexplode(hashes(names, width)).alias("at", "_all"))
        for width in widths
    ]
    joined = every[0]
    for part in every[1:]:
        joined = joined.unionByName(part)
    joined = joined.select("doc", "body", "width", "at", F.explode("_all").alias("hash"))
    asked = found.drop("pairs")
    met = joined.join(F.broadcast(asked) if small else asked, ["hash", "width"])
    return met.select("doc", "body", "item", "version", "form", "at", "item_at", "width", "counts", "total")


def contaminated(
    docs: DataFrame, items: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text", limits: Limits = LIMITS, forms: tuple[str, ...] = (TEMPLATE,),
) -> DataFrame:
    """Contaminated documents: ``doc``, ``body`` (hash of the text), ``item``, ``percent`` covered, ``verbatim``.

    Each of the ``forms`` is judged on its own and the best one stands; ``judge_documents`` takes all ``FORMS``.

    Matched windows of one document and item that have the same distance are one occurrence.  Its
    parameters must map one to one between item and document, else the occurrence does not count.  It is
    verbatim if all parameters are equal.  NULL and empty texts are clean; repeated rows are judged alike; empty
    tables give no rows; other columns are not read.
    """
    met = materialise(matches(docs, items, settings, key, text, item_key, item_text, limits, forms), "matches")
    own = [F.col("doc"), F.col("body")]
    some = materialise(met.select("doc", "body").distinct(), "matched")
    few = some.count() <= limits.broadcast_rows
    hashed = docs.where(F.col(text).isNotNull()).select(
        F.col(key).alias("_doc"), F.xxhash64(text).alias("_body"), F.col(text).alias("_text")
    )
    same = F.col("_doc").eqNullSafe(F.col("doc")) & (F.col("_body") == F.col("body"))
    texts = hashed.join(F.broadcast(some) if few else some, same, "left_semi").distinct().select(
        F.col("_doc"), F.col("_body"), *[words_of(F.col("_text"), form).alias(f"_{form}") for form in forms], raw_words(F.col("_text")).alias("raw")
    )
    kinds = F.coalesce(*[F.when(F.col("form") == form, F.col(f"_{form}")) for form in forms])
    item_words = items.select(
        F.col(item_key).alias("_item"), F.xxhash64(item_text).alias("_version"), raw_words(F.col(item_text)).alias("asked")
    ).distinct()
    # Only the window of each match goes on, not the words of the whole document.
    got = met.join(texts, same).select(
        *met.columns, *[F.slice(c, F.col("at") + 1, F.col("width")).alias(n) for c, n in ((kinds, "kind"), ("raw", "got"))]
    )
    placed = got.join(
        item_words, F.col("_item").eqNullSafe(F.col("item")) & (F.col("_version") == F.col("version"))
    ).withColumn("want", F.slice("asked", F.col("item_at") + 1, F.col("width")))
    slots = F.filter(F.arrays_zip("kind", "got", "want"), lambda s: is_slot(s["kind"]))
    occurrence = ["doc", "body", "item", "version", "form", "shift"]
    shifted = placed.withColumn("shift", F.col("at") - F.col("item_at")).withColumn("slots", slots)
    pairs = shifted.select(*occurrence, F.explode("slots").alias("s")).distinct()
    maps = pairs.groupBy(*occurrence).agg(
        F.countDistinct("s").alias("_pairs"), F.countDistinct("s.kind", "s.want").alias("_wants"),
        F.countDistinct("s.kind", "s.got").alias("_gots"),
        F.bool_and(F.col("s.want").eqNullSafe(F.col("s.got"))).alias("_equal"),
    )
    windows = met.withColumn("shift", F.col("at") - F.col("item_at"))
    on = None
    for c in occurrence:
        same_value = windows[c].eqNullSafe(maps[c])
        on = same_value if on is None else on & same_value
    judged = windows.join(maps, on, "left").select(
        *[windows[c] for c in occurrence], "item_at", "width", "counts", "total", F.coalesce("_equal", F.lit(True)).alias("_equal"),
        F.coalesce((F.col("_pairs") == F.col("_wants")) & (F.col("_pairs") == F.col("_gots")), F.lit(True)).alias("_fits"),
    ).where("_fits")
    # Longest run of consecutive windows in one occurrence, in words.
    judged = judged.distinct()
    step = F.col("item_at") - F.row_number().over(Window.partitionBy(*occurrence).orderBy("item_at"))
    runs = judged.withColumn("step", step).groupBy(*occurrence, "step").agg(
        (F.count(F.lit(1)) + F.max("width") - 1).alias("words"), F.max("total").alias("total"),
        F.collect_set(F.when(F.col("counts"), F.col("item_at"))).alias("places"), F.bool_and("_equal").alias("_equal"),
    )
    covered = runs.groupBy(*own, "item", "version", "form").agg(
        F.max("words").alias("words"), F.max("total").alias("total"),
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("covered"), F.bool_and("_equal").alias("verbatim"),
    ).withColumn("percent", F.coalesce(F.col("covered") * 100 / F.nullif("total", F.lit(0)), F.lit(0.0)))
    whole = (F.col("covered") > 0) & (F.col("percent") >= settings.percent)
    covered = covered.where(whole | (F.col("words") >= settings.run))
    return covered.groupBy(*own, "item").agg(F.max("percent").alias("percent"), F.bool_or("verbatim").alias("verbatim"))


def judge_documents(
    docs: DataFrame, items: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text", limits: Limits = LIMITS,
) -> DataFrame:
    """All columns of ``docs`` plus ``contaminated`` and ``items``: (item, percent covered, verbatim) by item.

    Columns of the input with these names are replaced.
    """
    found = contaminated(docs, items, settings, key, text, item_key, item_text, limits, FORMS)
    listed = materialise(found.groupBy("doc", "body").agg(
        F.array_sort(F.collect_list(F.struct("item", "percent", "verbatim"))).alias("_items")
    ), "contaminated")
    listed = listed.select(F.col("doc").alias("_doc"), F.col("body").alias("_body"), "_items")
    small = listed.count() <= limits.broadcast_rows and found_bytes(listed) <= limits.broadcast_bytes
    # The row is carried as one value, so that its columns may have any names.
    own = docs.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), F.xxhash64(text).alias("_hash"))
    same = F.col("_key").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_body"))
    joined = own.join(F.broadcast(listed) if small else listed, same, "left")
    kind = listed.schema["_items"].dataType
    return joined.select(
        *[F.col("_row").getField(c).alias(c) for c in docs.columns if c not in ("contaminated", "items")],
        F.col("_items").isNotNull().alias("contaminated"), F.coalesce("_items", F.array().cast(kind)).alias("items"),
    )


def found_bytes(listed: DataFrame) -> int:
    """About the bytes of a table of judged documents, each with its list of items."""
    return listed.agg(F.coalesce(F.sum(F.size("_items") * 32 + 32), F.lit(0))).first()[0]
