"""Raw records: delimited files with a header and several spellings of missing."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that stand for a missing value.
NULL_TOKENS = ("", "NA", "UNKNOWN", "#VALUE!")

WHOLE = r"^\s*[+-]?[0-9]+\s*$"
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def identifiers(headers: Sequence[str | None]) -> list[str]:
    """Unique column names made from header texts; dots would mean nesting to Spark."""
    names: list[str] = []
    for header in headers:
        base = re.sub("[^0-9A-Za-z_]", "_", header or "")
        base = base if re.match("[A-Za-z_]", base) else f"X{base}"
        name, copies = base, 0
        while name.lower() in [n.lower() for n in names]:
            copies += 1
            name = f"{base}_{copies}"
        names.append(name)
    return names


def clean_names(df: DataFrame) -> DataFrame:
    """Rename columns to unique identifiers."""
    return df.toDF(*identifiers(df.columns))


def infer_types(df: DataFrame) -> dict[str, str]:
    """Narrowest of int, bigint, double and string that every present value fits, in one scan."""
    tests = []
    for i, c in enumerate(df.columns):
        value = F.col(c)
        tests += [
            F.count(value).alias(f"n{i}"),
            F.count_if(value.rlike(WHOLE) & value.try_cast("int").isNotNull()).alias(f"i{i}"),
            F.count_if(value.rlike(WHOLE) & value.try_cast("bigint").isNotNull()).alias(f"l{i}"),
            F.count_if(value.rlike(NUMBER) & value.try_cast("double").isNotNull()).alias(f"d{i}"),
        ]
    seen = df.agg(*tests).first()
    out = {}
    for i, c in enumerate(df.columns):
        rows = seen[f"n{i}"]
        fits = [t for t, key in (("int", "i"), ("bigint", "l"), ("double", "d")) if rows and seen[f"{key}{i}"] == rows]
        out[c] = fits[0] if fits else "string"
    return out


def read_records(
    spark: SparkSession,
    path: str,
    null_tokens: Sequence[str] = NULL_TOKENS,
    types: Mapping[str, str] | None = None,
    infer: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """Read delimited text with a header, turn null tokens into NULL and apply types.

    ``types`` declares the type of columns (others stay text); ``infer`` finds types with one
    extra scan.  Values that do not fit a declared type become NULL.  ``multi_line`` allows line
    breaks inside quoted texts, at the price of reading each file in a single task.
    """
    reader = spark.read.options(quote='"', escape='"', multiLine=multi_line)
    headers = reader.csv(path, header=False).first() or []
    fields = [T.StructField(n, T.StringType()) for n in identifiers(headers)]
    raw = reader.schema(T.StructType(fields)).csv(path, header=True)
    tokens = list(null_tokens)
    text = raw.select(*[F.when(~F.col(c).isin(tokens), F.col(c)).alias(c) for c in raw.columns])
    if infer:
        types = {**infer_types(text), **(types or {})}
    if not types:
        return text
    return text.select(
        *[F.trim(c).try_cast(types[c]).alias(c) if types.get(c, "string") != "string" else F.col(c)
          for c in text.columns]
    )
