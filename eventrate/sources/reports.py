"""Writing report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventrate.operators.rank import global_rank


def write_report(
    df: DataFrame, path: str, fmt: str = "csv", index_by: Sequence[str] | None = None, mode: str = "overwrite"
) -> None:
    """Write a table as CSV (with header) or Parquet.

    ``index_by`` adds a leading ``index`` column that numbers the rows in that order.
    """
    if index_by:
        quoted = [F.col(f"`{c}`") for c in df.columns]
        df = global_rank(df, list(index_by), "index").select("index", *quoted)
    writer = df.write.mode(mode)
    if fmt == "csv":
        # Texts are quoted with doubled quotes inside, as read_records expects.
        writer.csv(path, header=True, quote='"', escape='"', emptyValue='""')
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown report format {fmt!r}")
