"""Size limits and the shared scratch folder that every operator relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Bounds checked before any step whose cost is not spread over the cluster.

    ``task_rows``       most rows that one task may rank on its own
    ``sample_rows``     most sampled rows, and
    ``sample_bytes``    most bytes of their texts, brought to the driver to place cuts
    ``broadcast_rows``  most rows, and
    ``broadcast_bytes`` most bytes of text, of a broadcast lookup table
    """

    task_rows: int = 500_000
    sample_rows: int = 100_000
    sample_bytes: int = 32 * 1024 * 1024
    broadcast_rows: int = 500_000
    broadcast_bytes: int = 64 * 1024 * 1024


LIMITS = Limits()


def scratch_folder(spark: SparkSession) -> str:
    """Folder that all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back on a temporary folder of this machine.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    current = sc.getCheckpointDir()
    if current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="eventrate-"))
        current = sc.getCheckpointDir()
    return current


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a result feeds several later jobs: the costly input is scanned a
    single time, and lost executors never force that scan to be repeated.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    for passing in _passing:
        passing.append(stored)
    return stored


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote, once everything made from them is stored itself."""
    for table in tables:
        path = getattr(table, "_stored_at", None)
        if path:
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_passing: list[list[DataFrame]] = []


@contextmanager
def passing_tables() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stored inside are deleted at its end, but those given to the function that it hands out."""
    stored: list[DataFrame] = []
    kept: set[int] = set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(id(table))
        return table

    _passing.append(stored)
    try:
        yield keep
    finally:
        _passing.remove(stored)
        discard(*[t for t in stored if id(t) not in kept])


def fits_broadcast(df: DataFrame, limits: Limits = LIMITS) -> bool:
    """Measure a lookup table and tell whether it may be broadcast."""
    text = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in text), F.lit(0))
    seen = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return seen["rows"] <= limits.broadcast_rows and seen["bytes"] <= limits.broadcast_bytes


_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, which may not have it on their path; once a session."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    # Read from here by the driver only; Spark serves it to the executors.
    path = os.path.join(tempfile.mkdtemp(), "eventrate_operators.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    _sent.add(sc.applicationId)
