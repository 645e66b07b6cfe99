"""Sends this package to the Python workers, which may not have the repository on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile

import eventrate
from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's modules to the session's files, once."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    top = os.path.dirname(os.path.abspath(eventrate.__file__))
    # Read from here by the driver only; Spark serves it to the executors.
    path = os.path.join(tempfile.mkdtemp(), "eventrate_modules.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    _sent.add(sc.applicationId)
