"""Files that tasks write and read themselves, in the store that a folder's URI names."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as a URI of the store in which Spark reads it; a plain path is one of Spark's default store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def file_system(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of a folder named by a URI or a plain path."""
    if "://" in folder or folder.startswith("file:"):
        return arrow_fs.FileSystem.from_uri(folder)
    return arrow_fs.LocalFileSystem(), folder


@contextmanager
def new_file(folder: str, name: str) -> Iterator[arrow_fs.NativeFile]:
    """Stream of a file that appears under ``name`` once it is complete.

    A task that is run again writes a draft of its own and replaces the file by an equal one.
    """
    store, root = file_system(folder)
    store.create_dir(root, recursive=True)
    draft = f"{root}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        yield out
    store.move(draft, f"{root}/{name}")
