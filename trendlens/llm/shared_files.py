"""Files that tasks write into the shared folder and later tasks read back.

A task names its files freshly for every attempt and returns them as manifest
rows; only files of the stored manifest count, so a repeated or speculative
attempt leaves at most a file nobody reads. The folder may be any that
``pyarrow.fs`` opens by URI (file, hdfs, s3, gs) or a plain path.
"""
from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from ..session import scratch_path


def _open(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


def new_folder(spark: SparkSession, name: str) -> str:
    uri = scratch_path(spark, name)
    # Spark writes file:/x where the URI standard has file:///x
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def create(folder: str, suffix: str):
    """(uri, open output stream) of a new file of this attempt."""
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    return f"{folder}/{name}", system.open_output_stream(f"{path}/{name}", compression=None)


def open_file(uri: str):
    """A seekable input file."""
    system, path = _open(uri)
    return system.open_input_file(path)
