"""The shared scratch folder of a session."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder named in spark.checkpoint.dir (a temp folder only where it is unset), deleted at exit."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="tickloom-"))
        root = _own[0]
    path = f"{root.rstrip('/')}/tickloom-{uuid.uuid4().hex}"
    atexit.register(_delete, path)
    return f"{path}/{name}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: computed once, and nothing to compute again when an executor is lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(path: str) -> None:
    try:
        fs, place = open_fs(path)
        fs.delete_dir(place)
    except Exception:  # gone already, or its store is
        pass


def open_fs(path: str):
    """The pyarrow file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
