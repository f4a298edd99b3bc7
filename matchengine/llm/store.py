"""Tables and files that all executors and the driver share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path below the cluster's ``spark.checkpoint.dir``.

    Only where that setting is absent and all of Spark is one process, as in tests, a folder of this machine is set.
    """
    root = spark.conf.get(SETTING, None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"{SETTING} has to name a folder that the driver and all executors of {master} share")
        root = "file://" + tempfile.mkdtemp(prefix="matchengine-")
        spark.conf.set(SETTING, root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes ``df`` as Parquet in a shared folder and reads it: lineage ends there and lost executors cost nothing."""
    path = shared_dir(df.sparkSession, name)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(path: str):
    """(pyarrow file system, path in it) of a shared folder, for workers."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path)


def local_path(path: str) -> str | None:
    """The path if it is mounted on every machine, else None."""
    from pyarrow import fs

    store, inside = filesystem(path)
    return inside if isinstance(store, fs.LocalFileSystem) else None


def put(path: str, data: bytes) -> None:
    """Writes a file whole or not at all; attempts of one task may meet."""
    store, inside = filesystem(path)
    store.create_dir(os.path.dirname(inside), recursive=True)
    part = f"{inside}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, inside)
