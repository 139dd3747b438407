"""The work folder that driver and executors share, and access to it outside Spark's own readers and writers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset, one machine gets a temporary folder; a cluster must name one."""
    sc = spark.sparkContext
    base = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="glyphmill-"))
        base = sc.getCheckpointDir()
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one."""
    return f"{shared_folder(spark)}/glyphmill/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """End the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def file_system(uri: str):
    """(Arrow file system, path in it) of a location; Hadoop's names of object stores are taken as Arrow's."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), uri
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    if scheme == "dbfs":
        return fs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}.get(scheme, scheme) + ":" + rest)


def open_output(uri: str):
    """An output stream to a new file; its folder is made."""
    system, path = file_system(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path)
