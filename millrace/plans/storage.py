"""Tables in the folder that all executors share: written once, read by later steps, removed at the end."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset a local master gets a temporary folder; on a
    cluster, whose executors would each write to a disk of their own, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _at(spark: SparkSession, path: str):
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()), where


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in a folder of the application's own, which goes when the application ends."""
    key = f"{spark.sparkContext.applicationId} {shared_dir(spark)}"
    if key not in _ROOTS:
        root = f"{shared_dir(spark)}/millrace-{spark.sparkContext.applicationId}"
        files, where = _at(spark, root)
        files.mkdirs(where)
        files.deleteOnExit(where)
        _ROOTS[key] = root
    return f"{_ROOTS[key]}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once and read back, so that lost executors repeat no earlier work."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def discard(*frames: DataFrame) -> None:
    """Removes the files of stored tables that no later plan reads."""
    for df in frames:
        if path := df.__dict__.pop("stored_at", None):
            files, where = _at(df.sparkSession, path)
            files.delete(where, True)
