"""Where tables that queries share lie: the folder of spark.checkpoint.dir."""

from __future__ import annotations

import hashlib
import tempfile

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset and all tasks run in this very process, as in tests, a temporary
    folder is set; on a cluster that is an error, as executors wouldn't meet there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if spark.conf.get("spark.app.id") not in _own:
        _own[spark.conf.get("spark.app.id")] = tempfile.mkdtemp(prefix="retrova-")
    return _own[spark.conf.get("spark.app.id")]


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def version(spark: SparkSession, path: str) -> str:
    """A name for a file or folder as it is now, from its path, size and times."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    said = f"{fs.makeQualified(p).toString()} {fs.getContentSummary(p).getLength()} {fs.getFileStatus(p).getModificationTime()}"
    return hashlib.sha256(said.encode()).hexdigest()[:24]
