"""The folder for what Spark jobs hand on to each other."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: ``spark.checkpoint.dir``, or what ``setCheckpointDir`` named.

    In local mode, where driver and executor are one process, an own folder serves if neither is set; on a cluster
    their absence is an error, since executors would write to folders of their own.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base:
        named = context._jsc.sc().getCheckpointDir()
        base = named.get() if named.isDefined() else None
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="quarrylens-")
    return _OWN[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which is removed when the session's file system is closed."""
    top = f"{shared_dir(spark)}/quarrylens-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{top}/{name}"
