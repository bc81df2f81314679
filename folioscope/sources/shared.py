"""Paths in the folder that driver and executors share: spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path, deleted when the session's JVM ends. Only a local master may do without the setting (tests)."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not told:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="folioscope-")
            atexit.register(shutil.rmtree, _own[app], True)
        told = "file://" + _own[app]
    path = f"{told.rstrip('/')}/folioscope/{app}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path
