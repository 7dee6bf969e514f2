"""Where tables between steps are kept: a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

_unset: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a folder in the warehouse, or on this machine if executors are threads of the driver."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        app, master = spark.sparkContext.applicationId, spark.sparkContext.master
        if app not in _unset:
            alone = master == "local" or master.startswith("local[")
            _unset[app] = "file://" + tempfile.mkdtemp(prefix="corpusmill-") if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + f"/_scratch-{app}"
        folder = _unset[app]
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/corpusmill/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> bool:
    """Deletes a folder by Spark's file system, whatever store it is in."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession, name: str):
    """A folder for the length of a block."""
    path = scratch_path(spark, name)
    try:
        yield path
    finally:
        removed(spark, path)
