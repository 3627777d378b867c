"""Folders for tables that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """An empty folder of its own in ``spark.checkpoint.dir``, which goes when the application ends; in local mode a temporary one where that is unset."""
    named, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not named and master.partition("[")[0] != "local":
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    path = f"{(named or tempfile.mkdtemp(prefix='verdant-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(jpath)
    store.deleteOnExit(jpath)
    return path
