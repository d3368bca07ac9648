"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the session's ``spark.checkpoint.dir``, deleted when the driver ends.

    Only where a local session names none (tests) is a temporary folder set; a cluster has to name it.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corvane-"))
        root = sc.getCheckpointDir()
    own = sc._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/corvane-{uuid.uuid4().hex}")
    fs = own.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(own)
    fs.deleteOnExit(own)
    return fs.makeQualified(own).toString() + f"/{name}"
