"""Helpers of the training-data operators: shared storage, Arrow plumbing."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``.

    Only where a local session names none (tests) a temporary folder is set; a cluster has to name it.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corvane-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it is deleted when the driver ends."""
    path = f"{shared_root(spark)}/corvane-{uuid.uuid4().hex}/{name}"
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hpath.getParent())
    fs.deleteOnExit(hpath.getParent())
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage
    and survives lost executors (unlike a local checkpoint or a cache)."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in upper or lower case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def record_batch(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in schema],
        schema=schema,
    )


def slices(batches, rows: int = 1000):
    """Arrow batches of at most ``rows`` rows: bounds what is held as Python objects."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def text_chunks(texts: list, limit: int = 1 << 19):
    """Cut a batch into slices of about ``limit`` characters; a text stays whole."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n + 1
    if lo < len(texts):
        yield lo, len(texts)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500):
    """Arrow batches of few rows while texts are read: they are held in each JVM and worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
