"""An extra beyond batch: JSON lines as a stream, appended once a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.operators.relational import not_done
from corvane.sources.readers import exists


def _begin(spark: SparkSession, path: str) -> bool:
    """Marks that something begins; whether it had begun before."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return not hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).createNewFile(hpath)


def append_new(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str = "repo_id"):
    """Starts a query that appends rows of keys the Parquet target does not hold yet.

    Keys that came by are kept as the stream's state, so a batch costs what its rows cost,
    however large the target is.  Keys that a target had before its first stream are noted
    once, beside the checkpoint.  Only a batch that had begun before, as after a kill, is held
    against the target, since it may have been written in part.  Rows without a key count as
    rows of one key.
    """
    known = f"{checkpoint}-known"
    if not exists(spark, checkpoint) and exists(spark, target):
        spark.read.parquet(target).select(key).distinct().write.mode("overwrite").parquet(known)
    before = exists(spark, known)

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = not_done(batch, spark.read.parquet(known), key) if before else batch
        if _begin(spark, f"{checkpoint}-begun/{epoch}") and exists(spark, target):
            fresh = not_done(fresh, spark.read.schema(batch.schema).parquet(target), key)
        fresh.write.mode("append").parquet(target)

    rows = spark.readStream.schema(schema).json(source).dropDuplicates([key])
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
