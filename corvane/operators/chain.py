"""A draft and an improvement by two model slots, batch by batch, that goes on after a kill.

Rows are dealt to batches by a hash of their key.  A batch is drafted, gated, improved and
written to its own folder, which a repeated run replaces; then its line (batch, rows,
checksum) is committed to the log.  A run that starts again reads the log, leaves batches
whose folders agree with their lines, and does the others: no row is lost or comes twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import has_words
from corvane.operators.model import complete, with_fallback
from corvane.sources.readers import exists

_LOG = "batch int, n_rows long, checksum long"


def _told(rows: DataFrame) -> tuple[int, int]:
    """Number of rows and the sum of their hashes."""
    found = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*rows.columns).bitwiseAND(0xFFFFFFFF)), F.lit(0)).alias("sum")).first()
    return found["n"], found["sum"]


def committed(spark: SparkSession, path: str) -> dict[int, tuple[int, int]]:
    """The log: batches with their rows and checksums; one line a batch."""
    if not exists(spark, f"{path}/log"):
        return {}
    return {r["batch"]: (r["n_rows"], r["checksum"]) for r in spark.read.schema(_LOG).json(f"{path}/log").collect()}


def drafted_and_improved(df: DataFrame, key: str, prompt: str, draft: Callable[[list[str]], list[str]], improve: Callable[[list[str]], list[str]], path: str, batches: int = 8, words: int = 8) -> DataFrame:
    """Rows with draft, improved and final_answer: drafts of fewer than ``words`` words end there
    (their rows go), improvements of fewer fall back to the draft.  ``batches`` is part of the
    path's state: a run that goes on needs the same number and the same rows."""
    spark = df.sparkSession
    dealt = df.withColumn("batch", F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string")), F.lit(batches)).cast("int"))
    done = committed(spark, path)
    schema = None
    for k in range(batches):
        place = f"{path}/rows/batch={k}"
        if k in done and exists(spark, f"{place}/_SUCCESS"):
            continue
        own = dealt.where(F.col("batch") == k).drop("batch")
        first = complete(own, prompt, draft, "draft").where(has_words(F.col("draft"), words))
        asked = first.withColumn("ask", F.concat_ws("\n\n", F.col(f"`{prompt}`"), F.col("draft")))
        whole = with_fallback(complete(asked, "ask", improve, "improved").drop("ask"), "draft", "improved", words=words)
        whole.write.mode("overwrite").parquet(place)
        schema = whole.schema
        n, checksum = _told(spark.read.schema(schema).parquet(place))
        spark.createDataFrame([(k, n, checksum)], _LOG).coalesce(1).write.mode("append").json(f"{path}/log")
    found = spark.read.parquet(f"{path}/rows")
    for k, told in committed(spark, path).items():
        if _told(found.where(F.col("batch") == k).drop("batch")) != told:
            raise ValueError(f"batch {k} of {path} is not what was committed")
    return found
