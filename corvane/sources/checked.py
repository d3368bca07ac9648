"""Reading that tells what went wrong: bad lines and rows as rows of (file, line, stage, error).

Good rows are read by Spark alone, in one pass.  Where errors are asked for, the lines of
each file's splits are counted, and a line's number is its place in its split and the
number of lines in the splits before; lines themselves are never shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

PARSE, REQUIRED = "parse", "required"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _judged(lines: DataFrame, schema: StructType, required: tuple[str, ...]) -> DataFrame:
    """Adds ``row``, ``stage`` and ``error`` to lines that are not blank."""
    bad = "_bad_line"
    while bad in schema.names:
        bad += "_"
    whole = StructType([*schema.fields, StructField(bad, StringType())])
    out = lines.where(~F.col("value").rlike(r"\A\s*\z")).withColumn("row", F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}))
    broken = F.col("row").isNull() | F.col("row").getField(bad).isNotNull()
    lacking = F.filter(F.array(*(F.when(F.col("row").getField(c).isNull(), c) for c in required)), lambda x: x.isNotNull()) if required else F.array().cast("array<string>")
    stage = F.when(broken, PARSE).when(F.size(lacking) > 0, REQUIRED)
    error = F.when(broken, "no row of the schema").when(F.size(lacking) > 0, F.concat(F.lit("lacks "), F.array_join(lacking, ", ")))
    return out.withColumn("stage", stage).withColumn("error", error)


def _numbered(lines: DataFrame) -> DataFrame:
    """Adds the place of each line in its split."""

    def run(batches):
        split, at = None, 0
        for batch in batches:
            own = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            places = np.empty(len(own), np.int64)
            for i, x in enumerate(own):
                split, at = x, at + 1 if x == split else 0
                places[i] = at
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places)], ["value", "file", "block", "place"])

    return lines.mapInArrow(run, "value string, file string, block long, place long")


def json_lines_checked(spark: SparkSession, path: str, schema: str | StructType, required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The good rows of JSON lines, and a row (file, line, stage, error, value) for every bad one:
    a line that is no row of the schema, or a row that lacks a required column."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    judged = _judged(_lines(spark, path), schema, required)
    good = judged.where("stage is null").select(*(F.col("row").getField(f.name).alias(f.name) for f in schema))
    numbered = _numbered(_lines(spark, path))
    sizes = numbered.groupBy("file", "block").agg((F.max("place") + 1).alias("n"))
    before = sizes.select("file", "block", (F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).alias("before"))
    bad = _judged(numbered, schema, required).where("stage is not null").join(before, ["file", "block"])
    return good, bad.select("file", (F.col("before") + F.col("place") + 1).alias("line"), "stage", "error", "value")

