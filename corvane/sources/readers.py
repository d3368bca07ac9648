"""Sources: JSON lines, JSON objects and arrays, landed pages, archives, caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvane.functions.text import ENTRY, lines, strip
from corvane.sources import archives, checked


def exists(spark: SparkSession, path: str) -> bool:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath)


def _struct(schema: str | StructType) -> StructType:
    return StructType.fromDDL(schema) if isinstance(schema, str) else schema


def json_lines(spark: SparkSession, path: str, schema, missing_ok: bool = False, skip_bad: bool = False) -> DataFrame:
    """Blank lines are skipped, bad ones fail (or are dropped, for resuming); a missing
    file is empty if that is allowed."""
    schema = _struct(schema)
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if skip_bad else "FAILFAST").json(path)


def json_document(spark: SparkSession, path: str, schema, missing_ok: bool = True) -> DataFrame:
    """One JSON value a file: an object, or an array of rows."""
    schema = _struct(schema)
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)


def json_map(spark: SparkSession, path: str, value_schema: str, key: str = "name", value: str = "value") -> DataFrame:
    """An object of objects (or of numbers) as rows of key and value."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value_schema}>")).alias(key, value))


def json_any(spark: SparkSession, path: str, schema, required: tuple[str, ...] = ()) -> DataFrame:
    """Array, single object or JSON lines, told apart by the first signs; required columns
    must be there in every row.  A bad line, or a row of lines that lacks a column, is an
    error that names the file and the line."""
    schema = _struct(schema)
    line = F.trim("value")
    head = spark.read.text(path).where(line != "").select(F.left(line, F.lit(1)).alias("first"), F.right(line, F.lit(1)).alias("last")).limit(1).collect()
    if not head:
        raise ValueError(f"{path} is empty")
    lacking = set(required) - set(schema.names)
    if lacking:
        raise ValueError(f"schema lacks {sorted(lacking)}")
    if head[0]["first"] != "[" and head[0]["last"] == "}":
        out, errors = checked.json_lines_checked(spark, path, schema, required)
        for e in errors.orderBy("file", "line").limit(1).collect():
            raise ValueError(f"{e['file']}, line {e['line']}: {e['error']}")
        return out
    out = json_document(spark, path, schema, missing_ok=False)
    for c in required:
        out = out.withColumn(c, F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"a row lacks {c}")).cast(schema[c].dataType)))
    return out


def markdown_entries(pages: DataFrame, text_col: str = "value", marker: str = "github.com") -> DataFrame:
    """(name, link, description) of list items in landed pages that link to the marker."""
    line = pages.select(F.explode(lines(F.col(text_col))).alias("l")).select(strip(F.col("l")).alias("l"))
    out = line.select(*(strip(F.regexp_extract("l", ENTRY, k)).alias(n) for k, n in ((1, "name"), (2, "link"), (3, "description"))))
    return out.where((F.col("name") != "") & F.contains(F.lower("link"), F.lit(marker)))


def archive_texts(spark: SparkSession, path: str, needed: DataFrame | None = None) -> DataFrame:
    """(archive, file_path, text) of ZIP archives: the first path segment is dropped and
    bytes are decoded with replacement.  With ``needed`` (archive, file_path) only those
    members are read, and archives without any are skipped; what can't be read is left out
    here and told by ``archives.archive_members``."""
    return archives.archive_members(spark, path, needed).where("error is null").select("archive", "file_path", "text")


def reward_cache(spark: SparkSession, path: str) -> DataFrame:
    """(idx, reward) of a landed object of numbers with number-like keys."""
    return json_map(spark, path, "double", "k", "reward").select(F.col("k").cast("int").alias("idx"), "reward")
