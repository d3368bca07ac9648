"""Numbers that a model gives, asked for once: a table of them under keys of the content.

Every run appends what was missing as one more version; of a key that several versions
hold the last one counts.  Versions are merged when there are many.  A run that fails
leaves no version behind, and one that is repeated asks only for what is still missing.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources.readers import exists

#: Versions are merged when there are more.
MOST_VERSIONS = 16
_SCHEMA = "key string, reward double, version int"


def content_key(*parts: Column) -> Column:
    """A digest that tells apart texts, nulls and where one text ends and the next begins."""
    return F.sha2(F.to_json(F.array(*(p.cast("string") for p in parts))).cast("binary"), 256)


class RewardTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _versions(self) -> list[int]:
        if not exists(self.spark, self.path):
            return []
        hpath = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        found = hpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hpath)
        names = (s.getPath().getName() for s in found)
        done = (n for n in names if n.startswith("version=") and exists(self.spark, f"{self.path}/{n}/_SUCCESS"))
        return sorted(int(n.partition("=")[2]) for n in done)

    def rows(self) -> DataFrame:
        """(key, reward): the last reward of each key."""
        parts = [self.spark.read.schema("key string, reward double").parquet(f"{self.path}/version={v}").withColumn("version", F.lit(v)) for v in self._versions()]
        every = self.spark.createDataFrame([], _SCHEMA)
        for p in parts:
            every = every.unionByName(p)
        return every.groupBy("key").agg(F.max_by("reward", "version").alias("reward"))

    def put(self, rewards: DataFrame) -> None:
        """Adds (key, reward) as a new version; of a key that comes twice the greater reward counts."""
        versions = self._versions()
        new = rewards.groupBy("key").agg(F.max("reward").alias("reward"))
        if len(versions) >= MOST_VERSIONS:
            new = self.rows().join(new.select("key"), "key", "left_anti").unionByName(new)
        place = f"{self.path}/version={(versions or [0])[-1] + 1}"
        new.write.mode("overwrite").parquet(place)
        if len(versions) >= MOST_VERSIONS:
            jvm = self.spark.sparkContext._jvm
            for v in versions:
                old = jvm.org.apache.hadoop.fs.Path(f"{self.path}/version={v}")
                old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    def rewarded(self, df: DataFrame, parts: list[str], score: Callable[[list[tuple]], list[float]], output: str = "reward", batch: int = 16) -> DataFrame:
        """Adds the reward of each row's ``parts``; ``score`` is asked, in batches on the executors,
        for contents that the table has no reward of, each once."""
        key = "reward_key"
        while key in df.columns:
            key += "_"
        keyed = df.withColumn(key, content_key(*(F.col(f"`{p}`") for p in parts)))
        missing = keyed.select(F.col(key).alias("key"), *(F.col(f"`{p}`").cast("string").alias(f"p{k}") for k, p in enumerate(parts))).dropDuplicates(["key"]).join(self.rows(), "key", "left_anti")

        def ask(batches):
            for rows in batches:
                for lo in range(0, rows.num_rows, batch):
                    some = rows.slice(lo, batch)
                    texts = list(zip(*(some.column(k + 1).to_pylist() for k in range(len(parts))), strict=True))
                    yield pa.RecordBatch.from_arrays([some.column(0), pa.array(score(texts), pa.float64())], ["key", "reward"])

        if not missing.isEmpty():
            self.put(missing.mapInArrow(ask, "key string, reward double"))
        return keyed.join(self.rows().select(F.col("key").alias(key), F.col("reward").alias(output)), key, "left").drop(key)
