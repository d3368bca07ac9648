"""Line deduplication over levelled sorted runs of line hashes.

The documents come in batches of falling id ranges.  A batch's line keys (128-bit
hashes) are counted and merge-joined against the runs so far: keys that no run
holds (the anti-join) enter the batch's own sorted run with the largest document
id holding them, keys that some run holds add only their count.  A level with
``fanout`` runs is compacted into one run of the next level.  At the end the runs
tell, for each key, in how many documents it occurs and which document keeps it.

Defined results: a null or empty text is one empty line; a document id on several
rows counts once per key and each of its rows is filtered alike; rows with a null
id count for nothing and lose nothing; an empty table gives an empty table; extra
columns are not carried by ``line_dedup`` and are kept by ``keep_lines``.  Only keys of at least ``min_chars`` code points after
stripping are ever dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corvane.llm._shared import delete_path, shared_path, slices, small_batches, staged

#: The signs stripped from both ends of a line.
STRIPPED = " \t\n\x0b\x0c\r"

KEY = ["h1", "h2"]
SALTS = 8


def line_key(line: str, min_chars: int) -> bytes | None:
    """16-byte hash of the stripped line with A-Z lower-cased; None if it is too short."""
    line = line.strip(STRIPPED)
    return xxhash.xxh3_128_digest(line.encode().lower()) if len(line) >= min_chars else None


class LineRuns:
    """Levelled sorted runs of (h1, h2, n_docs, keep); keep is null in a count-only row."""

    def __init__(self, spark, folder: str, fanout: int = 3):
        self.spark, self.folder, self.fanout = spark, folder, fanout
        self.levels: list[list[str]] = []
        self.written = 0

    def _write(self, run: DataFrame, level: int) -> None:
        path = f"{self.folder}/run-{self.written:05d}-level-{level}"
        self.written += 1
        run.select(*KEY, "n_docs", "keep").sortWithinPartitions(*KEY).write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def rows(self, paths: list[str] | None = None) -> DataFrame | None:
        paths = [p for level in self.levels for p in level] if paths is None else paths
        return self.spark.read.schema("h1 long, h2 long, n_docs long, keep long").parquet(*paths) if paths else None

    def _merged(self, paths: list[str] | None = None) -> DataFrame:
        return self.rows(paths).groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("keep").alias("keep"))

    def add(self, batch: DataFrame) -> None:
        """batch: (h1, h2, n_docs, keep), one row a key, of ids below all before."""
        before = self.rows()
        if before is not None:
            known = before.where("keep is not null").select(*KEY, F.lit(True).alias("known"))
            batch = batch.join(known, KEY, "left").withColumn("keep", F.expr("if(known, null, keep)"))
        self._write(batch, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._write(self._merged(old), level + 1)
            for path in old:
                delete_path(self.spark, path)
            level += 1

    def frequent(self, min_docs: int) -> DataFrame:
        return self._merged().where(F.col("n_docs") >= min_docs)


def _bounds(docs: DataFrame, batches: int) -> list[int]:
    """Ids that cut the documents into batches of about equal size."""
    cuts = docs.agg(F.percentile_approx("id", [i / batches for i in range(1, batches)], 1000).alias("c")).first()["c"] if batches > 1 else []
    return sorted(set(cuts or []))


def _deduped(df: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int, batches: int, fanout: int, carry: list[str]) -> DataFrame:
    """(id, text, n_lines, n_dropped, carried): carried is a struct of the columns named in ``carry``."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carried") if carry else F.lit(None).cast("int").alias("carried"))
    docs = rows.select("id", "text")
    cuts = np.array(_bounds(docs, batches), np.int64)

    def keys(parts):
        for part in slices(parts):
            digests, ids = [], []
            for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if text and i is not None:
                    own = {k for k in (line_key(x, min_chars) for x in text.split("\n")) if k}
                    digests.extend(own)
                    ids.extend([i] * len(own))
            pair = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            ids = np.array(ids, np.int64)
            batch = len(cuts) - np.searchsorted(cuts, ids, side="left")
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), pa.array(ids), pa.array(batch.astype(np.int32))], ["h1", "h2", "id", "batch"])

    path = shared_path(spark, "line_keys")
    with small_batches(spark):
        docs.mapInArrow(keys, "h1 long, h2 long, id long, batch int").write.partitionBy("batch").parquet(path)
    pairs = spark.read.schema("h1 long, h2 long, id long, batch int").parquet(path)
    repeated = docs.where("id is not null").groupBy("id").count().where("count > 1").limit(1).count() > 0
    if repeated:
        pairs = pairs.dropDuplicates([*KEY, "id", "batch"])

    runs = LineRuns(spark, shared_path(spark, "line_runs"), fanout)
    for b in range(len(cuts) + 1):
        runs.add(pairs.where(F.col("batch") == b).groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("id").alias("keep")))
    frequent = staged(runs.frequent(min_docs), "frequent_lines")

    # a line may be in a third of all documents: both sides are salted by document
    salted = frequent.select(*KEY, "keep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    lost = (
        pairs.withColumn("salt", F.pmod("id", F.lit(SALTS)).cast("int"))
        .join(salted, [*KEY, "salt"])
        .where("id <> keep")
        .groupBy("id")
        .agg(F.collect_list(F.struct("h1", "h2")).alias("lost"))
    )

    def cut(parts):
        for part in slices(parts):
            kept, n_lines, n_dropped = [], [], []
            for text, gone in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                lines = (text or "").split("\n")
                if gone:
                    gone = {np.array([g["h1"], g["h2"]], "<i8").tobytes() for g in gone}
                    stay = [x for x in lines if line_key(x, min_chars) not in gone]
                else:
                    stay = lines
                kept.append("\n".join(stay))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), part.column(3)], ["id", "text", "n_lines", "n_dropped", "carried"])

    # per document only its own lost keys: the small side is hashed, texts are not sorted
    joined = rows.join(lost.hint("shuffle_hash"), "id", "left").select("id", "text", "lost", "carried")
    schema = StructType([*docs.schema, StructField("n_lines", LongType()), StructField("n_dropped", LongType()), rows.schema["carried"]])
    return joined.mapInArrow(cut, schema)


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 3) -> DataFrame:
    """(id, text, n_lines, n_dropped): lines whose key is in at least ``min_docs``
    documents go, except in the largest id holding the key; the rest is joined by LF."""
    out = _deduped(df, id_col, text_col, min_chars, min_docs, batches, fanout, [])
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_lines", "n_dropped")


def keep_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 3) -> DataFrame:
    """The rows and columns of ``df`` with the lines gone from the text, whatever the columns are named."""
    rest = [c for c in df.columns if c != text_col]
    out = _deduped(df, id_col, text_col, min_chars, min_docs, batches, fanout, rest)
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col("carried").getField(c).alias(c) for c in df.columns))
