"""Corpus pipeline: quality, line dedup, near-duplicates, decontamination, BPE ids.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as
Parquet and read again as the next stage's documents.  All but the last return the
columns of ``documents``; the last returns the token ids of what is left.  A stage plans
in a session of its own, a clone of the caller's with few rows an Arrow batch, so nothing
that it sets stays in the caller's session.

Only ``doc_id``, ``text`` and, for the models' language, ``lang`` are read; every other
column is carried as it is, whatever its name, but ``n_chars``, which follows the text.
What each stage does with nulls, empty and long texts, ties and repeated rows stands in
its docstring.  Texts are read whole at any length.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe_codec, decontamination, kneser_ney, line_dedup, ngram_jaccard
from corvane.llm._shared import staged

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")

#: Whole pipelines of a learned model and near-duplicate groups can't be put in SQL.
ORACLE_SQL = None

#: Rows of an Arrow batch: whole texts are held in each JVM and worker.
BATCH_ROWS = 500


def _few_rows(docs: DataFrame) -> DataFrame:
    """``docs`` in a clone of its session that hands few rows at once to Python."""
    spark = docs.sparkSession
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    plan = docs._jdf.queryExecution().logical()
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, plan), own)


def _table(docs: DataFrame, sf_dir: str, name: str) -> DataFrame:
    return docs.sparkSession.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are rejected; a null or rare language takes the pooled model;
    perplexities at a limit pass; each row of a repeated id is judged by its own text;
    without labelled trusted text every text that is not empty passes.
    """
    docs = _few_rows(docs)
    return kneser_ney.keep_good(docs, kneser_ney.fit(docs, _table(docs, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines repeated in many documents go; n_chars follows the text.

    No row goes.  A null text becomes the empty text; the largest id holding a line keeps
    it; rows that share an id count once for a line and are cut alike; a row without an id
    counts for nothing and loses nothing.
    """
    docs = _few_rows(docs)
    out = line_dedup.keep_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one of the smallest id.

    A row goes only when another row of its own group stays.  Rows without an id come last
    in a group; rows that share an id are told apart by their texts; a row given twice, id
    and text, stays once; rows without words are in no group and stay.
    """
    return ngram_jaccard.keep_first(_few_rows(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, also with its parts reordered, go.

    Null and empty texts stay; every row is judged by its own text, whatever its id; an
    empty benchmark and items of fewer than five words take nothing away.
    """
    docs = _few_rows(docs)
    return decontamination.keep_clean(docs, _table(docs, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digests of the ids and of the text read back.

    A row for each row, without an id too; a null text is the empty text of no tokens.
    """
    out = bpe_codec.encode_decode(_few_rows(docs), BYTE_BPE)
    return out.select("doc_id", bpe_codec.n_ids(F.col("ids")).alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("decontamination", decontaminate), ("bpe_ids", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
