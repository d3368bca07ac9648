"""The opN queries of the training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe_codec, chroma_prints, conversation_repair, decontamination, filter_audit, html_layout, kneser_ney, line_dedup, ngram_jaccard, suffix_dedup, token_counts, token_files, warc_derivatives
from corvane.llm._shared import shared_path

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two derived records of every page's response record."""
    pages = warc_derivatives.responses(_table(spark, sf_dir, "pages"))
    out = warc_derivatives.derivatives(pages, "page_id")
    return out.withColumn("record_sha256", F.sha2("record", 256)).drop("record")


def op2_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_layout.rendered(_table(spark, sf_dir, "pages"))


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with their perplexities and limits."""
    docs = _table(spark, sf_dir, "documents")
    model = kneser_ney.fit(docs, _table(spark, sf_dir, "labels"))
    return kneser_ney.classify(docs, model).where("keep").select("doc_id", "lang", "perplexity", "low", "high")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_codec.encode_decode(_table(spark, sf_dir, "documents"), BYTE_BPE)
    return out.select("doc_id", bpe_codec.n_ids(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.ngram_jaccard(_table(spark, sf_dir, "documents"))


def op7_chroma_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth recording with its class and its links to all recordings."""
    table = _table(spark, sf_dir, "embeddings")
    cuts = chroma_prints.fit_cuts(chroma_prints.recordings(table), "id", "pcm")
    prints = chroma_prints.fingerprints(chroma_prints.recordings(table), cuts)
    return chroma_prints.link_counts(prints, silent=chroma_prints.silent_print(cuts)).withColumnRenamed("id", "vec_id")


def op8_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents, with the items they hold."""
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(_table(spark, sf_dir, "documents"), BYTE_BPE, shared_path(spark, "token_files"), end_id=0)
    return token_files.read_token_files(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), BYTE_BPE, limit=512)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents")).drop("kept")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired."""
    return conversation_repair.repaired(_table(spark, sf_dir, "conversations"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_warc_derivatives, op2_html_layout, op3_kneser_ney, op4_line_dedup, op5_bpe_codec, op6_ngram_jaccard, op7_chroma_prints, op8_string_tiling, op9_token_files, op10_token_counts, op11_suffix_dedup, op12_conversation_repair, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op12_conversation_repair": conversation_repair.SQL, "op13_filter_audit": filter_audit.SQL}
