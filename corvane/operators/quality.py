"""Repository quality: per-file counters to per-repository ratios and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import scoring, text
from corvane.operators.relational import top_per_group

COUNTERS = ("functions", "classes", "public_functions", "public_classes")


def repo_metrics(files: DataFrame, repo: str = "repo_id") -> DataFrame:
    """Sums and guarded ratios of file metrics (total_*/documented_* counters,
    doc_lengths, line counts, has_meaningful_comment) by repository."""
    sums = [F.sum(f"{p}_{c}").alias(f"{p}_{c}") for c in COUNTERS for p in ("total", "documented")]
    sums += [F.sum(c).alias(c) for c in ("total_code_lines", "total_comment_lines", "meaningful_comment_lines")]
    words = F.aggregate("doc_lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    sums += [F.sum(words).alias("__w"), F.sum(F.greatest(F.size("doc_lengths"), F.lit(0))).alias("__d"), F.count_if("has_meaningful_comment").alias("files_with_meaningful_comments"), F.count("*").alias("total_core_files")]
    out = files.groupBy(repo).agg(*sums)
    for c in COUNTERS:
        name = {"functions": "function", "classes": "class", "public_functions": "public_function", "public_classes": "public_class"}[c]
        out = out.withColumn(f"{name}_doc_coverage", scoring.ratio(F.col(f"documented_{c}"), F.col(f"total_{c}")))
    out = out.withColumn("avg_doc_length_tokens", scoring.ratio(F.col("__w"), F.col("__d"))).drop("__w", "__d")
    out = out.withColumn("comment_density", scoring.ratio(F.col("total_comment_lines"), F.col("total_code_lines")))
    out = out.withColumn("meaningful_comment_density", scoring.ratio(F.col("meaningful_comment_lines"), F.col("total_code_lines")))
    return out.withColumn("meaningful_comment_file_ratio", scoring.ratio(F.col("files_with_meaningful_comments"), F.col("total_core_files")))


def core_density(files: DataFrame, repo: str = "repo_id", path: str = "file_path") -> DataFrame:
    return files.groupBy(repo).agg(F.coalesce(F.avg(text.is_core_file(F.col(path)).cast("double")), F.lit(0.0)).alias("core_density"))


def commit_metrics(commits: DataFrame, core_files: DataFrame, most: int = 40, repo: str = "repo_id") -> DataFrame:
    """commits: repo, sha, ts, message, files array<string>; core_files: repo, file_path.
    The newest commits count; averages only over those that touch core files."""
    newest = top_per_group(commits, repo, most, F.desc("ts"), F.desc("sha"))
    touched = newest.select(repo, "sha", F.explode("files").alias("file_path")).join(core_files.select(repo, "file_path"), [repo, "file_path"], "left_semi").distinct()
    covered = touched.groupBy(repo).agg(F.count_distinct("file_path").alias("n_touched"))
    core = touched.select(repo, "sha").distinct().withColumn("core", F.lit(True))
    per = newest.join(core, [repo, "sha"], "left").select(repo, F.coalesce("core", F.lit(False)).alias("core"), text.count_tokens(text.text_or_empty(F.col("message"))).alias("n"), text.is_telling_commit(F.col("message")).cast("double").alias("telling"), text.keyword_hits(F.coalesce("message", F.lit(""))).alias("hits"))
    mean = lambda c: F.coalesce(F.avg(F.when(F.col("core"), F.col(c))), F.lit(0.0))
    out = per.groupBy(repo).agg(F.count("*").alias("n_commits_seen"), F.count_if("core").alias("n_commits_touching_core_files"), mean("n").alias("avg_commit_message_length_tokens"), mean("telling").alias("non_trivial_commit_fraction"), mean("hits").alias("keyword_bonus_avg"))
    total = core_files.groupBy(repo).agg(F.count("*").alias("n_core"))
    out = out.join(covered, repo, "left").join(total, repo, "left")
    return out.withColumn("core_file_commit_coverage", F.coalesce(scoring.ratio(F.coalesce("n_touched", F.lit(0)), F.coalesce("n_core", F.lit(0))), F.lit(0.0))).drop("n_touched", "n_core")


def repo_scores(metrics: DataFrame, commits: DataFrame | None = None, repo: str = "repo_id") -> DataFrame:
    out = metrics
    commit = None
    if commits is not None:
        c = F.col
        scored = commits.select(repo, scoring.commit_score(c("non_trivial_commit_fraction"), c("avg_commit_message_length_tokens"), c("n_commits_touching_core_files"), c("keyword_bonus_avg"), c("core_file_commit_coverage")).alias("commit_score"))
        out, commit = out.join(scored, repo, "left"), F.col("commit_score")
    out = out.withColumn("api_doc_score", scoring.api_score(F.col("public_function_doc_coverage"), F.col("function_doc_coverage"), F.col("public_class_doc_coverage"), F.col("class_doc_coverage"), F.col("avg_doc_length_tokens")))
    out = out.withColumn("comment_score", scoring.comment_score(F.col("meaningful_comment_file_ratio"), F.col("meaningful_comment_density"), F.col("comment_density")))
    out = out.withColumn("final_score", scoring.final_score(F.col("api_doc_score"), F.col("comment_score"), commit))
    return out.withColumn("quality_bucket", scoring.bucket(F.col("final_score")))


def repo_records(docs: DataFrame, density: DataFrame, commits: DataFrame, scores: DataFrame, repo: str = "repo_id") -> DataFrame:
    """One nested record a repository: the columns of ``docs``, core_density, and what ``commits``
    and ``scores`` have as structs.  Repositories without commits have a null struct."""
    nested = lambda df, name: df.select(repo, F.struct(*(F.col(f"`{c}`") for c in df.columns if c != repo)).alias(name))
    return docs.join(density.select(repo, "core_density"), repo, "left").join(nested(commits, "commit_metrics"), repo, "left").join(nested(scores, "scores"), repo, "left")
