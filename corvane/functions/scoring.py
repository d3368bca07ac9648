"""Scores, buckets, categories and rewards as Spark columns; literals are doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import strip

#: Marks of a leaked prompt.
LEAKS = ("### system", "### code", "### documentation", "### question", "### answer", "system:", "question:", "documentation:", "code:", "http://", "https://", "source:")
#: How many training samples each category gives.
QUOTAS = {"docstring-function": 700, "docstring-class": 700, "comment-function": 2000, "comment-class": 2000, "commit-message": 2000, "csn": 700}


def ratio(n: Column, d: Column) -> Column:
    return F.when(d != 0, n.cast("double") / d.cast("double")).otherwise(F.lit(0.0))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def capped(x: Column, cap: float) -> Column:
    return clamp01(x / F.lit(float(cap))) if cap > 0 else F.lit(0.0)


def commit_score(fraction: Column, length: Column, n: Column, hits: Column, coverage: Column) -> Column:
    return 0.35 * fraction + 0.25 * capped(length, 12) + 0.20 * capped(n, 200) + 0.10 * capped(hits, 2) + 0.10 * coverage


def api_score(public_functions: Column, functions: Column, public_classes: Column, classes: Column, doc_length: Column) -> Column:
    return 0.35 * public_functions + 0.15 * functions + 0.20 * public_classes + 0.10 * classes + 0.20 * capped(doc_length, 40)


def comment_score(file_ratio: Column, meaningful_density: Column, density: Column) -> Column:
    return 0.45 * file_ratio + 0.35 * capped(meaningful_density, 0.10) + 0.20 * capped(density, 0.20)


def final_score(api: Column, comment: Column, commit: Column | None = None) -> Column:
    doc = 0.70 * api + 0.30 * comment
    return doc if commit is None else F.when(commit.isNull(), doc).otherwise(0.65 * doc + 0.35 * commit)


def bucket(score: Column) -> Column:
    return F.when(score >= 0.75, "high").when(score >= 0.55, "medium").when(score >= 0.35, "borderline").otherwise("reject")


def category(source: Column, entity: Column) -> Column:
    doc, comment = source.isin("docstring", "javadoc"), source == "inline_comment"
    return (
        F.when(doc & (entity == "function"), "docstring-function").when(doc & (entity == "class"), "docstring-class")
        .when(comment & (entity == "function"), "comment-function").when(comment & (entity == "class"), "comment-class")
        .when(source == "commit_message", "commit-message")
    )


def leakage_penalty(text: Column) -> Column:
    return F.lit(0.25) * F.size(F.filter(F.array(*map(F.lit, LEAKS)), lambda m: F.contains(F.lower(text), m)))


def length_penalty(text: Column, free: int = 80) -> Column:
    n = F.length(strip(text))
    return F.when(n <= free, F.lit(0.0)).otherwise(F.least(F.lit(0.3), (n - free) / F.lit(300.0)))


def correctness_reward(matches: Column, pred: Column) -> Column:
    base = F.when(matches, F.lit(1.0)).otherwise(F.lit(-1.0))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), base - leakage_penalty(pred) - length_penalty(pred)))


def teacher_reward(raw: Column) -> Column:
    return F.greatest(F.lit(-5.0), F.least(F.lit(0.0), raw)) / 5.0


def total_reward(correctness: Column, teacher: Column) -> Column:
    """A missing teacher reward counts 0.0, the best there is."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 0.6 * correctness + 0.4 * F.coalesce(teacher, F.lit(0.0))))
