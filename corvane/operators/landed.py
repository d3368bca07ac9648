"""Landed pages of services (package index, metadata, commits) and external samples as plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import intervals, ranks
from corvane.operators.relational import top_per_group, uniform_sample

#: Where a package names its repository and its changelog, in order.
LINK_KEYS = ("Source", "Code", "Home", "Homepage", "Repository")
CHANGELOG_KEYS = ("Changelog", "Change Log", "Changes")


def first_packages(index: DataFrame, rank: Column, n: int = 500) -> DataFrame:
    """The first packages of a landed index."""
    return index.orderBy(rank).limit(n)


def first_filled(urls: Column, keys: tuple, marker: str = "") -> Column:
    """Of a map's values for the keys, in order, the first that is not empty and holds the marker."""
    value = [F.try_element_at(urls, F.lit(k)) for k in keys]
    return F.coalesce(*(F.when((v != "") & F.contains(F.lower(v), F.lit(marker)), v) for v in value))


def package_links(packages: DataFrame, home: str = "home_page", urls: str = "project_urls", marker: str = "github.com") -> DataFrame:
    """Adds github_link (the home page, else one of the named links) and changelog_url;
    packages without a link go."""
    page = F.when(F.contains(F.lower(F.col(home)), F.lit(marker)), F.col(home))
    out = packages.withColumn("github_link", F.coalesce(page, first_filled(F.col(urls), LINK_KEYS, marker))).withColumn("changelog_url", first_filled(F.col(urls), CHANGELOG_KEYS))
    return out.where("github_link is not null")


def language_by_url(url: Column, names: dict[str, str]) -> Column:
    """The language whose substring the page's address holds; the first one counts."""
    return F.coalesce(*(F.when(F.contains(url, F.lit(part)), F.lit(lang)) for part, lang in names.items()))


def looked_up(rows: DataFrame, landed: DataFrame, key: str, status: str = "status") -> DataFrame:
    """Rows with what a service answered for them; other answers than 200 and rows never asked for go."""
    return rows.join(landed.where(F.col(status) == 200).drop(status), key)


def complete(rows: DataFrame, *needed: str) -> DataFrame:
    """Rows whose named columns are neither null nor empty."""
    return rows.where(reduce(lambda a, b: a & b, ((F.col(c).isNotNull() & (F.col(c).cast("string") != "")) for c in needed)))


def commit_files(commits: DataFrame, details: DataFrame, repo: str = "repo_id", most: int = 300) -> DataFrame:
    """The newest commits of each repository with their details, one row a file.

    commits: repo, sha, ts, ...; details: repo, sha, status, files array<struct<...>>."""
    newest = top_per_group(commits, repo, most, F.desc("ts"), F.desc("sha"))
    found = newest.join(details.where("status = 200").drop("status"), [repo, "sha"])
    return found.select("*", F.inline("files")).drop("files")


def commit_rows(files: DataFrame, message: str = "message", patch: str = "patch", path: str = "filename") -> DataFrame:
    """Adds what a commit entity has: texts, token counts, language, and a confidence by the patch."""
    has = F.coalesce(F.length(patch) > 0, F.lit(False))
    return files.select(
        "*", F.lit("commit_message").alias("source_type"), F.col(message).alias("doc_text"), T.count_tokens(F.col(message)).alias("doc_token_count"),
        F.col(patch).alias("patch_text"), T.count_tokens(F.col(patch)).alias("patch_token_count"), T.language_of(F.col(path)).alias("language"), F.when(has, "medium").otherwise("low").alias("alignment_confidence"),
    )


def commit_entities(files: DataFrame, repo: str = "repo_id", sha: str = "sha", path: str = "filename") -> DataFrame:
    """The rows of changed files: commit_rows of files (parents array<string>, status, additions,
    deletions) under the names that entities have."""
    c = F.col
    return commit_rows(files, path=path).select(
        c(repo).alias("repo_id"), c(sha).alias("commit_sha"), F.try_element_at("parents", F.lit(1)).alias("parent_sha"), c(path).alias("file_path"), "language", "source_type", F.lit("changed_file").alias("entity_type"), c(path).alias("entity_name"),
        F.lit("commit_message").alias("doc_type"), "doc_text", "doc_token_count", "patch_text", "patch_token_count", c("status").alias("change_status"), "additions", "deletions", "alignment_confidence",
    )


def commit_pairs(rows: DataFrame, nodes: DataFrame, keys: list[str], sha: str = "sha", least: int = 5) -> DataFrame:
    """(keys, sha, uid, source, confidence, text, code): messages of ``least`` tokens with the
    patches that touch named nodes; one touched name is high, more are medium."""
    told = rows.where((F.length("patch_text") > 0) & (F.col("doc_token_count") >= least))
    ranges = told.select(*keys, sha, F.explode(T.patch_ranges(F.col("patch_text"))).alias("r")).select(*keys, sha, F.col("r.start").alias("r_start"), F.col("r.end").alias("r_end"))
    touched = intervals.meeting(ranges, nodes, keys).groupBy(*keys, sha).agg(F.count_distinct("name").alias("n"))
    out = told.join(touched, [*keys, sha])
    return out.select(
        *keys, sha, uid("commit_message", *(F.col(k) for k in (*keys, sha))).alias("uid"), F.lit("commit_message").alias("source"),
        F.when(F.col("n") == 1, "high").otherwise("medium").alias("confidence"), F.col("doc_text").alias("text"), F.col("patch_text").alias("code"),
    )


def uid(kind: str, *parts: Column) -> Column:
    """A name for a row that every run gives again."""
    return F.sha2(F.concat_ws("|", F.lit(kind), *(p.cast("string") for p in parts)).cast("binary"), 256)


def external_sample(df: DataFrame, language: str, order: Column, n: int = 2000, doc: str = "text", code: str = "code", repo: str = "repo_id", path: str = "file_path") -> DataFrame:
    """The first rows of an external table in the columns of our pairs."""
    unknown = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    first = df.orderBy(order).limit(n)  # a bounded number of rows, so one window over them
    at = (F.row_number().over(Window.orderBy(order)) - 1).cast("string")
    return first.select(
        F.concat(F.lit(f"csn-{language}-"), at).alias("uid"), unknown(repo).alias("repo_id"), unknown(path).alias("file_path"), F.lit(language.capitalize()).alias("language"),
        F.lit("docstring").alias("source"), F.lit("function").alias("entity_type"), F.lit("high").alias("confidence"), F.col(doc).alias("text"), F.col(code).alias("code"),
    )


def with_external(sample: DataFrame, external: DataFrame, key: str = "uid", n: int = 700, seed: int = 42) -> DataFrame:
    """A quota sample and at most ``n`` external rows."""
    return sample.unionByName(uniform_sample(external, n, F.col(key), seed), allowMissingColumns=True)


def bucket_report(rows: DataFrame, category: str, language: str, quotas: dict[str, int]) -> DataFrame:
    """(category, language, n, quota, taken) of each bucket with a quota, in order."""
    sizes = rows.where(F.col(category).isNotNull()).groupBy(category, language).agg(F.count("*").alias("n"))
    quota = F.coalesce(*(F.when(F.col(category) == c, F.lit(q)) for c, q in quotas.items()), F.lit(0))
    per = F.floor(quota / F.count("*").over(Window.partitionBy(category)))
    return sizes.withColumn("quota", per).where("quota > 0").withColumn("taken", F.least("n", "quota")).orderBy(category, language)


def without_private(df: DataFrame) -> DataFrame:
    """Columns whose names begin with an underscore go."""
    return df.select(*(F.col(f"`{c}`") for c in df.columns if not c.startswith("_")))


def within_budget(df: DataFrame, text: Column, most_chars: int = 73_728, most_tokens: int = 24_576, count=T.count_tokens) -> DataFrame:
    """Rows whose text is short, or else of few enough tokens; only long texts are counted."""
    return df.where(F.coalesce(F.length(text), F.lit(0)) <= most_chars).unionByName(df.where(F.length(text) > most_chars).where(count(text) <= most_tokens))


def outcome(df: DataFrame, keep: Column, *by: str) -> DataFrame:
    """(by, n_kept, n_skipped) of a filter."""
    return df.groupBy(*by).agg(F.count_if(keep).alias("n_kept"), F.count_if(~F.coalesce(keep, F.lit(False))).alias("n_skipped"))


def rows_per_minute(n: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, n / seconds * 60).otherwise(F.lit(0.0))


def global_batches(df: DataFrame, size: int, length: Column, key: str) -> DataFrame:
    """Batches of rows in the order of (length, key) over the whole table; what does not fill the
    last one is dropped."""
    return ranks.batched(df, size, length, F.col(key))
