"""Joins, deduplication, sampling, splitting and batching as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.scoring import QUOTAS
from corvane.functions.text import count_tokens, seeded, strip
from corvane.operators import intervals, ranks


def first_by_key(df: DataFrame, key: Column, *order: Column, keep_null: bool = False) -> DataFrame:
    """The first row of each key; rows with a null key go unless asked for."""
    keyed = df.withColumn("__k", key)
    keyed = keyed if keep_null else keyed.where("__k is not null")
    return keyed.withColumn("__n", F.row_number().over(Window.partitionBy("__k").orderBy(*order))).where("__n = 1").drop("__k", "__n")


def last_by_key(df: DataFrame, key: Column, order: Column) -> DataFrame:
    return first_by_key(df, key, order.desc())


def dedup_pairs(df: DataFrame, order: Column, code: str = "code", text: str = "text", confidence: str = "confidence") -> DataFrame:
    """One row for each stripped (code, text): the first of high confidence if there is
    one, else the first; ``first_ord`` is where the pair came up first.  ``order`` is
    unique within a pair.  Digests are ranked, and whole rows only meet the chosen ones, by
    digest and order, so a pair that a third of the rows hold is not gathered anywhere."""
    digest = lambda c: F.sha2(strip(F.col(c)).cast("binary"), 256)
    keyed = df.select("*", digest(code).alias("__c"), digest(text).alias("__t"), order.alias("__o"))
    late = F.coalesce(F.col(confidence) != "high", F.lit(True))
    best = keyed.groupBy("__c", "__t").agg(F.min("__o").alias("first_ord"), F.min(F.struct(late, F.col("__o").alias("o"))).alias("__best"))
    chosen = best.select(F.col("__c").alias("__bc"), F.col("__t").alias("__bt"), "first_ord", F.col("__best.o").alias("__bo"))
    same = F.col("__c").eqNullSafe(F.col("__bc")) & F.col("__t").eqNullSafe(F.col("__bt")) & F.col("__o").eqNullSafe(F.col("__bo"))
    return keyed.join(chosen, same).drop("__c", "__t", "__o", "__bc", "__bt", "__bo")


def status_of(df: DataFrame, key: Column, accepted: DataFrame, order: Column) -> DataFrame:
    """accepted / rejected / duplicate / invalid for each candidate; accepted: (key)."""
    keyed = df.withColumn("key", key)
    none = keyed.where("key is null").withColumn("status", F.lit("invalid"))
    keyed = keyed.where("key is not null").withColumn("__n", F.row_number().over(Window.partitionBy("key").orderBy(order)))
    known = accepted.select(F.lower("key").alias("key")).distinct().withColumn("__a", F.lit(True))
    return none.unionByName(keyed.join(known, "key", "left").withColumn("status", F.when(F.col("__n") > 1, "duplicate").when(F.col("__a"), "accepted").otherwise("rejected")).drop("__n", "__a"))


def top_per_group(df: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def latest_before(df: DataFrame, group: str, ts: str, value: str, cutoff: Column) -> DataFrame:
    """As-of: the newest value of each group up to the cutoff."""
    return df.where(F.col(ts) <= cutoff).groupBy(group).agg(F.max(F.struct(ts, value)).alias("__m")).select(group, F.col(f"__m.{ts}").alias(ts), F.col(f"__m.{value}").alias(value))


def enclosing(items: DataFrame, nodes: DataFrame, keys: list[str], item_id: list[str] | None = None) -> DataFrame:
    """Each item with the smallest node that holds it; ties go to the first in walk
    order.  items: keys, item_id, i_start, i_end; nodes: keys, ord, start, end, ..."""
    return intervals.smallest_enclosing(items, nodes, keys)


def overlapping(ranges: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct (keys, name) of the nodes that a range touches; ranges: keys, r_start, r_end."""
    return intervals.touched(ranges, nodes, keys).select(*keys, "name").distinct()


def touched_names(ranges: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_names, confidence): one touched name is high, more are medium."""
    return overlapping(ranges, nodes, keys).groupBy(*keys).agg(F.count("*").alias("n_names")).withColumn("confidence", F.when(F.col("n_names") == 1, "high").otherwise("medium"))


def keep_src_only(items: DataFrame, repo: str = "repo_id") -> DataFrame:
    """Files of a listing; where a repository has a top folder src, only what is in it."""
    has = F.max(((F.col("path") == "src") & (F.col("type") == "tree")).cast("int")).over(Window.partitionBy(repo))
    return items.withColumn("__s", has).where((F.col("type") == "blob") & ((F.col("__s") == 0) | F.col("path").startswith("src/"))).drop("__s")


def quota_sample(df: DataFrame, category: str, language: str, key: Column, quotas: dict[str, int] | None = None, seed: int = 42) -> DataFrame:
    """At most quota // languages rows of each (category, language); a shortfall is not
    dealt out again."""
    quotas = QUOTAS if quotas is None else quotas
    limits = df.where(F.col(category).isin(*quotas)).select(category, language).distinct().groupBy(category).agg(F.count("*").alias("__langs"))
    quota = F.coalesce(*(F.when(F.col(category) == c, F.lit(q)) for c, q in quotas.items()), F.lit(0))
    order = Window.partitionBy(category, language).orderBy(seeded(key, seed), key)
    most = max(quotas.values(), default=0)
    ranked = df.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most)
    return ranked.join(F.broadcast(limits), category).where(F.col("__n") <= F.floor(quota / F.col("__langs"))).drop("__n", "__langs")


def uniform_sample(df: DataFrame, n: int, key: Column, seed: int = 42) -> DataFrame:
    return df.orderBy(seeded(key, seed), key).limit(n)


def group_split(df: DataFrame, group: str, train: float = 0.7, val: float = 0.15, seed: int = 42) -> DataFrame:
    """Whole groups go to train, val or test.  Ranks come from windows over 4096 ranges
    of the hash and the sizes of these, not from one task's window over all groups."""
    groups = df.select(F.coalesce(F.col(group).cast("string"), F.lit("unknown")).alias("__g")).distinct().withColumn("__h", seeded(F.col("__g"), seed))
    placed = groups.withColumn("__p", F.left("__h", F.lit(3)))
    placed = placed.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy("__h", "__g")))
    sizes = placed.groupBy("__p").agg(F.count("*").alias("__c"))  # one row a range
    bases = sizes.withColumn("__b", F.sum("__c").over(Window.orderBy("__p")) - F.col("__c")).crossJoin(sizes.agg(F.sum("__c").alias("__all")))
    i = F.col("__b") + F.col("__r")
    a = F.floor(F.col("__all") * F.lit(train))
    b = a + F.floor(F.col("__all") * F.lit(val))
    ranked = placed.join(F.broadcast(bases), "__p").select("__g", F.when(i <= a, "train").when(i <= b, "val").otherwise("test").alias("split"))
    return df.withColumn("__g", F.coalesce(F.col(group).cast("string"), F.lit("unknown"))).join(ranked, "__g").drop("__g")


def full_batches(df: DataFrame, within: str, size: int, *order: Column) -> DataFrame:
    """Batches of a fixed size inside each group; what does not fill one is dropped."""
    return ranks.batched(df, size, *order, within=(within,))


#: Sources whose texts must be long enough, and the languages of pairs.
DOC_SOURCES = ("docstring", "javadoc")
LANGUAGES = ("Python", "Java")


def telling_docs(df: DataFrame, source: str = "source", text: str = "text", least: int = 5) -> DataFrame:
    """Without doc comments of fewer than ``least`` tokens; comments and commit messages of any length stay."""
    return df.where(~F.coalesce(F.col(source).isin(*DOC_SOURCES), F.lit(False)) | (count_tokens(F.col(text)) >= least))


def in_scope(df: DataFrame, language: str = "language", category: str = "category") -> DataFrame:
    """Rows of a language that pairs are made of, and of some category."""
    return df.where(F.col(language).isin(*LANGUAGES) & F.col(category).isNotNull())


def with_sources(wanted: DataFrame, texts: DataFrame, keys: list[str], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Wanted files with their texts, blank ones left out, and (keys) of the files that have none."""
    met = wanted.join(texts.select(*keys, text, F.lit(True).alias("__there")), keys, "left")
    found = met.where("__there").where(strip(F.col(text)) != "").drop("__there")
    return found, met.where("__there is null").select(*keys)


def not_done(df: DataFrame, done: DataFrame, key: str | list[str]) -> DataFrame:
    """Resume: what an earlier run has not written."""
    return df.join(done.select(key) if isinstance(key, str) else done.select(*key), key, "left_anti")
