"""Queries that write with the sinks and read back with the sources, and text columns, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import budgets, chain, landed, model, observed, quality, relational, rewards
from corvane.plans.catalog import _STRIPPED_SQL, _TURNS_SQL, _VALID, _docs, _query, _repo_files, _t, _turns
from corvane.sources import checked, readers, writers
from corvane.sources.storage import shared_folder
from corvane.streaming import resume

_ROW = "doc_id long, text string"


@_query("select doc_id, md5(text) text_md5 from documents")
def json_lines_round_trip(spark, sf):
    """Documents written as JSON lines, half of them appended, and read back; a file that is not there adds nothing."""
    d, path = _docs(spark, sf).select("doc_id", "text"), shared_folder(spark, "lines")
    writers.append_json(d, path)  # what the next write replaces
    writers.replace_json(d.where("doc_id % 2 = 0"), path)
    writers.append_json(d.where("doc_id % 2 = 1"), path)
    found = readers.json_lines(spark, path, _ROW).union(readers.json_lines(spark, f"{path}-none", _ROW, missing_ok=True))
    return found.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@_query("select doc_id, case doc_id % 3 when 0 then 'test' when 1 then 'train' else 'val' end split, md5(text) text_md5 from documents")
def split_sink(spark, sf):
    """Documents written to one folder a split, each folder read by itself."""
    split = F.when(F.col("doc_id") % 3 == 0, "test").when(F.col("doc_id") % 3 == 1, "train").otherwise("val")
    path = shared_folder(spark, "splits")
    writers.split_json(_docs(spark, sf).select("doc_id", "text", split.alias("split")), path)
    part = lambda s: readers.json_lines(spark, f"{path}/split={s}", _ROW).withColumn("split", F.lit(s))
    return part("train").union(part("val")).union(part("test")).select("doc_id", "split", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@_query("select 'array' form, n_nationkey k, n_name as name from nation union all select 'lines', n_nationkey, n_name from nation union all select 'object', n_nationkey, n_name from nation where n_nationkey = 3 union all select 'keyed', n_nationkey, n_name from nation union all select 'whole', n_nationkey, n_name from nation")
def json_forms(spark, sf):
    """Nations as an array, as lines, as one object and as an object of objects, told apart by the reader."""
    n = _t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"))
    schema, at = "k long, name string", {f: shared_folder(spark, f) for f in ("array", "lines", "object", "keyed")}
    writers.array_json(n, at["array"])
    writers.replace_json(n, at["lines"])
    writers.replace_json(n.where("k = 3"), at["object"])
    writers.object_json(n, at["keyed"], "k")
    read = {f: readers.json_any(spark, at[f], schema, required=("k", "name")) for f in ("array", "lines", "object")}
    read["keyed"] = readers.json_map(spark, at["keyed"], "struct<name:string>", "k", "v").select(F.col("k").cast("long").alias("k"), "v.name")
    read["whole"] = readers.json_document(spark, at["array"], schema).union(readers.json_document(spark, f"{at['array']}-none", schema))
    form = lambda f: read[f].select(F.lit(f).alias("form"), "k", "name")
    return form("array").union(form("lines")).union(form("object")).union(form("keyed")).union(form("whole"))


@_query("select n_nationkey idx, n_nationkey * 0.25 - 3 reward from nation")
def reward_cache(spark, sf):
    """Rewards kept as an object of numbers under number-like keys."""
    path = shared_folder(spark, "rewards")
    rewards = _t(spark, sf, "nation").select("n_nationkey", (F.col("n_nationkey") * F.lit(0.25) - 3).alias("reward"))
    writers.numbers_json(rewards, path, "n_nationkey", "reward")
    return readers.reward_cache(spark, path)


@_query("select doc_id // 100 archive, 'src/' || doc_id || '.py' file_path, md5(text) text_md5 from documents where doc_id % 3 = 0")
def archive_scan(spark, sf):
    """Needed files out of archives of a hundred documents each, below a first path segment that is dropped."""
    file = _docs(spark, sf).select(F.floor(F.col("doc_id") / 100).alias("archive"), F.format_string("src/%d.py", "doc_id").alias("file_path"), "text", "doc_id")
    folder = shared_folder(spark, "archives")
    writers.zip_archives(file, folder).agg(F.sum("n_files")).first()
    place = F.concat(F.lit(f"{folder}/"), F.col("archive"), F.lit(".zip"))
    needed = file.where("doc_id % 3 = 0").select(place.alias("archive"), "file_path")
    found = readers.archive_texts(spark, f"{folder}/*.zip", needed)
    return found.select(F.regexp_extract("archive", r"(\d+)\.zip$", 1).cast("long").alias("archive"), "file_path", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@_query("select doc_id, case when doc_id % 2 = 0 then 'about ' || doc_id end completion from documents")
def recorded_completions(spark, sf):
    """Completions made elsewhere, joined to their samples; samples without one get null."""
    d = _docs(spark, sf).select("doc_id")
    made = d.where("doc_id % 2 = 0").select("doc_id", F.concat(F.lit("about "), F.col("doc_id")).alias("completion"))
    return model.recorded(d, made, "doc_id")


_SPLIT_SQL = r"regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')"
_BLANKS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_BLANKS}+|{_BLANKS}+$', '', 'g')"


_COLLAPSED_SQL = _strip_sql(f"regexp_replace(text, '{_BLANKS}+', ' ', 'g')")


@_query(f"""select doc_id, md5({_strip_sql(f"array_to_string(list_transform({_SPLIT_SQL}, lambda x: {_strip_sql('x')}), chr(10))")}) javadoc, md5({_COLLAPSED_SQL}) java_line, md5({_COLLAPSED_SQL}) python_line,
 md5({_COLLAPSED_SQL}) unquoted, md5(lower(replace(replace(replace({_COLLAPSED_SQL}, '“', '"'), '”', '"'), '’', chr(39)))) normal from documents""")
def comment_texts(spark, sf):
    """Whole texts put in Java and Python comments and in quotes, and taken out again; and normalized."""
    text, flat = F.col("text"), T.collapse(F.col("text"))
    javadoc = F.concat(F.lit("/**\n * "), F.array_join(T.lines(text), "\n * "), F.lit("\n */"))
    made = {
        "javadoc": T.clean_javadoc(javadoc), "java_line": T.clean_java_comment(F.concat(F.lit("// "), flat)), "python_line": T.clean_python_comment(F.concat(F.lit("## "), flat)),
        "unquoted": T.strip_quotes(F.concat(F.lit(" '"), flat, F.lit("' "))), "normal": T.normalize(text),
    }
    return _docs(spark, sf).select("doc_id", *(F.md5(c.cast("binary")).alias(n) for n, c in made.items()))


@_query(f"select doc_id, md5(array_to_string(({_SPLIT_SQL})[2:4], chr(10))) span_md5 from documents")
def line_spans(spark, sf):
    """Lines 2 to 4 of each text."""
    return _docs(spark, sf).select("doc_id", F.md5(T.line_span(F.col("text"), F.lit(2), F.lit(4)).cast("binary")).alias("span_md5"))


@_query("select source, case when count(*) % 2 = 0 then 0.0 else count(*) / 7.0 * 60 end per_minute from documents group by 1")
def rows_per_minute(spark, sf):
    """Throughput of each source over made times; no time gives none."""
    n = _docs(spark, sf).groupBy("source").agg(F.count("*").alias("n"))
    return n.select("source", landed.rows_per_minute(F.col("n"), F.when(F.col("n") % 2 == 0, 0.0).otherwise(7.0)).alias("per_minute"))


@_query("select doc_id, md5(text) text_md5 from documents")
def stream_resume(spark, sf):
    """A stream of JSON lines appended once a key: a third of them first, then all, twice."""
    d, source, target = _docs(spark, sf).select("doc_id", "text"), shared_folder(spark, "in"), shared_folder(spark, "out")
    checkpoint = shared_folder(spark, "progress")
    for rows in (d.where("doc_id % 3 = 0"), d, d.where("doc_id % 2 = 0")):
        writers.append_json(rows, source)
        resume.append_new(spark, source, _ROW, target, checkpoint, "doc_id").awaitTermination()
    return spark.read.schema(_ROW).parquet(target).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@_query("select doc_id, case when doc_id % 7 = 0 then 'parse' when doc_id % 11 = 0 then 'required' else 'good' end stage from documents")
def line_errors(spark, sf):
    """Documents as JSON lines, some of them cut off or without a text; a row for each bad line."""
    i = F.col("doc_id")
    line = F.to_json(F.struct("doc_id", F.when((i % 7 == 0) | (i % 11 != 0), F.col("text")).alias("text")))
    path = shared_folder(spark, "lines")
    _docs(spark, sf).select(F.when(i % 7 == 0, F.left(line, F.length(line) - 1)).otherwise(line).alias("value")).write.text(path)
    good, bad = checked.json_lines_checked(spark, path, _ROW, required=("text",))
    return good.select("doc_id", F.lit("good").alias("stage")).unionByName(bad.select(F.regexp_extract("value", r"(\d+)", 1).cast("long").alias("doc_id"), "stage"))


@_query("select count(*) filter (n_chars > 500) n_kept, count(*) filter (n_chars <= 500) n_skipped from documents")
def observed_write(spark, sf):
    """Documents written with a filter; how many were kept and left out comes with the write."""
    told = observed.write_kept(_docs(spark, sf), F.col("n_chars") > 500, shared_folder(spark, "kept"))
    return spark.createDataFrame([(told.n_kept, told.n_skipped)], "n_kept long, n_skipped long")


@_query("select doc_id, round(length(text) / 8.0::double, 6) reward from documents")
def cached_rewards(spark, sf):
    """Rewards of whole texts by a stand-in for a model, half of them kept from an earlier run."""
    table, docs = rewards.RewardTable(spark, shared_folder(spark, "rewards")), _docs(spark, sf).select("doc_id", "text")
    score = lambda texts: [len(t[0]) / 8 for t in texts]
    table.rewarded(docs.where("doc_id % 2 = 0"), ["text"], score)
    return table.rewarded(docs, ["text"], score).select("doc_id", F.round("reward", 6).alias("reward"))


_TWICE = "left(draft || chr(10) || chr(10) || draft, 60)"


@_query(f"select conv_id, md5(case when {_VALID.format(_TWICE)} then {_TWICE} else draft end) answer_md5 from {_TURNS_SQL} where {_VALID.format('draft')}")
def answer_chain(spark, sf):
    """Drafts, gated, and improvements with a fallback, batch by batch with a log; the slots are
    stand-ins: a draft is its prompt, an improvement the first 60 signs of what it is asked."""
    rows = _turns(spark, sf).where("draft is not null").select("conv_id", F.col("draft").alias("prompt"))
    out = chain.drafted_and_improved(rows, "conv_id", "prompt", lambda p: p, lambda p: [x[:60] for x in p], shared_folder(spark, "chain"), batches=2)
    return out.select("conv_id", F.md5(F.col("final_answer").cast("binary")).alias("answer_md5"))


@_query("select source repo_id, count(*) total_core_files, round(avg((doc_id % 3 <> 0)::int::double), 6) core_density, case when source in ('src0', 'src3') then null else count(*) end n_commits, 'bucket' is not null has_scores from documents group by 1")
def repo_records(spark, sf):
    """One nested record a repository; two of them have no commits."""
    docs = quality.repo_metrics(_repo_files(spark, sf).withColumns({f"{p}_{c}": F.lit(0).cast("long") for p in ("total", "documented") for c in ("classes", "public_classes", "public_functions")}))
    path = F.concat(F.when(F.col("doc_id") % 3 == 0, "docs/").otherwise("src/"), F.col("doc_id"), F.lit(".py"))
    density = quality.core_density(_docs(spark, sf).select(F.col("source").alias("repo_id"), path.alias("file_path")))
    commits = _docs(spark, sf).where(~F.col("source").isin("src0", "src3")).groupBy(F.col("source").alias("repo_id")).agg(F.count("*").alias("n_commits_seen"))
    scores = quality.repo_scores(docs).select("repo_id", "api_doc_score", "comment_score", "final_score", "quality_bucket")
    out = quality.repo_records(docs, density, commits, scores)
    return out.select("repo_id", "total_core_files", F.round("core_density", 6).alias("core_density"), F.col("commit_metrics.n_commits_seen").alias("n_commits"), F.col("scores.quality_bucket").isNotNull().alias("has_scores"))


@_query(f"select doc_id, 'found' state from documents d where doc_id % 3 <> 0 and doc_id % 5 <> 0 and {_STRIPPED_SQL} <> '' union all select doc_id, 'missing' from documents where doc_id % 3 = 0")
def missing_sources(spark, sf):
    """Wanted files with their texts and without the blank ones, and the list of those that are missing."""
    d = _docs(spark, sf)
    texts = d.where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, " \n").otherwise(F.col("text")).alias("text"))
    found, missing = relational.with_sources(d.select("doc_id"), texts, ["doc_id"])
    return found.select("doc_id", F.lit("found").alias("state")).unionByName(missing.select("doc_id", F.lit("missing").alias("state")))


@_query("select doc_id, case when doc_id % 4 = 0 then 'docstring' when doc_id % 4 = 1 then 'javadoc' else 'inline_comment' end source from (select doc_id, case when doc_id % 3 = 0 then 'so few words' else text end as text, doc_id % 6 <> 5 has from documents) where (doc_id % 4 > 1 or len(regexp_extract_all(text, '{TOK}')) >= 5) and has and doc_id % 5 <> 2")
def pairs_in_scope(spark, sf):
    """Pairs of the two languages that have a category, without doc comments that are too short."""
    i = F.col("doc_id")
    rows = _docs(spark, sf).select("doc_id", F.when(i % 4 == 0, "docstring").when(i % 4 == 1, "javadoc").otherwise("inline_comment").alias("source"), F.when(i % 3 == 0, "so few words").otherwise(F.col("text")).alias("text"), F.when(i % 5 == 2, "Ruby").when(i % 5 == 1, "Java").otherwise("Python").alias("language"), F.when(i % 6 != 5, "any").alias("category"))
    return relational.in_scope(relational.telling_docs(rows)).select("doc_id", "source")


@_query("select doc_id, length(text)::varchar completion, true fits from documents")
def budget_batches(spark, sf):
    """Whole texts in batches of a token budget; the slot is a stand-in that counts signs."""
    done = budgets.completed(_docs(spark, sf).select("doc_id", "text"), "text", lambda p: [str(len(x)) for x in p], budget=4096)
    return done.select("doc_id", "completion", ((F.col("batch_rows") == 1) | (F.col("batch_tokens") <= 4096)).alias("fits"))
